"""Displacement-field analytics as Spark DataFrame operators.

Images and two-component vector fields are pixel tables: one row per pixel,
keyed by ``(frame_id, y, x)``. Every operator takes and returns DataFrames.
"""

__version__ = "0.1.0"
