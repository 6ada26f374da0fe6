"""All registered queries."""

from driftgrid.plans import catalog_fields, catalog_fusion, catalog_patches  # noqa: F401
from driftgrid.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
