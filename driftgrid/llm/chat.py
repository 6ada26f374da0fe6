"""Chat formatting from event logs, in DataFrame functions only.

A log has one row per event: ``conv_id``, ``turn`` (the message), ``seq`` (the
order of events), ``kind``, ``role`` and ``text``. ``message`` sets a message,
``delta`` appends to it, ``edit`` replaces its text, ``regenerate`` drops what
it held and starts anew with its text. Folding is associative, so a message is
folded over blocks of ``seq`` first and over the blocks after that, and a
conversation is put together from segments of ``SEGMENT`` turns: no task holds
more of a long conversation than that, until its one output string is joined.

In the output a message is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles
and texts ``<``, backslashes, ``|`` gets one backslash more, so no control
string can occur there and the change can be undone. A role's line breaks and
percent signs become ``%0A`` and ``%25``.

Defined cases: null role, text or kind are empty, empty and ``message``; a null
``conv_id`` is a conversation of its own; a null turn comes first. Events of one
message with equal ``seq`` are ordered by kind, role and text. Other columns
are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a segment and events of a block.
SEGMENT, BLOCK = 64, 256
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _folded(steps: Column) -> list[Column]:
    """The fold of ordered steps ``(.., reset, role, text)``: is it a reset, its role, its text."""
    last = F.coalesce(F.array_max(F.transform(steps, lambda s, i: F.when(s.reset, i + 1))), F.lit(0))
    tail = F.slice(steps, F.greatest(last, F.lit(1)), F.size(steps))
    roles = F.filter(F.transform(steps, lambda s: s.role), lambda r: r.isNotNull())
    return [
        (last > 0).alias("reset"),
        F.try_element_at(roles, F.lit(-1)).alias("role"),
        F.array_join(F.transform(tail, lambda s: s.text), "").alias("text"),
    ]


def fold(events: DataFrame, message: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """One row per message: its key, ``role`` and ``text`` after all its events."""
    kind = F.coalesce("kind", F.lit("message"))
    rows = events.select(
        *message,
        "seq",
        F.floor(F.col("seq") / BLOCK).alias("block"),
        kind.alias("kind"),
        (kind != "delta").alias("reset"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    steps = F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text", "reset")))
    blocks = rows.groupBy(*message, "block").agg(steps.alias("steps")).select(*message, "block", *_folded(F.col("steps")))
    steps = F.sort_array(F.collect_list(F.struct("block", "reset", "role", "text")))
    return blocks.groupBy(*message).agg(steps.alias("steps")).select(*message, *_folded(F.col("steps"))).drop("reset")


def render(messages: DataFrame, order: tuple[str, ...] = ("turn",), learn: str = "assistant") -> DataFrame:
    """Segments of conversations: ``conv_id``, ``segment``, ``turns``, ``formatted`` and the loss mask.

    ``loss`` lists spans ``(start, length)`` in code points of ``formatted``, one for each text of the role ``learn``.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    parts = messages.select(
        "conv_id",
        *order,
        F.floor(F.col(order[0]) / SEGMENT).alias("segment"),
        (role == learn).alias("learn"),
        F.concat(F.lit(START), escape_role(role), F.lit("\n")).alias("head"),
        escape(text).alias("body"),
    ).withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id", "segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("learn"), F.struct(F.col("at").cast("int").alias("start"), F.length("body").alias("length")))
    rows = F.sort_array(F.collect_list(F.struct(*order, "piece", span.alias("span"))))
    return (
        placed.groupBy("conv_id", "segment")
        .agg(rows.alias("rows"))
        .select(
            "conv_id",
            "segment",
            F.size("rows").alias("turns"),
            F.array_join("rows.piece", "").alias("formatted"),
            F.filter("rows.span", lambda s: s.isNotNull()).alias("loss"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The messages of a formatted text as an array of ``(role, text)``."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != "")

    def message(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        role = F.substring(piece, F.lit(len(START) + 1), cut - len(START) - 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(piece, cut + 1, F.length(piece))).alias("text"))

    return F.transform(pieces, message)


def under_mask(formatted: Column, loss: Column) -> Column:
    """The texts under the mask, unescaped, joined with nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s.start + 1, s.length))), "")


def conversations(segments: DataFrame) -> DataFrame:
    """Whole conversations: ``conv_id``, ``turns`` and ``formatted``, one string each."""
    rows = F.sort_array(F.collect_list(F.struct("segment", "formatted")))
    return segments.groupBy("conv_id").agg(F.sum("turns").alias("turns"), rows.alias("rows")).select("conv_id", "turns", F.array_join("rows.formatted", "").alias("formatted"))
