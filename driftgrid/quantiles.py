"""Exact quantiles without gathering a group in one task.

Groups with up to ``bound`` distinct values use the built-in exact ``percentile``,
whose buffer holds one entry per distinct value; the groups are sized first.
Larger groups are narrowed by histograms: each round
counts values per bin (combined map-side, so only ``bins`` rows per group are
shuffled), finds the bin of every wanted rank and continues inside it, until
the bin holds one distinct value. Infinities and NaN are counted apart, in the
order of ``percentile`` (NaN last), so histograms see finite values only. A round shrinks the range by ``bins`` and
always separates its smallest from its largest value, so it ends for every
distribution; about ``log(n)/log(bins)`` rounds are needed. After the first round
only the values inside the wanted bins are kept, in a table of their own.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.scale import durable

BOUND = 65_536
BINS = 1024


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    share = (value - low) / (high - low)
    inner = F.least(F.floor(share * bins).cast("int"), F.lit(bins - 1))
    return F.when(value >= high, F.lit(bins - 1)).otherwise(inner)


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    bound: int = BOUND,
    bins: int = BINS,
    extras: Sequence[Column] = (),
) -> DataFrame:
    """One row per key with ``q0, q1, …``: the linearly interpolated quantiles.

    ``extras`` are further named aggregates of ``df``, taken in the sizing pass.
    """
    if bins < 2:
        raise ValueError("bins must be at least 2")
    keys = list(keys)
    v = F.col(value).cast("double")
    rows = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull())
    # 1.2 covers the sketch's error; it only decides how, not what, is computed
    held = F.least(F.count(v), (F.approx_count_distinct(v) * 1.2).cast("long"))
    finite = F.when(~F.isnan(v) & (F.abs(v) < math.inf), v)
    sizing = [F.count(v).alias("n"), F.min(finite).alias("lo"), F.max(finite).alias("hi"), held.alias("held"), *extras]
    sizing += [F.count_if(v == -math.inf).alias("n_low"), F.count_if(v == math.inf).alias("n_high"), F.count_if(F.isnan(v)).alias("n_nan")]
    sizes = durable(df.groupBy(*keys).agg(*sizing))
    largest = sizes.agg(F.max("held")).first()[0] or 0
    kept = [c for c in sizes.columns if c not in ("n", "lo", "hi", "held", "n_low", "n_high", "n_nan")]
    if not keys:
        found = _built_in(rows, probs, []) if largest <= bound else _whole_table(rows, sizes, probs, bins)
        if not extras:
            return found
        return sizes.select(*kept).withColumns({q: found.select(q).scalar() for q in found.columns})
    if largest <= bound:
        found = _built_in(rows, probs, keys)
    else:
        few, many = sizes.where(F.col("held") <= bound), sizes.where(F.col("held") > bound)
        direct = _built_in(rows.join(few.select(*keys), keys, "left_semi"), probs, keys)
        found = direct.unionByName(_by_histogram(rows, many, probs, keys, bins))
    return sizes.select(*kept).join(found, keys) if extras else found


def _built_in(rows: DataFrame, probs, keys) -> DataFrame:
    found = rows.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias("_q"))
    return found.select(*keys, *[F.get("_q", F.lit(i)).alias(f"q{i}") for i in range(len(probs))])


def _by_histogram(rows: DataFrame, sizes: DataFrame, probs, keys, bins: int) -> DataFrame:
    wanted = F.array_distinct(
        F.flatten(
            F.array(*[F.array(F.floor((F.col("n") - 1) * float(p)), F.ceil((F.col("n") - 1) * float(p))) for p in probs])
        )
    )
    n, n_low, n_high, n_nan = (F.col(c) for c in ("n", "n_low", "n_high", "n_nan"))
    inner = lambda r: (r >= n_low) & (r < n - n_high - n_nan)
    ends = sizes.select(*keys, "n", "n_low", "n_high", "n_nan", F.explode(F.filter(wanted, lambda r: ~inner(r))).alias("rank"))
    outer = F.when(F.col("rank") < n_low, -math.inf).when(F.col("rank") < n - n_nan, math.inf).otherwise(math.nan)
    spans = sizes.select(*keys, "lo", "hi", n_low.alias("base"), F.filter(wanted, inner).alias("ranks"))
    spans = durable(spans.where(F.size("ranks") > 0))
    rows = rows.where(~F.isnan("_v") & (F.abs("_v") < math.inf))
    solved, narrowed = [ends.select(*keys, "rank", outer.alias("value"))], False
    while True:
        solved.append(
            spans.where("lo = hi").select(*keys, F.explode("ranks").alias("rank"), F.col("lo").alias("value"))
        )
        open_spans = spans.where("lo < hi")
        if open_spans.isEmpty():
            break
        per_key = open_spans.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi", "base", "ranks")).alias("spans"))
        inside = F.filter("spans", lambda s: (F.col("_v") >= s["lo"]) & (F.col("_v") <= s["hi"]))
        hit = rows.join(durable(per_key), keys).select(*keys, "_v", F.explode(inside).alias("s"))
        if narrowed:
            hit = durable(hit)
            rows = hit.select(*keys, "_v")
        narrowed = True
        counted = (
            hit.groupBy(*keys, "s", _bin(F.col("_v"), F.col("s.lo"), F.col("s.hi"), bins).alias("bin"))
            .agg(F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        )
        before = Window.partitionBy(*keys, "s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("base", F.col("s.base") + F.coalesce(F.sum("n").over(before), F.lit(0)))
        held = F.filter("s.ranks", lambda r: (r >= F.col("base")) & (r < F.col("base") + F.col("n")))
        spans = durable(placed.select(*keys, "lo", "hi", "base", held.alias("ranks")).where(F.size("ranks") > 0))
    values = reduce(DataFrame.unionByName, solved)
    by_rank = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("m"))
    joined = sizes.select(*keys, "n").join(by_rank, keys)
    return joined.select(*keys, *[_interpolated(float(p)).alias(f"q{i}") for i, p in enumerate(probs)])


def _interpolated(p: float) -> Column:
    position = (F.col("n") - 1) * F.lit(p)
    low, high = F.element_at("m", F.floor(position)), F.element_at("m", F.ceil(position))
    # an infinity must not be subtracted from itself
    return F.when(low == high, low).otherwise((F.ceil(position) - position) * low + (position - F.floor(position)) * high)


def _whole_table(rows: DataFrame, sizes: DataFrame, probs, bins: int) -> DataFrame:
    n, lo, hi, n_low, n_high, n_nan = sizes.select("n", "lo", "hi", "n_low", "n_high", "n_nan").first()
    positions = [(n - 1) * float(p) for p in probs]
    ranks = {math.floor(p) for p in positions} | {math.ceil(p) for p in positions}
    value_at = {r: -math.inf if r < n_low else math.inf if r < n - n_nan else math.nan for r in ranks}
    inner = sorted(r for r in ranks if n_low <= r < n - n_high - n_nan)
    spans, narrowed = [(lo, hi, n_low, inner)] if inner else [], False
    while spans:
        for low, high, _, held in spans:
            if low == high:
                value_at.update(dict.fromkeys(held, low))
        spans = [s for s in spans if s[0] < s[1]]
        if not spans:
            break
        v = F.col("_v")
        span_id = F.coalesce(*[F.when(v.between(s[0], s[1]), F.lit(k)) for k, s in enumerate(spans)])
        low_of = F.array(*[F.lit(s[0]) for s in spans])
        high_of = F.array(*[F.lit(s[1]) for s in spans])
        tagged = rows.select("_v", span_id.alias("s")).where("s IS NOT NULL")
        if narrowed:
            tagged = durable(tagged)
            rows = tagged.select("_v")
        narrowed = True
        place = _bin(v, F.get(low_of, F.col("s")), F.get(high_of, F.col("s")), bins)
        counted = tagged.groupBy("s", place.alias("b")).agg(
            F.count("_v").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
        )
        # at most len(spans) * bins rows reach the driver
        bars: dict[int, list] = {}
        for bar in sorted(counted.collect(), key=lambda r: (r["s"], r["b"])):
            bars.setdefault(bar["s"], []).append(bar)
        following = []
        for k, (_, _, base, held) in enumerate(spans):
            for bar in bars.get(k, []):
                mine = [r for r in held if base <= r < base + bar["n"]]
                if mine:
                    following.append((bar["lo"], bar["hi"], base, mine))
                base += bar["n"]
        spans = following
    result = []
    for p in positions:
        low, high = value_at[math.floor(p)], value_at[math.ceil(p)]
        result.append(low if low == high or p.is_integer() else (math.ceil(p) - p) * low + (p - math.floor(p)) * high)
    schema = ", ".join(f"q{i} double" for i in range(len(probs)))
    return rows.sparkSession.createDataFrame([tuple(result)], schema)
