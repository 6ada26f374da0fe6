"""URL filters by association rules, in DataFrame functions only.

Labelled URLs become baskets of tokens (parts of the host, of the path and
names of parameters) with their label. FP-growth mines the frequent
combinations; rules that lead to the label ``block`` are kept if their support
and confidence reach the thresholds, their lift is above 1 and no shorter
rule inside them is as confident. A rule is found by an inverted index under
its rarest token and then tested whole. Given host rules are found by the
suffixes of the host, likewise by a join.

FP-growth lists all frequent subsets of a basket, so one long URL would stop
it. What cannot be part of a kept rule is therefore taken out first, which
leaves the kept rules as they are:

* A token with too few blocked URLs is in no frequent rule.
* A token that all URLs have adds nothing to a rule.
* A token whose every URL is blocked is a rule by itself, with confidence 1, so
  none that contains it is kept beside it.
* Of tokens that occur in exactly the same URLs a kept rule holds at most one,
  and any of them does as well. They are mined as one item; a rule of items
  stands for every choice of a token from each.

Both steps run once per distinct URL, so a URL that repeats without end costs
no more than one; the answer is joined back, and no row leaves that join.

Defined cases: a null URL, or one without ``://``, has empty host and path and
no tokens; such a URL is allowed. Null labels are no labels; a URL with several
labels is a basket for each. Without labelled URLs there are no mined rules.
Other columns are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.scale import durable

MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL: host, parts of the host, of the path (digits as one sign), names of parameters."""
    name = lambda kind, parts: F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.concat(F.lit(f"{kind}:"), p))
    parts = F.split(F.regexp_replace(path(url), "[0-9]+", "0"), "/")
    query = F.split(F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1), "&")
    keys = F.transform(query, lambda q: F.substring_index(q, "=", 1))
    return F.array_distinct(F.concat(name("host", F.array(host(url))), name("label", F.split(host(url), r"\.")), name("path", parts), name("key", keys)))


def suffixes(name: Column) -> Column:
    """A host and the domains above it."""
    labels = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _items(baskets: DataFrame, n: int, least: int) -> DataFrame:
    """``token``, its ``item``, and how many URLs (``n_token``) and blocked URLs (``n_blocked``) have it.

    Tokens of the same URLs share an item, named by the least of them: their
    baskets agree in number and in the exclusive or of two 64-bit hashes.
    """
    each = baskets.select(F.explode("own").alias("token"), "blocked", "n", F.xxhash64("own", "blocked").alias("one"), F.xxhash64(F.lit("two"), "own", "blocked").alias("two"))
    counted = each.groupBy("token").agg(
        F.sum("n").alias("n_token"),
        F.sum(F.when(F.col("blocked"), F.col("n")).otherwise(0)).alias("n_blocked"),
        F.struct(F.count("*"), F.bit_xor("one"), F.bit_xor("two")).alias("where_"),
    )
    held = durable(counted.where((F.col("n_blocked") >= least) & (F.col("n_token") < n)))
    return held.join(held.groupBy("where_").agg(F.min("token").alias("item")), "where_").select("token", "item", "n_token", "n_blocked")


def _mined(baskets: DataFrame, members: DataFrame, n: int, n_blocked: int, least: int, min_confidence: float) -> DataFrame:
    """Rules of two and more items, and of one that is not certain: ``items``, ``confidence`` and ``support``, none needless."""
    spark = baskets.sparkSession
    unsure = members.where(F.col("n_blocked") < F.col("n_token")).select("token", "item")
    each = baskets.select("own", "blocked", "n", F.explode("own").alias("token")).join(unsure, "token")
    short = each.groupBy("own", "blocked", "n").agg(F.sort_array(F.collect_set("item")).alias("items"))
    short = durable(short.groupBy("items", "blocked").agg(F.sum("n").alias("n")))
    if short.isEmpty():
        return spark.createDataFrame([], "items array<string>, confidence double, support double")
    # a row for every URL again; long sequences in two steps
    rows = short.withColumn("many", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 65536))))
    rows = rows.withColumn("one", F.explode(F.sequence(F.lit(1), F.least(F.col("n") - F.col("many") * 65536, F.lit(65536)))))
    rows = durable(rows.select(F.concat("items", F.array(F.when(F.col("blocked"), "verdict:block").otherwise("verdict:allow"))).alias("items")))
    held = rows.count()
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / held, minConfidence=min_confidence).fit(rows)
    rule = model.associationRules.where((F.col("consequent")[0] == "verdict:block") & (F.col("confidence") > n_blocked / n))
    # URLs without any of the items are not among the rows, so shares are put right
    blocks = F.round(F.col("support") * held)
    found = durable(rule.select(F.sort_array("antecedent").alias("items"), "confidence", (blocks / n).alias("support")))
    found = found.select(F.xxhash64("items").alias("rule_id"), "*")
    inside = found.select(F.explode("items").alias("item"), F.col("rule_id").alias("long_id"), F.col("items").alias("long"), F.col("confidence").alias("had"))
    shorter = found.select(F.col("items")[0].alias("item"), "items", "confidence")
    within = (F.size("items") < F.size("long")) & (F.size(F.array_except("items", "long")) == 0) & (F.col("confidence") >= F.col("had"))
    needless = inside.join(shorter, "item").where(within).select(F.col("long_id").alias("rule_id")).distinct()
    return found.join(needless, "rule_id", "left_anti").drop("rule_id")


def item_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules as ``items``, ``confidence`` and ``support``, and the members of items as ``token``, ``item`` and ``n_token``.

    A URL fits a rule if it has a token of each of its items. ``labelled`` has
    ``url`` and ``blocked`` (boolean). The number of items is bounded by the
    support, not by the number of URLs.
    """
    spark = labelled.sparkSession
    own = F.sort_array(tokens(F.col("url"))).alias("own")
    baskets = durable(labelled.where(F.col("blocked").isNotNull()).select(own, "blocked").groupBy("own", "blocked").agg(F.count("*").alias("n")))
    n, n_blocked = baskets.agg(F.sum("n"), F.sum(F.when(F.col("blocked"), F.col("n")))).first()
    least = max(math.ceil(min_support * (n or 0)), 1)
    members = durable(_items(baskets, n or 0, least))
    if not n or not n_blocked or n_blocked == n:  # no rule's lift could be above 1
        return spark.createDataFrame([], "items array<string>, confidence double, support double"), members.limit(0)
    sure = members.where(F.col("n_blocked") == F.col("n_token")).groupBy("item").agg(F.first("n_blocked").alias("hits"))
    sure = sure.select(F.array("item").alias("items"), F.lit(1.0).alias("confidence"), (F.col("hits") / n).alias("support"))
    return durable(sure.unionByName(_mined(baskets, members, n, n_blocked, least, min_confidence))), members


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The kept rules written out, token by token: ``rule_id``, ``tokens``, ``confidence``, ``support``.

    ``judge`` uses ``item_rules``, which are fewer: this list has every choice of one token from each item.
    """
    rules, members = item_rules(labelled, min_support, min_confidence)
    named = members.groupBy("item").agg(F.collect_list("token").alias("choices"))
    each = rules.withColumn("rule_id", F.monotonically_increasing_id())
    each = durable(each).select("rule_id", "confidence", "support", F.explode("items").alias("item")).join(named, "item")
    choices = each.groupBy("rule_id", "confidence", "support").agg(F.collect_list("choices").alias("choices"))
    none = F.array(F.array().cast("array<string>"))
    longer = lambda so_far, more: F.flatten(F.transform(so_far, lambda s: F.transform(more, lambda t: F.array_append(s, t))))
    every = choices.select("confidence", "support", F.explode(F.aggregate("choices", none, longer)).alias("tokens"))
    every = every.select(F.sort_array("tokens").alias("tokens"), "confidence", "support")
    return every.select(F.xxhash64("tokens").alias("rule_id"), "tokens", "confidence", "support")


def index(rules: DataFrame, members: DataFrame) -> DataFrame:
    """Each rule under its item that fewest labelled URLs have."""
    often = members.groupBy("item").agg(F.first("n_token").alias("n_item"))  # the same for all tokens of an item
    each = rules.select("items", "confidence", F.explode("items").alias("item")).join(often, "item")
    under = each.groupBy("items", "confidence").agg(F.min(F.struct("n_item", "item")).alias("least"))
    return under.select("items", "confidence", F.col("least.item").alias("item"))


def judge(pages: DataFrame, labelled: DataFrame, host_rules: Sequence[tuple[str, str]], min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``confidence`` of the mined rule; one row per row of ``pages``.

    ``host_rules`` are ``("block" or "allow", "host/path")``; the longest that fits decides, ties go to the smaller text.
    """
    spark = pages.sparkSession
    rules, members = item_rules(labelled, min_support, min_confidence)
    mined = durable(index(rules, members))
    given = spark.createDataFrame(
        [(verdict, rule, rule.partition("/")[0], "/" + rule.partition("/")[2]) for verdict, rule in host_rules],
        "given string, rule string, rule_host string, rule_path string",
    )
    text = F.coalesce("url", F.lit(""))
    urls = pages.select(text.alias("url")).distinct()
    urls = durable(urls.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), tokens(F.col("url")).alias("own")))
    fits = urls.select("url", "path", F.explode(suffixes(F.col("host"))).alias("rule_host")).join(given, "rule_host").where(F.startswith("path", "rule_path"))
    best = F.min_by(F.struct("rule", "given"), F.struct(-F.length("rule"), "rule"))
    ruled = fits.groupBy("url").agg(best.alias("best")).select("url", "best.*")
    items = urls.select("url", F.explode("own").alias("token")).join(members, "token").groupBy("url").agg(F.collect_set("item").alias("has"))
    hits = items.select("url", "has", F.explode("has").alias("item")).join(mined, "item").where(F.size(F.array_except("items", "has")) == 0)
    hits = hits.groupBy("url").agg(F.max("confidence").alias("confidence"))
    judged = urls.join(ruled, "url", "left").join(hits, "url", "left")
    method = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    judged = judged.select("url", "host", "path", "rule", F.coalesce("given", method).alias("verdict"), "confidence")
    return pages.select("page_id", text.alias("url")).join(judged, "url").select("page_id", "host", "path", "rule", "verdict", "confidence")

