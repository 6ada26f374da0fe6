"""From raw documents to token ids, in four stages.

Each stage takes the session, the documents its predecessor kept and the
folder of the tables, and returns a DataFrame; all but the last return the
columns of ``documents``. Between stages the rows are stored, so a lost
executor costs at most the stage at hand.

Rows are told apart by their number and text together: rows that repeat both
are one document, rows that share only the number are not.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.llm import bpe, mixing, ppm, simhash
from driftgrid.llm.queries import sha
from driftgrid.scale import durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its best language is less likely than this.
LEAST_SCORE = 0.5
#: Near duplicates are told by shingles of this many words.
WIDTH = 5
#: The last stage runs in executors whose heap the stages before have filled, so its workers remember less.
CACHE = 0.25


def _row_key():
    """The number and 128 bits of the text's digest; ``-`` stands for a null."""
    digest = F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 32)
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(digest, F.lit("-")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; a missing ``lang`` is filled in. A null text or one without letters goes."""
    carried = {c: F.col(c) for c in ("lang", "source", "n_chars")}
    found = ppm.identify(docs, ppm.learn(docs), keep=carried, carry="text")
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest number (null last).

    Documents are linked whose SimHashes of five-word shingles differ in at most four of 64 bits, which is a similarity of
    some 0.95. A wider radius would find more near copies in a small corpus, but in one of 10^10 documents chance alone
    brings a third of them within 7 bits of another.
    """
    rows = docs.withColumn("row_", _row_key())
    found = simhash.near_duplicates(rows, keep={"row_": F.col("row_")}, width=WIDTH)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_")
    chosen = durable(found.groupBy("group_id").agg(F.min_by("row_", order).alias("row_")).select("row_"))
    return rows.join(chosen, "row_").dropDuplicates(["row_"]).select(COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    rows = docs.withColumn("row_", _row_key())
    mixed = mixing.mix(rows, keep={"row_": F.col("row_")})
    copies = durable(mixed.groupBy("row_").agg(F.sum("copies").cast("int").alias("copies_")).where(F.col("copies_") > 0))
    taken = rows.join(copies, "row_").dropDuplicates(["row_"])
    return taken.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_")))).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], cache=CACHE).select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        sha(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        sha(F.col("decoded")).alias("decoded_sha256"),
        "ids",
    )


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_duplicates), ("source mix", source_mix), ("BPE tokens", tokens)]

#: The stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
