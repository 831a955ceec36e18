"""The stages of the corpus pipeline: quality rules, near duplicates, benchmark passages, secrets, packing.

Each stage takes what its predecessor kept, with all of its columns; the last gives packed pieces. Stages that reject
rows name the rejected ones by a 128-bit hash of (doc_id, text, lang) and drop them by an anti join: the list is
broadcast if it was measured and is short, and shuffled otherwise. Text is shuffled only where it is not.

Edge cases: rows that agree in doc_id, text and lang are judged alike; a null text, an empty one and one of fewer
than ten words fail the quality rules; a null doc_id, lang or source is a value like others; texts are read whole at
any length; of equal rows one stays; an empty table gives an empty one; other columns are carried, whatever their
names, until the last stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, packing, quality, secrets, shingle_join
from .common import cut, free_names, maybe_broadcast, small_batches


def row_hash(seed: int) -> Column:
    """Rows that agree in two of these, of different seeds, are judged alike by every stage."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text", F.col("lang").isNull(), "lang")


def with_keys(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two hash columns, and their names."""
    key, check = free_names(docs, "row_key", "row_check")
    return docs.withColumns({key: row_hash(1), check: row_hash(2)}), key, check


def without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """docs without the rows whose hashes are in rejected(key, check)."""
    named, key, check = with_keys(docs)
    return named.join(maybe_broadcast(rejected.select(F.col("key").alias(key), F.col("check").alias(check))), [key, check], "left_anti").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named, key, check = with_keys(docs)
    judged = quality.judge_quality(named, keep=(key, check))
    return without(docs, cut(judged.where("NOT kept").select(F.col(key).alias("key"), F.col(check).alias("check")).distinct()))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of links: the Jaccard similarity of two texts' five-word shingles is .8 or more.

    Rows of different texts that agree in the 64 bits that name them in the search are left out of it and stay.
    """
    named, key, check = with_keys(docs)
    rows = cut(named.groupBy(F.col(key).alias("key")).agg(F.min(check).alias("check"), F.max(check).alias("other"), F.count("*").alias("n")))
    groups = shingle_join.near_copies(named, id_col=key).where("doc_id <> component_id").select(F.col("doc_id").alias("key")).distinct()
    gone = cut(groups.join(rows.where("check = other").select("key", "check"), "key"))
    repeated = cut(rows.where("n > 1").join(gone.select("key"), "key", "left_anti").select(F.col("key").alias(key)))
    kept = without(docs, gone)
    if repeated.isEmpty():
        return kept
    named, key, check = with_keys(kept)
    again = maybe_broadcast(repeated)
    return named.join(again, key, "left_anti").unionByName(named.join(again, key, "left_semi").dropDuplicates([key, check])).select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that have four fifths or more of a benchmark item's shingles."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    named, key, check = with_keys(docs)
    with small_batches(spark):
        found = decontam.contaminated(named, benchmark, id_col=(key, check))
        found = cut(found.select(F.col(key).alias("key"), F.col(check).alias("check")).distinct())
    return without(docs, found)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that look live are replaced in the text; widely copied examples stay."""
    named, key, check = with_keys(docs)
    (spans,) = free_names(named, "live_spans")
    found = secrets.scan_secrets(named, keep=(key, check)).where(F.size("live") > 0)
    live = found.select(key, check, F.transform("live", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(spans)).dropDuplicates([key, check])
    joined = named.join(maybe_broadcast(cut(live)), [key, check], "left")
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(secrets.redact(F.col("text"), F.col(spans)))
    return joined.withColumn("text", text).withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with small_batches(spark):
        return cut(packing.piece_digests(packing.pack_documents(docs)))
