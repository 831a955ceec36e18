"""Queries of the corpus operators, with SQL where it can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, packing, quality, secrets, simhash_bk, sql, toxicity, url_cascade, wrapper
from .common import table


def op1_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack_documents(table(spark, sf_dir, "documents")))


def op2_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.filter_urls(table(spark, sf_dir, "pages"))


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        F.size("examples").cast("long").alias("n_examples"),
    )


def op4_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_bk.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_chat_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_records(chat.conversation_records(turns.unionByName(more))))


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.fold(F.col("doc_id"), 4) == 2
    out = langid.identify_languages(docs, learn=~held)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, sf_dir, "documents"), keep=("doc_id",))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op8_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wrapper.extract_main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pattern_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = langid.fold(F.col("doc_id"), 5) == 0
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=~held)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_cost_packing, op2_url_cascade, op3_secret_ownership, op4_simhash_bktree, op5_chat_schema, op6_cross_parsing,
        op7_quality_divergence, op8_wrapper_induction, op9_minhash_containment, op10_pattern_grammar, pipeline,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
