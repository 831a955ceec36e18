"""Batch reports, section coverage and card diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.frames import best

GENERIC_PHRASES = ["base model", "large model", "small model", "beam size", "beam search", "learning rate", "dropout rate", "tagging task", "downstream task", "feature-based approach"]
SHORT_PHRASES = "qa nq em f1 rnn cnn gan bert bart dpr gpt bm25 squad".split()


def section_counts(sentences: DataFrame) -> DataFrame:
    """doc_id, sentences, one count for each section, present."""
    per = sentences.groupBy("doc_id").agg(F.count("*").alias("sentences"), *[F.count_if(F.col("section") == s).alias(s) for s in rules.SECTIONS])
    return per.withColumn("present", sum((F.col(s) > 0).cast("int") for s in rules.SECTIONS))


def coverage_summary(counts: DataFrame) -> DataFrame:
    """kind, key, n: documents by number of sections present, documents that lack a section, and low coverage."""
    present = counts.groupBy(F.col("present").cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit("present").alias("kind"), "key", "n")
    low = (F.col("present") <= 2) | (F.col("method") == 0) | (F.col("experiment") == 0)
    sums = counts.agg(*[F.count_if(F.col(s) == 0).alias(s) for s in rules.SECTIONS], F.count_if(low).alias("low"))
    rows = F.array(*[F.struct(F.lit("missing").alias("kind"), F.lit(s).alias("key"), F.col(s).alias("n")) for s in rules.SECTIONS], F.struct(F.lit("low_coverage").alias("kind"), F.lit("").alias("key"), F.col("low").alias("n")))
    return present.unionByName(sums.select(F.inline(rows)))


def batch_report(files: DataFrame) -> DataFrame:
    """total, ok, failed, avg_units, min_units, max_units. files: doc_id, status, units (null where it failed)."""
    ok = F.col("status") == "ok"
    return files.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.coalesce(F.avg(F.when(ok, F.col("units"))), F.lit(0.0)).alias("avg_units"),
        F.coalesce(F.min(F.when(ok, F.col("units"))), F.lit(0)).alias("min_units"), F.coalesce(F.max(F.when(ok, F.col("units"))), F.lit(0)).alias("max_units"),
    )


def looks_noisy(phrase: Column) -> Column:
    p = F.trim(F.lower(phrase))
    t = F.split(p, r"\s+")
    odd = ((F.size(t) == 1) & (F.length(p) <= 3)) | F.arrays_overlap(t, F.array(*map(F.lit, ["eos", "pad", "cls", "sep", "tok"])))
    odd = odd | (F.size(F.filter(t, lambda w: w.rlike("^[0-9]+$"))) >= 2) | p.rlike(r"\b[a-z]\s+\d+\b")
    return (p == "") | (~p.isin(SHORT_PHRASES) & odd)


def risk_report(docs: DataFrame, units: DataFrame, notes: DataFrame) -> DataFrame:
    """doc_id, units, empty_notes, no_units, noisy, generic, long_evidence, appendix_like, coverage_score, risk_score for every document."""
    appendix = F.col("evidence_sentence").rlike(r"(?i)\b(reference|appendix|best viewed|visualization|figure|table)\b")
    u = units.groupBy("doc_id").agg(
        F.count("*").alias("units"), F.collect_set("section").alias("u_sections"), F.count_if(looks_noisy(F.col("phrase"))).alias("noisy"),
        F.count_if(F.trim(F.lower("phrase")).isin(GENERIC_PHRASES)).alias("generic"), F.count_if(F.size(F.split("evidence_sentence", r"\s+")) > 75).alias("long_evidence"), F.count_if(appendix).alias("appendix_like"),
    )
    n = notes.where(F.size("notes") > 0).groupBy("doc_id").agg(F.collect_set("section").alias("n_sections"))
    none = F.array().cast("array<string>")
    d = docs.select("doc_id").join(u, "doc_id", "left").join(n, "doc_id", "left").fillna(0, ["units", "noisy", "generic", "long_evidence", "appendix_like"])
    d = d.withColumn("u_sections", F.coalesce("u_sections", none)).withColumn("n_sections", F.coalesce("n_sections", none))
    every = F.array(*map(F.lit, rules.SECTIONS))
    d = d.withColumn("empty_notes", F.size(F.array_except(every, "n_sections"))).withColumn("no_units", F.size(F.array_except(every, "u_sections")))
    both = F.size(F.array_intersect(F.array_intersect("u_sections", "n_sections"), every)) / len(rules.SECTIONS)
    risk = 2.0 * F.col("empty_notes") + 1.5 * F.col("no_units") + 0.5 * F.col("noisy") + 0.6 * F.col("generic") + 0.4 * F.col("long_evidence") + 0.8 * F.col("appendix_like")
    return d.select("doc_id", "units", "empty_notes", "no_units", "noisy", "generic", "long_evidence", "appendix_like", both.alias("coverage_score"), risk.alias("risk_score"))


def top_roles(units: DataFrame, limit: int = 3) -> DataFrame:
    """doc_id, section, role, n, rank: a section's most frequent roles."""
    c = units.groupBy("doc_id", "section", "role").agg(F.count("*").alias("n"), F.min("pool_rank").alias("first"))
    return best(c, ["doc_id", "section"], [F.desc("n"), F.col("first"), F.col("role")], "rank", limit).select("doc_id", "section", "role", "n", "rank")
