"""Concept units: candidates joined with sentence predictions, filtered, gated by lexicon and matrix support, ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.frames import barrier, best, lookup
from ..functions.scores import concept_importance, evidence_of, importance_of, noisy_phrase, noisy_sentence, role_of
from ..functions.text import normalize, tokens


def heuristic_predictions(sentences: DataFrame, patterns: list | None = None, cues: list | None = None, importance_cues: str | None = None) -> DataFrame:
    """Adds role, role_score, importance, evidence_score by rules: no model."""
    s = barrier(sentences, __r=role_of(F.col("text"), F.col("section"), patterns)).withColumn("role", F.col("__r.role")).withColumn("role_score", F.col("__r.score")).drop("__r")
    s = barrier(s, importance=importance_of(F.col("text"), F.col("role"), 0.0, importance_cues or rules.IMPORTANCE_CUES))
    return barrier(s, evidence_score=evidence_of(F.col("text"), F.col("role"), F.col("importance"), cues))


def merge_predictions(sentences: DataFrame, model: DataFrame) -> DataFrame:
    """Model predictions where there are any, else the rules'; a model's none takes the rules' role and the lesser score; evidence is calibrated.

    model: doc_id, sentence_index, role, role_score, evidence_score, importance.
    """
    h = heuristic_predictions(sentences)
    m = model.select("doc_id", "sentence_index", *[F.col(c).alias(f"m_{c}") for c in ("role", "role_score", "evidence_score", "importance")])
    j = h.join(m, ["doc_id", "sentence_index"], "left")
    none = F.col("m_role") == "none"
    role = F.when(F.col("m_role").isNull() | none, F.col("role")).otherwise(F.col("m_role"))
    score = F.when(none, F.least("m_role_score", "role_score")).otherwise(F.coalesce("m_role_score", "role_score"))
    j = j.withColumn("role2", role).withColumn("role_score", score).withColumn("importance", F.coalesce("m_importance", "importance")).withColumn("role", F.col("role2"))
    calibrated = F.when(noisy_sentence(F.col("text")), F.lit(0.0)).otherwise(
        F.greatest(F.coalesce("m_evidence_score", "evidence_score"), 0.75 * evidence_of(F.col("text"), F.col("role"), F.col("importance")))
    )
    return j.withColumn("evidence_score", calibrated).drop("role2", *[f"m_{c}" for c in ("role", "role_score", "evidence_score", "importance")])


def concept_units(candidates: DataFrame, predictions: DataFrame, limit: int = 112, noise: tuple[list[str] | None, list[str] | None] = (None, None)) -> DataFrame:
    """doc_id, phrase, section, role, sentence_index, evidence_sentence, unit_importance, s_rerank, ..., pool_rank.

    candidates: doc_id, sentence_index, canonical, s_rerank and other s_ columns; those whose sentence isn't there go.
    """
    p = predictions.select("doc_id", "sentence_index", "section", F.col("text").alias("evidence_sentence"), "role", "role_score", "importance", "evidence_score")
    j = candidates.withColumnRenamed("canonical", "phrase").join(p, ["doc_id", "sentence_index"])
    j = j.where(~noisy_sentence(F.col("evidence_sentence"), *noise)).withColumn("__key", normalize("phrase")).where("__key <> ''")
    order = [F.desc("unit_importance"), F.col("sentence_index"), F.col("phrase")]
    return ranked_units(best(j.withColumn("unit_importance", unit_importance()), ["doc_id", "__key"], order).drop("__key", "unit_importance"), limit)


def unit_importance() -> Column:
    return concept_importance(F.col("s_rerank"), F.col("evidence_score"), F.col("importance"))


def ranked_units(candidates: DataFrame, limit: int = 112) -> DataFrame:
    """Units of candidates that have their sentence's predictions, each phrase once in a document, with unit_importance and pool_rank."""
    j = candidates.where(~noisy_phrase(F.col("phrase"))).withColumn("unit_importance", unit_importance())
    return best(j, ["doc_id"], [F.desc("unit_importance"), F.col("sentence_index"), F.col("phrase")], "pool_rank", limit)


def threshold_trace(phrase: Column, bow_support: Column, tfidf_support: Column, thresholds: dict | None = None) -> Column:
    """struct(passed, passed_features, failed_features): a unit passes if any feature does."""
    t = thresholds or rules.THRESHOLDS
    tests = {
        "ngram_length": F.size(tokens(phrase)) >= t["phrase_word_number"],
        "bow_support": F.coalesce(bow_support, F.lit(0.0)) >= t["bow_support_score"],
        "tfidf_support": F.coalesce(tfidf_support, F.lit(0.0)) >= t["tfidf_support_score"],
    }
    named = lambda want: F.array_compact(F.array(*[F.when(c if want else ~c, F.lit(k)) for k, c in tests.items()]))
    a, b, c = tests.values()
    return F.struct((a | b | c).alias("passed"), named(True).alias("passed_features"), named(False).alias("failed_features"))


def gate(units: DataFrame, limit: int = 28, digits: int | None = 4) -> DataFrame:
    """Adds final_rank and unit_id to the units kept, and status: kept, over_limit or failed.

    units: trace and unit_importance. Order: importance (rounded to that many digits, if any), sentence, canonical.
    """
    rounded = F.col("unit_importance") if digits is None else F.round("unit_importance", digits)
    ranked = units.withColumn("passed", F.col("trace.passed"))
    from pyspark.sql import Window as W

    order = W.partitionBy("doc_id", "passed").orderBy(F.desc(rounded), F.col("sentence_index"), F.col("phrase"))
    ranked = ranked.withColumn("__r", F.row_number().over(order))
    kept = F.col("passed") & (F.col("__r") <= limit)
    return (
        ranked.withColumn("status", F.when(kept, F.lit("kept")).when(F.col("passed"), F.lit("over_limit")).otherwise(F.lit("failed")))
        .withColumn("final_rank", F.when(kept, F.col("__r")))
        .withColumn("unit_id", F.when(kept, F.format_string("ecu_%03d", F.col("__r"))))
        .drop("__r")
    )


def selection_reasons(s_candidate: Column, s_rerank: Column, role: Column, role_score: Column, evidence: Column, canonical: Column, bow: Column, trace: Column) -> Column:
    """Why a unit was chosen, in words."""
    num = lambda c: F.format_number(c, "0.####")
    return F.array_compact(
        F.array(
            F.concat(F.lit("candidate score "), num(s_candidate), F.lit(" from boundary, selector and lexicon support")),
            F.concat(F.lit("coverage-aware score "), num(s_rerank)),
            F.concat(F.lit("role "), role, F.lit(" with score "), num(role_score)),
            F.when(evidence >= 0.45, F.concat(F.lit("evidence score "), num(evidence), F.lit(" grounds it in its sentence"))),
            F.when(canonical.isNotNull(), F.concat(F.lit("matches the term "), canonical, F.lit(" with support "), num(bow))),
            F.concat(F.when(trace["passed"], F.lit("passed: ")).otherwise(F.lit("failed: ")), F.array_join(F.when(trace["passed"], trace["passed_features"]).otherwise(trace["failed_features"]), ", ")),
        )
    )


def support_type(first_cue: Column, role: Column) -> Column:
    return F.coalesce(first_cue, lookup(rules.SUPPORT_TYPES, role), F.lit("supporting_evidence"))


def payload(units: DataFrame) -> DataFrame:
    """doc_id, payload: one JSON object for each document with its kept units in order."""
    unit = F.struct(
        "final_rank", "unit_id", F.struct(F.col("phrase").alias("surface"), normalize("phrase").alias("normalized")).alias("phrase"),
        F.struct("section", "sentence_index", F.col("evidence_sentence").alias("sentence")).alias("location"),
        F.struct(F.col("role").alias("label"), F.col("role_score").alias("score")).alias("role"),
        F.struct(F.col("evidence_score").alias("score")).alias("evidence"), F.struct(F.col("unit_importance").alias("concept_unit_importance")).alias("importance"),
        F.col("trace").alias("threshold_trace"),
    )
    g = units.where("status = 'kept'").groupBy("doc_id").agg(F.array_sort(F.collect_list(unit)).alias("evidence_units"))
    return g.select("doc_id", F.to_json(F.struct(F.lit("evidence_units_v1").alias("schema_version"), "doc_id", "evidence_units")).alias("payload"))
