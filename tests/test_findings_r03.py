"""Cases of the review's third round: work that grew faster than the input, or that the compiler could not take."""

from quireflow.functions import rules
from quireflow.functions import scores as C
from quireflow.operators import candidates as K
from quireflow.operators import retrieval as V
from quireflow.operators import stats
from quireflow.plans import analysis, composed

SF = "/root/testdata/sf0.001"


def largest_method(spark, df):
    codes = df._jdf.queryExecution().debug().codegenToSeq()
    return max(codes.apply(k)._3().maxMethodCodeSize() for k in range(codes.size()))


def test_f6_code_of_note_scores_is_small_enough_to_be_compiled(spark):
    """The JVM interprets methods of over 8,000 bytes."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert largest_method(spark, composed.rule_note_scores(spark, SF)) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_f6_what_a_pattern_requires():
    assert C.required(r"\b(we|our work)\s+(aim|aims|seek)") == ["aim", "aims", "seek"]
    assert C.required(r"(a|[bc])d?") == [] and C.required(r"x(y|zz)*") == ["x"]
    assert all(C.required(p) for _, p in rules.ROLE_PATTERNS)


def test_f9_units_shuffle_only_texts(spark):
    """Candidates and their sentences are made in one pass, and windows by document need no shuffle of their own."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = analysis.concept_units(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    by_doc = [x for x in plan.splitlines() if "Exchange hashpartitioning(doc_id" in x]
    assert len(by_doc) == 1 and "REPARTITION_BY_COL" in by_doc[0] and "SortMergeJoin" not in plan


def test_f9_runs_within_a_sentence_are_those_of_the_windows(spark):
    texts = ["abcdef ab abcde, x", "ab ab", "abcdef", "(abcdef ) ab  abcdef abcdef,. ab", "é" * 6 + " éé", " abcdef"]
    s = spark.createDataFrame([(k % 2, k, t) for k, t in enumerate(texts)], "doc_id long, sentence_index int, text string")
    keys = ["doc_id", "window_id", "sentence_index", "first_pos", "surface", "s_boundary"]
    got, want = (sorted(map(tuple, d.select(*keys).collect())) for d in (K.proxy_candidates(s), K.decode(K.proxy_token_scores(s), s)))
    assert got == want and len(got) > 3


def test_f24_ngrams_are_counted_without_a_shuffle(spark):
    df = stats.top_ngrams(spark.createDataFrame([(1, "red fox blue fox. Red fox; blue cat"), (2, None), (3, "one")], "doc_id long, text string"), 2, 2)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in df.collect()] == [(1, "red fox", 2, 1), (1, "fox blue", 2, 2)]


def test_f10_cosine_joins_no_rows_and_ranks_equal_vectors_by_id(spark):
    rows = [(k, [1.0, float(k % 3), 0.1]) for k in range(60)] + [(60, [0.0, 0.0, 0.0])]
    vec = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = vec.where("vec_id < 3").selectExpr("vec_id AS query_id", "embedding AS q")
    df = V.cosine_topk(vec, q, 4)
    assert "NestedLoopJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in df.collect()) == [(a, n + 1, a + 3 * n) for a in range(3) for n in range(4)]
