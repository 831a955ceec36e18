"""Cases of the review's first round in which a query did less than its whole job."""

import random

from quireflow.operators import labels as B
from quireflow.operators import retrieval as V
from quireflow.plans import analysis


def test_greedy_oracle_labels_all_sentences(spark, tmp_path):
    random.seed(31)
    sentence = lambda: " ".join(random.choice("abcdefghij") * 4 for _ in range(9)).capitalize() + "."
    s = [sentence() for _ in range(70)]
    s[55] = s[1]
    s[60] = s[1].replace(".", " more.")
    spark.createDataFrame([(1, " ".join(s))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["sentence_index"]: r["label"] for r in analysis.greedy_oracle(spark, str(tmp_path)).collect()}
    words = [B.rouge_words(x) for x in s]
    best = max(range(70), key=lambda k: (B.rouge_l(words[k], words[1]), -k))
    assert len(got) == 70 and [k for k in got if got[k]] == [best]


def test_cosine_topk_takes_any_number_of_queries(spark):
    random.seed(32)
    rows = [(k, [random.random() - 0.5 for _ in range(4)]) for k in range(40)]
    vec = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = vec.selectExpr("vec_id AS query_id", "embedding AS q")
    whole = sorted(tuple(r) for r in V.cosine_topk(vec, queries, 3).collect())
    assert sorted(tuple(r) for r in V.cosine_topk(vec, queries, 3, max_queries=12).collect()) == whole and len(whole) == 120
