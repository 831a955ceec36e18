"""Quality references of all languages, held against the query's SQL."""

import random

import pytest

pytest.importorskip("quireflow.llm")
from quireflow.llm import queries, sql  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_forty_languages_have_references(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    random.seed(61)
    rows = []
    for lang in range(40):
        letters = random.sample("abcdefghijklmnopqrstuvwxyz", 12)
        words = ["".join(random.choice(letters) for _ in range(random.randrange(2, 9))) for _ in range(60)]
        for k in range(8):  # the later a language, the fewer words it has
            rows.append((lang * 10 + k, " ".join(random.choice(words) for _ in range(300 - 4 * lang)), f"l{lang:02}", "s", 1))
    rows.append((398, " ".join("".join(random.choices("|#9=", k=4)) for _ in range(70)), "l39", "s", 1))
    rows += [(1000, rows[0][1], None, "s", 1), (1001, "", "l00", "s", 1), (1002, None, "x", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_quality_divergence(spark, str(tmp_path)).toPandas()
    want = duckdb.sql(sql.quality_sql().replace("FROM documents)", f"FROM read_parquet('{tmp_path}/documents.parquet/*.parquet'))")).df()
    rows = lambda df: sorted(map(str, df[list(want.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
    by = got.set_index("doc_id").sort_index()
    assert by.loc[:398, ["class_distance", "word_distance"]].notna().all(axis=None)
    assert by.loc[:398].query("not kept").index.tolist() == [398]
    assert by.loc[1000, "kept"] and by.loc[1000, ["class_distance", "word_distance"]].isna().all()
