"""The fixed rules over composed sentences: every rule is met, and both engines agree."""

from __future__ import annotations

import duckdb
import pytest

from quireflow.functions import rules
from quireflow.plans import composed, registry

SF = "/root/testdata/sf0.001"


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr([round(float(v), 9) if isinstance(v, float) else v for v in r]) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", ["rule_predictions", "rule_noise", "rule_note_scores", "cross_note_scores", "merged_predictions", "split_summary", "request_routes"])
def test_engines_agree(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = rows(registry.queries()[name](spark, SF).toPandas())
    assert got and got == rows(con.execute(registry.oracle_sql()[name]).df())


def test_every_role_pattern_and_domain_is_met(spark):
    got = composed.QUERIES["rule_predictions"](spark, SF).toPandas()
    assert set(got.role) >= {r for r, _ in rules.ROLE_PATTERNS}
    assert set(got.role_score) == {0.82, 0.66, 0.45} and {0.62, 0.58, 0.48} <= set(got.evidence_score)
    domains = set(composed.QUERIES["rule_domains"](spark, SF).toPandas().domain)
    assert domains == {name for name, _ in rules.DOMAINS}


def test_noise_and_notes_vary(spark):
    noisy = composed.QUERIES["rule_noise"](spark, SF).toPandas().noisy
    assert 0 < noisy.sum() < len(noisy)
    scores = composed.QUERIES["cross_note_scores"](spark, SF).toPandas()
    assert all(scores[s].nunique() > 5 for s in rules.SECTIONS) and (scores.conclusion == 0).any()


def test_whole_chain_by_hand(spark):
    """Importance comes from the re-ranked score; the gate counts the matrix; order is by importance of four digits."""
    from quireflow.plans import analysis

    u = analysis.chain(spark, SF).toPandas()
    scored = u[["s_rerank", "evidence_score", "unit_importance"]]
    assert len(u) and (u.s_rerank < u.s_candidate).any() and scored.notna().all().all()
    by_tfidf = u[(u.tfidf_support >= 0.5)]
    assert len(by_tfidf) and (by_tfidf.status != "failed").all()
    for _, d in u[u.status == "kept"].groupby("doc_id"):
        d = d.assign(o=d.unit_importance.round(4)).sort_values("final_rank")
        assert d.final_rank.tolist() == list(range(1, len(d) + 1)) and len(d) <= 28
        assert d.o.tolist() == sorted(d.o, reverse=True)
        assert d.sort_values(["o", "sentence_index", "phrase"], ascending=[False, True, True]).final_rank.tolist() == d.final_rank.tolist()
