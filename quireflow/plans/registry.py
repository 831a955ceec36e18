"""All queries and their oracle SQL."""

from __future__ import annotations

import re

from . import analysis, composed, core, helpers


def doubles(sql: str) -> str:
    """Decimal literals outside strings as doubles, so that both engines do the same arithmetic."""
    return re.sub(r"'(?:[^']|'')*'|(?<![\w.])\d+\.\d+(?![\w.])", lambda m: m[0] if m[0][0] == "'" else f"CAST({m[0]} AS DOUBLE)", sql)


#: DuckDB counts rows by rank as BIGINT and sums flags as HUGEINT; results take the types that Spark gives.
TYPES = {
    "INTEGER": "top_unigrams.rank top_bigrams.rank top_trigrams.rank dictionary_hits.rank cue_hits.rank concept_units.pool_rank stage3_gate.final_rank kg_terms.rank kg_edges.edge_rank cosine_topk.rank top_roles.rank",
    "BIGINT": (
        "noisy_sentence_filter.noisy threshold_sweep.tp threshold_sweep.fp threshold_sweep.fn binary_counts.tp binary_counts.fp binary_counts.fn binary_counts.tn "
        "label_counts.positive label_counts.negative section_coverage.n batch_report.min_units batch_report.max_units"
    ),
}


def typed(name: str, sql: str) -> str:
    casts = [f"CAST({x.split('.')[1]} AS {kind}) AS {x.split('.')[1]}" for kind, xs in TYPES.items() for x in xs.split() if x.split(".")[0] == name]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql}) x" if casts else sql


def queries() -> dict:
    return {**core.QUERIES, **analysis.QUERIES, **composed.QUERIES, **helpers.QUERIES}


def oracle_sql() -> dict:
    return {k: typed(k, doubles(v)) for k, v in {**core.SQL, **analysis.SQL, **composed.SQL, **helpers.SQL}.items()}
