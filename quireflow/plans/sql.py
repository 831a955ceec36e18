"""DuckDB building blocks of the oracle queries."""

from __future__ import annotations

SECTION_LIST = "['intro','related_work','method','experiment','conclusion']"


def norm(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^a-z0-9_+\-]+', ' ', 'g'))"


def norm_term(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9+\-]+', ' ', 'g'))"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def toks(x: str) -> str:
    """Tokens of a normalised text."""
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def grams(array: str, n: int) -> str:
    return f"list_transform(range(1, len({array}) - {n - 2}), lambda i: array_to_string({array}[i:i + {n - 1}], ' '))"


#: doc_id, sentence_index, text, section, n: sentences with positional sections.
SENT = rf"""
s0 AS (SELECT doc_id, {squeeze("coalesce(text, '')")} AS t FROM documents),
s1 AS (SELECT doc_id,
  list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+([A-Z0-9(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS p,
  list_filter(string_split(t, ' '), lambda x: x <> '') AS w FROM s0),
s2 AS (SELECT doc_id, CASE WHEN len(p) <= 1 AND len(w) > 160 THEN list_transform(range(0, len(w), 80), lambda i: array_to_string(w[i + 1:i + 80], ' ')) ELSE p END AS p FROM s1),
s3 AS (SELECT doc_id, unnest(range(len(p))) AS sentence_index, unnest(p) AS text, len(p) AS n FROM s2),
sent AS (SELECT doc_id, CAST(sentence_index AS INT) AS sentence_index, text, n,
  CASE WHEN n < 8 THEN 'intro' WHEN sentence_index / n < 0.20 THEN 'intro' WHEN sentence_index / n < 0.35 THEN 'related_work'
       WHEN sentence_index / n < 0.65 THEN 'method' WHEN sentence_index / n < 0.90 THEN 'experiment' ELSE 'conclusion' END AS section,
  CASE WHEN n < 8 THEN 'Unsectioned' ELSE NULL END AS un FROM s3)"""

#: A lexicon of the benchmark's bigrams, one term each, with attributes that follow from its spelling.
LEX = rf"""
b0 AS (SELECT item_id, {toks(norm("coalesce(text, '')"))} AS w FROM benchmark),
b1 AS (SELECT item_id, unnest({grams("w", 2)}) AS alias FROM b0),
lex AS (SELECT alias, alias AS canonical_term, count(*) AS tf, count(DISTINCT item_id) AS df, {SECTION_LIST}[1 + length(alias) % 5] AS section,
  0.55 + 0.05 * (length(alias) % 8) AS confidence, length(alias) % 3 = 0 AS is_generic FROM b1 GROUP BY alias)"""
