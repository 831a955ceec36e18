"""DuckDB SQL for the queries that it can express on whole tables."""

from __future__ import annotations


from .quality import CLASSES, SYMBOLS
from .secrets import BASE, KINDS
from .url_cascade import RULES, SPAM_TERMS

WORDS = r"list_filter(string_split_regex({x}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def url_sql() -> str:
    order = sorted(RULES, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "block", r[1:]), reverse=True)
    when = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", k, h + p) for k, h, p in order]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, _, r in when)
    kind = " ".join(f"WHEN {c} THEN '{k}'" for c, k, _ in when)
    terms = ",".join(f"'{t}'" for t in SPAM_TERMS)
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return rf"""WITH p AS (SELECT page_id, coalesce(lower(regexp_extract(url, '{parts}', 1)), '') AS host, coalesce(regexp_extract(url, '{parts}', 2), '') AS path FROM pages),
l AS (SELECT *, list_has_any(string_split_regex(host, '[._-]'), [{terms}]) AS listed FROM p)
SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule, listed, CASE {kind} WHEN listed THEN 'block' ELSE 'allow' END AS verdict FROM l"""


def secret_sql(example_owners: int = 3, example_repos: int = 10) -> str:
    def spans(kind: str, pattern: str, group: int, least: int) -> str:
        p = (pattern if group else f"({pattern})").replace("'", "''")
        return f"""SELECT uid, '{kind}' AS kind, {KINDS.index(kind)} AS rank, unnest(list_transform(range(1, len(h) + 1), lambda i: struct_pack(s := list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0), n := length(h[i]), v := v[i])), recursive := true)
  FROM (SELECT uid, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', 0) AS h, regexp_extract_all(t, '{p}', {group or 1}) AS v FROM d)"""

    base = "\n  UNION ALL ".join(f"SELECT * FROM ({spans(*x)}) WHERE length(v) >= {x[3]}" for x in BASE)
    opaque = spans("opaque", "[A-Za-z0-9+/_-]{20,}", 0, 20)
    joined = "coalesce(string_agg({what}, ',' ORDER BY s, rank), '')"
    text = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT)"
    return f"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS t FROM documents),
b AS ({base}),
o AS (SELECT * FROM ({opaque}) x WHERE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT EXISTS (SELECT 1 FROM b WHERE b.uid = x.uid AND b.s < x.s + x.n AND x.s < b.s + b.n)),
a AS (SELECT * FROM b UNION ALL SELECT * FROM o),
w AS (SELECT v FROM a JOIN d USING (uid) GROUP BY v HAVING count(DISTINCT source) >= {example_owners} OR count(DISTINCT doc_id) >= {example_repos}),
m AS (SELECT *, v IN (SELECT v FROM w) AS example FROM a), k AS (SELECT * FROM m WHERE kind <> 'opaque' OR NOT example),
x AS (SELECT uid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {joined.format(what=f"CASE WHEN kind <> 'opaque' THEN {text} END")} AS base, {joined.format(what=text)} AS spans, count(*) FILTER (NOT example) AS n_live, count(*) FILTER (example) AS n_examples FROM k GROUP BY uid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples FROM d LEFT JOIN x USING (uid)"""


CHAT = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, 13 + length(regexp_replace(role, '([\\#<\n])', '\\\1', 'g')) + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""


def containment_sql() -> str:
    grams = lambda n: f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"
    every = "\n  UNION ALL ".join(f"SELECT doc_id, {n} AS size, unnest({grams(n)}) AS g FROM d WHERE EXISTS (SELECT 1 FROM s WHERE size = {n})" for n in range(1, 6))
    return f"""WITH b AS (SELECT item_id, {WORDS.format(x="lower(coalesce(text, ''))")} AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, least(5, len(w)) AS size, unnest(CASE WHEN len(w) >= 5 THEN {grams(5)} ELSE [array_to_string(w, ' ')] END) AS g FROM b WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS item_shingles FROM s GROUP BY item_id),
d AS (SELECT doc_id, {WORDS.format(x="lower(coalesce(text, ''))")} AS w FROM documents),
g AS ({every}), h AS (SELECT DISTINCT doc_id, item_id, g FROM g JOIN s USING (size, g)),
c AS (SELECT doc_id, item_id, count(*) AS shared FROM h GROUP BY ALL)
SELECT doc_id, item_id, shared, item_shingles, shared / item_shingles AS containment FROM c JOIN n USING (item_id) WHERE shared >= CAST(0.8 AS DOUBLE) * item_shingles"""


def quality_sql(top_words: int = 12, max_word_chars: int = 4) -> str:
    """Two rounds of references; bins that a document lacks add half their share in the reference."""
    classes = [p.replace("'", "''") for p in CLASSES.values()]
    counted = ", ".join(f"length(j) - length(regexp_replace(j, '{p}', '', 'g')) AS c{k}" for k, p in enumerate(classes))
    listed = [f"SELECT uid, lang, 'c' AS kind, '{k}' AS bin, c{k} AS n, word_chars AS total FROM c" for k in range(len(classes))]
    listed.append(f"SELECT uid, lang, 'c', 'rest', word_chars - ({' + '.join(f'c{k}' for k in range(len(classes)))}), word_chars FROM c")

    def stage(name: str, near: str) -> str:
        return f"""r{name} AS (SELECT lang, kind, bin, sum(n) AS r FROM bins SEMI JOIN {near} USING (uid) GROUP BY ALL), t{name} AS (SELECT lang, kind, sum(r) AS t FROM r{name} GROUP BY ALL),
p{name} AS (SELECT uid, kind, n / total AS p, coalesce(r, 0) / t AS q FROM bins JOIN t{name} USING (lang, kind) LEFT JOIN r{name} USING (lang, kind, bin)),
s{name} AS (SELECT uid, kind, sqrt(greatest(CAST(0 AS DOUBLE), sum((p * log2(p / ((p + q) / 2)) + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2) + (1 - sum(q)) / 2)) AS js FROM p{name} GROUP BY ALL),
j{name} AS (SELECT uid, coalesce(max(js) FILTER (kind = 'c'), 0) AS cd, coalesce(max(js) FILTER (kind = 'w'), 0) AS wd FROM ok LEFT JOIN s{name} USING (uid) GROUP BY uid),
k{name} AS (SELECT uid, CASE WHEN lang <> '?' AND word_chars >= 120 THEN cd END AS class_distance, CASE WHEN lang <> '?' AND n_words >= 60 THEN wd END AS word_distance FROM c JOIN j{name} USING (uid)),
n{name} AS (SELECT uid FROM k{name} JOIN c USING (uid) WHERE NOT failed AND NOT coalesce(class_distance > CAST(0.21 AS DOUBLE) + CAST(2.2 AS DOUBLE) / sqrt(word_chars), false) AND NOT coalesce(word_distance > CAST(0.26 AS DOUBLE) + CAST(1.6 AS DOUBLE) / sqrt(n_words), false))"""

    return rf"""WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(lang, '?') AS lang, coalesce(text, '') AS t FROM documents), w AS (SELECT *, {WORDS.format(x="t")} AS w FROM d), a AS (SELECT *, array_to_string(w, '') AS j FROM w),
g AS (SELECT uid, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w),
x AS (SELECT uid, i, i - lag(i, 1, -9) OVER (PARTITION BY uid ORDER BY i) AS step FROM (SELECT *, count(*) OVER (PARTITION BY uid, g) AS k FROM g) WHERE k > 1), rep AS (SELECT uid, CAST(sum(least(5, step)) AS BIGINT) AS n_repeat_words FROM x GROUP BY uid),
l AS (SELECT uid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l FROM d),
c0 AS (SELECT uid, doc_id, lang, len(w) AS n_words, length(j) AS word_chars, length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, {counted} FROM a JOIN l USING (uid) LEFT JOIN rep USING (uid)),
c AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed FROM c0),
v AS (SELECT lang, lower(x) AS word, count(*) AS n FROM (SELECT lang, unnest(string_split_regex(lower(t), '[ 	-
]+')) AS x FROM d) WHERE length(x) BETWEEN 1 AND {max_word_chars} GROUP BY ALL),
voc AS (SELECT DISTINCT word FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS k FROM v) WHERE k <= {top_words}),
u AS (SELECT uid, lower(x) AS word FROM (SELECT uid, unnest(w) AS x FROM w) WHERE length(x) <= {max_word_chars}), uw AS (SELECT uid, word, count(*) AS n FROM u SEMI JOIN voc USING (word) GROUP BY ALL), uo AS (SELECT uid, sum(n) AS n FROM uw GROUP BY uid),
bins AS (SELECT * FROM ({" UNION ALL ".join(listed)} UNION ALL SELECT uid, lang, 'w', word, n, n_words FROM uw JOIN c USING (uid) UNION ALL SELECT uid, lang, 'w', chr(1), n_words - coalesce(n, 0), n_words FROM c LEFT JOIN uo USING (uid)) WHERE n > 0),
ok AS (SELECT uid FROM c), z AS (SELECT uid FROM c WHERE NOT failed),
{stage("1", "z")},
{stage("2", "n1")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance, uid IN (SELECT uid FROM n2) AS kept FROM c JOIN k2 USING (uid)"""


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_divergence": quality_sql(), "op2_url_cascade": url_sql(), "op3_secret_ownership": secret_sql(), "op5_chat_schema": CHAT, "op9_minhash_containment": containment_sql()}
