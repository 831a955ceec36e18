"""Queries that run the fixed rules themselves, over sentences that each begin with a phrase of those rules.

The tables' prose has none of the rules' words, so each sentence is given one: the phrase of number
(doc_id + sentence_index) modulo their count. Other characters than printable ASCII become spaces, as engines
disagree on word borders beside them.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scores as C
from ..functions import text as T
from ..functions.frames import load
from ..operators import candidates as K
from ..operators import cards
from ..operators import graph as G
from ..operators import labels as B
from ..operators import lexicon as L
from ..operators import stats
from ..operators import units as U
from . import sql as Q
from .analysis import WEIGHT_SQL, any_sql, role_sql
from .core import bench_terms, query_into, sents

QUERIES: dict = {}
SQL: dict = {}
query = query_into(QUERIES, SQL)


def examples(pattern: str) -> list[str]:
    """Texts that a role pattern matches: each alternative of its last group after the first of those before."""
    groups = [g.split("|") for g in re.findall(r"\(([^()]*)\)", pattern)]
    return [" ".join([*(g[0] for g in groups[:-1]), last]) for last in groups[-1]]


def listed(table: dict[str, list[str]]) -> list[str]:
    return [c for cues in table.values() for c in cues]


PHRASES = list(dict.fromkeys([
    *(e for _, p in rules.ROLE_PATTERNS for e in examples(p)), *(c for _, cues in rules.EVIDENCE_CUES for c in cues), *examples(rules.IMPORTANCE_CUES),
    *listed(rules.GOOD_CUES), *listed(rules.BAD_CUES), *listed(rules.BACKFILL_CUES), *rules.CONCLUSION_STARTS, *rules.CONCLUSION_ANYWHERE, *rules.NOISE_CUES,
    *rules.SHORT_CUES, "title", "title core contributors", "such as and", "eos pad pad eos", "code we used to train and evaluate in this work",
]))
TERMS = list(dict.fromkeys(c for _, cues in rules.DOMAINS for c in cues))


def array_sql(values: list[str]) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


def composed(spark, sf_dir, phrases=PHRASES):
    """sents() with text begun by a phrase."""
    at = (F.col("doc_id") + F.col("sentence_index")) % len(phrases) + 1
    text = F.concat(F.element_at(F.array(*map(F.lit, phrases)), at.cast("int")), F.lit(" "), F.regexp_replace("text", "[^ -~]", " "))
    return sents(spark, sf_dir).withColumn("sentence_index", F.col("sentence_index").cast("int")).withColumn("text", text)


def comp_sql(phrases: list[str] = PHRASES) -> str:
    return f"""{Q.SENT}, comp AS (SELECT doc_id, sentence_index, section, n, {array_sql(phrases)}[1 + (doc_id + sentence_index) % {len(phrases)}] || ' ' || regexp_replace(text, '[^ -~]', ' ', 'g') AS text FROM sent)"""


COMP = comp_sql()


def evidence_sql(role: str = "role", importance: str = "importance") -> str:
    found = [f"CASE WHEN {any_sql('lower(text)', w)} THEN {s} ELSE 0.0 END" for s, w in rules.EVIDENCE_CUES]
    return f"least(1.0, greatest({', '.join(found)}, CASE WHEN {role} IN ({array_sql(rules.EVIDENCE_ROLES)[1:-1]}) THEN 0.35 ELSE 0.0 END, CASE WHEN {importance} >= 0.72 THEN 0.32 ELSE 0.0 END))"


PRED = f"""{COMP}, pr AS (SELECT *, string_split({role_sql(rules.ROLE_PATTERNS)}, '|') AS rs FROM comp), pq AS (SELECT * EXCLUDE (rs), rs[1] AS role, CAST(rs[2] AS DOUBLE) AS role_score FROM pr),
pi AS (SELECT *, least(1.0, greatest(0.0, CAST({WEIGHT_SQL} AS DOUBLE) + CASE WHEN regexp_matches(text, '(?i){rules.IMPORTANCE_CUES}') THEN 0.08 ELSE 0.0 END)) AS importance FROM pq),
pred AS (SELECT *, {evidence_sql()} AS evidence_score, {Q.norm('text')} AS nt FROM pi)"""


def noisy_sql(n: str = "nt") -> str:
    plain, code = ([c for c in rules.NOISE_CUES if c.startswith("code") is k] for k in (False, True))
    words = f"string_split({n}, ' ')"
    return (
        f"({n} = '' OR ({n} LIKE 'title %' AND len({words}) <= 12) OR {n} LIKE 'title core contributors%' OR regexp_matches({n}, '\\bsuch as and\\b') OR {any_sql(n, plain)} "
        f"OR ({any_sql(n, code)} AND NOT {any_sql(n, rules.CODE_EXEMPTIONS)}) OR (len({words}) < 8 AND NOT {any_sql(n, rules.SHORT_CUES)}) "
        f"OR len(list_filter({words}, lambda w: w IN ('eos', 'pad'))) / len({words}) > 0.08)"
    )


def sectioned_sql(table: dict[str, list[str]], test) -> str:
    return "(" + " OR ".join(f"(section = '{s}' AND {test(v)})" for s, v in table.items()) + ")"


def in_sql(column: str, values: list[str]) -> str:
    return f"{column} IN ({array_sql(values)[1:-1]})"


def rule_sentences(spark, sf_dir):
    return U.heuristic_predictions(composed(spark, sf_dir))


@query(f"WITH {PRED} SELECT doc_id, sentence_index, role, role_score, importance, evidence_score FROM pred")
def rule_predictions(spark, sf_dir):
    return rule_sentences(spark, sf_dir).select("doc_id", "sentence_index", "role", "role_score", "importance", "evidence_score")


@query(f"WITH {COMP} SELECT doc_id, sentence_index, {noisy_sql(Q.norm('text'))} AS noisy FROM comp")
def rule_noise(spark, sf_dir):
    return composed(spark, sf_dir).select("doc_id", "sentence_index", C.noisy_sentence(F.col("text")).alias("noisy"))


@query(f"""WITH {PRED} SELECT doc_id, sentence_index, least(1.0, greatest(0.0, least(1.0, greatest(0.0, 0.46 * importance + 0.34 * evidence_score
  + CASE WHEN {sectioned_sql(rules.NOTE_ROLES, lambda v: in_sql('role', v))} THEN 0.18 ELSE -0.16 END + CASE WHEN {sectioned_sql(rules.GOOD_CUES, lambda v: any_sql('nt', v))} THEN 0.12 ELSE 0.0 END
  - CASE WHEN {sectioned_sql(rules.BAD_CUES, lambda v: any_sql('nt', v))} THEN 0.22 ELSE 0.0 END - CASE WHEN len(string_split(nt, ' ')) < 10 THEN 0.10 ELSE 0.0 END)))) AS score FROM pred""")
def rule_note_scores(spark, sf_dir):
    score = C.note_score(*map(F.col, ("section", "text", "role", "importance", "evidence_score")))
    return rule_sentences(spark, sf_dir).select("doc_id", "sentence_index", score.alias("score"))


#: Shares of a document in which a sentence fits a section better, and by how much.
PLACES = {"conclusion": ("pos >= 0.68", 0.12), "related_work": ("pos <= 0.45", 0.08), "experiment": ("pos >= 0.45", 0.08), "method": ("pos BETWEEN 0.15 AND 0.70", 0.08)}


def cross_sql(target: str) -> str:
    def plus(condition: str, x: float) -> str:
        return f"CASE WHEN {condition} THEN {x} ELSE 0.0 END"

    terms = [f"0.22 * importance + 0.22 * evidence_score + {plus(in_sql('role', rules.NOTE_ROLES[target]), 0.26)}"]
    terms.append(plus(any_sql("nt", rules.BACKFILL_CUES[target]) if target in rules.BACKFILL_CUES else "false", 0.20))
    terms += [plus(*PLACES[target])] if target in PLACES else []
    total = " + ".join(terms) + (f" - {plus("nt LIKE 'title %'", 0.50)}" if target != "intro" else "")
    score = f"least(1.0, greatest(0.0, {total} - {plus("len(string_split(nt, ' ')) < 10", 0.08)}))"
    if target != "conclusion":
        return score
    starts = " OR ".join(f"starts_with(nt, '{c}')" for c in rules.CONCLUSION_STARTS)
    return f"CASE WHEN {starts} OR {any_sql('nt', rules.CONCLUSION_ANYWHERE)} THEN {score} ELSE 0.0 END"


@query(f"WITH {PRED}, pp AS (SELECT *, sentence_index / greatest(n, 1) AS pos FROM pred) SELECT doc_id, sentence_index, {', '.join(f'{cross_sql(s)} AS {s}' for s in rules.SECTIONS)} FROM pp")
def cross_note_scores(spark, sf_dir):
    position = F.col("sentence_index") / F.greatest(F.col("n_sentences"), F.lit(1))
    scores = [C.cross_note_score(s, F.col("text"), position, F.col("role"), F.col("importance"), F.col("evidence_score")).alias(s) for s in rules.SECTIONS]
    return rule_sentences(spark, sf_dir).select("doc_id", "sentence_index", *scores)


@query(f"""WITH {comp_sql(TERMS)} SELECT doc_id, sentence_index, CASE {" ".join(f"WHEN {any_sql(Q.norm('text'), cues)} THEN '{name}'" for name, cues in rules.DOMAINS)} ELSE 'Other' END AS domain FROM comp""")
def rule_domains(spark, sf_dir):
    d = composed(spark, sf_dir, TERMS).select("doc_id", "sentence_index", T.normalize("text").alias("key"))
    return d.select("doc_id", "sentence_index", C.domain_of(F.col("key"), F.lit("")).alias("domain"))


#: Every third sentence has a model's prediction; every sixth of all sentences has none as role.
MODEL = "(doc_id + sentence_index) % 3 = 0"


@query(f"""WITH {PRED}, mo AS (SELECT *, {MODEL} AS has, (doc_id + sentence_index) % 6 = 0 AS none FROM pred),
mm AS (SELECT doc_id, sentence_index, text, nt, CASE WHEN has AND NOT none THEN 'result' ELSE role END AS role, CASE WHEN has AND none THEN least(0.6, role_score) WHEN has THEN 0.6 ELSE role_score END AS role_score,
  CASE WHEN has THEN (sentence_index % 10) / 10.0 ELSE importance END AS importance, CASE WHEN has THEN (doc_id % 10) / 20.0 ELSE evidence_score END AS e FROM mo)
SELECT doc_id, sentence_index, role, role_score, importance, CASE WHEN {noisy_sql()} THEN 0.0 ELSE greatest(e, 0.75 * {evidence_sql()}) END AS evidence_score FROM mm""")
def merged_predictions(spark, sf_dir):
    s = composed(spark, sf_dir)
    role = F.when((F.col("doc_id") + F.col("sentence_index")) % 6 == 0, F.lit("none")).otherwise(F.lit("result"))
    model = s.where(MODEL).select("doc_id", "sentence_index", role.alias("role"), F.lit(0.6).alias("role_score"), ((F.col("doc_id") % 10) / 20).alias("evidence_score"), ((F.col("sentence_index") % 10) / 10).alias("importance"))
    return U.merge_predictions(s, model).select("doc_id", "sentence_index", "role", "role_score", "importance", "evidence_score")


@query(f"""WITH {PRED}, t AS (SELECT doc_id, CASE WHEN sentence_index % 5 = 0 THEN 'claim' ELSE CASE role {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.SUPPORT_TYPES.items())} ELSE 'supporting_evidence' END END AS support_type FROM pred)
SELECT doc_id, support_type, count(*) AS n FROM t GROUP BY ALL""")
def support_types(spark, sf_dir):
    cue = F.when(F.col("sentence_index") % 5 == 0, F.lit("claim"))
    return rule_sentences(spark, sf_dir).groupBy("doc_id", U.support_type(cue, F.col("role")).alias("support_type")).agg(F.count("*").alias("n"))


@query(f"""WITH {Q.SENT}, w AS (SELECT doc_id, sentence_index, ((doc_id * 31 + sentence_index * 17 + k * 13) % 97) / 97 AS p FROM sent, (VALUES (0), (1), (2)) v(k)),
m AS (SELECT doc_id, sentence_index, max(p) AS p FROM w GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, sentence_index) AS INT) AS rank FROM m) SELECT * FROM r WHERE rank <= 5""")
def sentence_selection(spark, sf_dir):
    """Scores of three windows, made from the numbers of document and sentence."""
    s = sents(spark, sf_dir).select("doc_id", F.col("sentence_index").cast("int"), F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    return K.sentence_selection(s.withColumn("p", (F.col("doc_id") * 31 + F.col("sentence_index") * 17 + F.col("k") * 13) % 97 / 97))


HITS = f"""{Q.LEX}, {Q.SENT}, g AS (SELECT DISTINCT doc_id, sentence_index, own, alias FROM (SELECT doc_id, sentence_index, section AS own, unnest({Q.grams('w', 2)}) AS alias FROM (SELECT *, {Q.toks(Q.norm('text'))} AS w FROM sent))),
hr AS (SELECT doc_id, sentence_index, own, canonical_term, confidence, row_number() OVER (PARTITION BY doc_id, sentence_index ORDER BY CASE WHEN section = own THEN 1 ELSE 0 END DESC, confidence DESC, tf DESC, canonical_term, section) AS rank FROM g JOIN lex USING (alias) WHERE confidence >= 0.65),
hit AS (SELECT doc_id, sentence_index, own AS section, canonical_term, confidence FROM hr WHERE rank <= 8)"""


@query(f"""WITH {HITS}, per AS (SELECT doc_id, section, count(*) AS sentence_count, CAST(sum(len({Q.toks(Q.norm('text'))})) AS BIGINT) AS token_count FROM sent GROUP BY ALL),
t AS (SELECT doc_id, section, canonical_term, count(*) AS hits, max(confidence) AS confidence, min(sentence_index) AS example FROM hit GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY hits DESC, confidence DESC, canonical_term) AS rank FROM t),
tops AS (SELECT doc_id, section, string_agg(canonical_term || ':' || hits || ':' || example, ',' ORDER BY rank) AS top_terms FROM r WHERE rank <= 12 GROUP BY ALL),
c AS (SELECT doc_id, section, CAST(sum(hits) AS BIGINT) AS hit_count FROM t GROUP BY ALL)
SELECT doc_id, section, sentence_count, token_count, coalesce(hit_count, 0) AS hit_count, coalesce(top_terms, '') AS top_terms FROM per LEFT JOIN c USING (doc_id, section) LEFT JOIN tops USING (doc_id, section)""")
def section_profiles(spark, sf_dir):
    s = sents(spark, sf_dir).withColumn("sentence_index", F.col("sentence_index").cast("int"))
    hits = L.sentence_hits(s, bench_terms(spark, sf_dir), ["doc_id", "sentence_index"]).select("doc_id", "sentence_index", "canonical_term", "confidence")
    line = lambda x: F.concat_ws(":", x["canonical_term"], x["hits"].cast("string"), x["example"].cast("string"))
    out = stats.section_profiles(s, hits)
    return out.withColumn("top_terms", F.coalesce(F.array_join(F.transform("top_terms", line), ","), F.lit("")))


@query(f"""WITH s AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE 'train' END AS split FROM ({f"WITH {PRED} SELECT * FROM pred"})),
r AS (SELECT split, string_agg(role || '=' || n, ',' ORDER BY role) AS role_counts FROM (SELECT split, role, count(*) AS n FROM s GROUP BY ALL) GROUP BY split),
c AS (SELECT split, string_agg(section || '=' || n, ',' ORDER BY section) AS section_counts FROM (SELECT split, section, count(*) AS n FROM s GROUP BY ALL) GROUP BY split),
b AS (SELECT split, count(DISTINCT doc_id) AS documents, count(*) AS sentences, count_if(evidence_score >= 0.5) AS evidence_positive, count_if(sentence_index % 2 = 0) AS importance_labeled, count_if(sentence_index % 2 = 0 AND importance >= 0.5) AS importance_positive FROM s GROUP BY split)
SELECT split, documents, sentences, CAST(evidence_positive AS BIGINT) AS evidence_positive, CAST(importance_labeled AS BIGINT) AS importance_labeled, CAST(importance_positive AS BIGINT) AS importance_positive, role_counts, section_counts FROM b JOIN r USING (split) JOIN c USING (split)""")
def split_summary(spark, sf_dir):
    """Rule predictions as labels; importance is labelled on every other sentence."""
    s = rule_sentences(spark, sf_dir).withColumns({
        "split": F.when(F.col("doc_id") % 10 == 0, F.lit("test")).otherwise(F.lit("train")), "evidence_label": F.col("evidence_score"), "importance_label": F.when(F.col("sentence_index") % 2 == 0, F.col("importance")),
    })
    flat = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    out = B.split_summary(s)
    return out.withColumns({c: flat(c) for c in ("role_counts", "section_counts")})


@query("""WITH k AS (SELECT lang, source, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE doc_id % 5 END AS n, doc_id % 4 = 0 AS tags FROM documents)
SELECT lang AS split, count(*) AS documents, CAST(count_if(n > 0) AS BIGINT) AS with_keyphrases, avg(n) AS avg_keyphrases, CAST(count_if(tags) AS BIGINT) AS with_source_bio, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources FROM k GROUP BY lang""")
def keyphrase_summary(spark, sf_dir):
    """Each document has doc_id modulo 5 keyphrases, every third none; every fourth has tags."""
    n = (F.col("doc_id") % 5).cast("int")
    some = F.when(F.col("doc_id") % 3 != 0, F.array_repeat(F.lit("phrase"), n))
    r = load(spark, sf_dir, "documents").select(F.col("lang").alias("split"), some.alias("keyphrases"), F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("B"))).alias("source_bio_tags"), F.col("source").alias("keyphrase_source"))
    return B.keyphrase_summary(r).withColumn("sources", F.array_join("sources", ","))


@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN NULL ELSE conv_id END AS doc_id, (conv_id + turn) % 5 = 0 AS units FROM conversations), k AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 2 = 0)
SELECT conv_id, turn, CASE WHEN units THEN 'evidence' WHEN r.doc_id IS NULL THEN 'invalid' WHEN k.doc_id IS NOT NULL THEN 'vector' ELSE 'not_found' END AS plan FROM r LEFT JOIN k USING (doc_id)""")
def request_routes(spark, sf_dir):
    """Turns as requests for the document of their conversation's number; even documents have chunks."""
    given = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.array(F.lit("unit"))).otherwise(F.array().cast("array<string>"))
    r = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("conv_id") % 7 != 0, F.col("conv_id")).alias("doc_id"), given.alias("evidence_units"))
    return cards.route_requests(r, load(spark, sf_dir, "documents").where("doc_id % 2 = 0")).select("conv_id", "turn", "plan")


@query(f"""WITH {HITS}, nodes AS (SELECT DISTINCT doc_id, section AS domain, canonical_term FROM hit), ch AS (SELECT doc_id, domain, canonical_term AS source, lead(canonical_term) OVER (PARTITION BY doc_id, domain ORDER BY length(canonical_term), canonical_term) AS target FROM nodes)
SELECT doc_id, domain, source, target FROM ch WHERE target IS NOT NULL AND length(source) <> length(target)""")
def related_terms(spark, sf_dir):
    """Terms of a section in the order of their length; those of one length next to each other count as joined already."""
    s = sents(spark, sf_dir).withColumn("sentence_index", F.col("sentence_index").cast("int"))
    hits = L.sentence_hits(s, bench_terms(spark, sf_dir), ["doc_id", "sentence_index"]).select("doc_id", "sentence_index", "canonical_term").join(s.select("doc_id", "sentence_index", "section"), ["doc_id", "sentence_index"])
    nodes = hits.select("doc_id", F.col("section").alias("domain"), "canonical_term", F.length("canonical_term").alias("rank")).distinct()
    every = G.related_chain(nodes, nodes.select("doc_id", F.col("canonical_term").alias("source"), F.lit("").alias("target")))
    return G.related_chain(nodes, every.where(F.length("source") == F.length("target")).select("doc_id", F.col("target").alias("source"), F.col("source").alias("target")))
