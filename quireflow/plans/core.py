"""Queries of text, section, statistics and lexicon operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T
from ..functions.frames import barrier, load
from ..operators import lexicon as L
from ..operators import sections as S
from ..operators import stats
from . import sql as Q

QUERIES: dict = {}
SQL: dict = {}


def query_into(queries: dict, oracle: dict):
    """A decorator that registers a query and its SQL."""

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return add

    return query


query = query_into(QUERIES, SQL)


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "text")


def sents(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Sentences with positional sections; the tables have no headings, so headings are left to fixtures.

    together: texts are dealt by doc_id first, so that what is grouped by document later is not shuffled again.
    """
    rows = docs(spark, sf_dir)
    d = barrier(rows.repartition("doc_id") if together else rows, s0=F.transform(T.split_sentences(F.coalesce("text", F.lit(""))), lambda s: F.struct(s.alias("text"), F.lit("intro").alias("section"), F.lit("Unsectioned").alias("section_title"))))
    return S.explode_sentences(barrier(d, sents=S.positional("s0")).select("doc_id", "sents"), ["doc_id"])


def bench_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams of the benchmark as a section lexicon; attributes follow from the spelling, so that SQL can make the same."""
    b = barrier(load(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text")), w=T.tokens("text"))
    g = b.select("item_id", F.explode(T.ngrams(F.col("w"), 2)).alias("alias"))
    n = F.length("alias")
    return g.groupBy("alias").agg(F.count("*").alias("tf"), F.count_distinct("item_id").alias("df")).select(
        F.col("alias").alias("term_id"), F.element_at(F.array(*map(F.lit, rules.SECTIONS)), 1 + n % 5).alias("section"), F.col("alias").alias("canonical_term"), "alias",
        F.lit(0).alias("alias_order"), (F.lit(0.55) + F.lit(0.05) * (n % 8)).alias("confidence"), (n % 3 == 0).alias("is_generic"), "tf", "df",
    )


@query(f"SELECT doc_id, {Q.norm('text')} AS normalized, {Q.norm_term('text')} AS term, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS match_key FROM documents")
def text_normalize(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.normalize("text").alias("normalized"), T.normalize_term("text").alias("term"), T.normalize_match("text").alias("match_key"))


@query(f"WITH {Q.SENT} SELECT doc_id, sentence_index, text, section, n FROM sent")
def positional_sections(spark, sf_dir):
    return sents(spark, sf_dir).select("doc_id", F.col("sentence_index").cast("int"), "text", "section", F.col("n_sentences").cast("bigint").alias("n"))


@query(rf"""WITH w AS (SELECT doc_id, list_filter(string_split({Q.squeeze('text')}, ' '), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, unnest(range(0, len(w), 120)) // 120 AS chunk, unnest(list_transform(range(0, len(w), 120), lambda i: array_to_string(w[i + 1:i + 120], ' '))) AS text FROM w""")
def word_chunks(spark, sf_dir):
    d = barrier(docs(spark, sf_dir), w=T.words("text"))
    return d.select("doc_id", F.posexplode(T.chunk_words(F.col("w"), 120)).alias("chunk", "text")).withColumn("chunk", F.col("chunk").cast("bigint"))


@query(rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({Q.squeeze('text')}, '([.?!])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 15) AS p FROM documents)
SELECT doc_id, CAST(unnest(range(len(p))) AS INT) AS sentence_index, unnest(p) AS text FROM p""")
def sentence_split_browser(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.posexplode(T.split_sentences_browser("text")).alias("sentence_index", "text"))


#: doc_id, sents: the first .3 of the sentences is intro, the rest method; cues are words of the tables.
REPAIR_CUES, REPAIR_OWN, REPAIR_TAIL = ["that ", "ching", "eaux"], ["idiot", "oui"], r"(^| )(the|und|les|los) "


def repaired(spark, sf_dir, repair):
    d = docs(spark, sf_dir).select("doc_id", T.split_sentences(F.coalesce("text", F.lit(""))).alias("p"))
    d = barrier(d, n=F.size("p"))
    start = F.transform("p", lambda s, i: F.struct(s.alias("text"), F.when(i / F.col("n") < 0.3, F.lit("intro")).otherwise(F.lit("method")).alias("section"), F.lit("").alias("section_title")))
    d = barrier(barrier(d, s0=start), sents=repair("s0"))
    return S.explode_sentences(d.select("doc_id", "sents"), ["doc_id"]).select("doc_id", F.col("sentence_index").cast("int"), "section")


HALVES = f"{Q.SENT}, h AS (SELECT doc_id, sentence_index, text, n, CASE WHEN sentence_index / n < 0.3 THEN 'intro' ELSE 'method' END AS section FROM sent)"


@query(f"""WITH {HALVES}, m AS (SELECT *, min(CASE WHEN section = 'method' THEN sentence_index END) OVER (PARTITION BY doc_id) AS first FROM h)
SELECT doc_id, sentence_index, CASE WHEN n >= 10 AND first >= 4 AND sentence_index >= greatest(2, first - 5) AND sentence_index < first
  AND (contains(lower(text), 'that ') OR contains(lower(text), 'ching') OR contains(lower(text), 'eaux')) AND NOT (contains(lower(text), 'idiot') OR contains(lower(text), 'oui'))
  THEN 'related_work' ELSE section END AS section FROM m""")
def related_work_bridge(spark, sf_dir):
    return repaired(spark, sf_dir, lambda s: S.bridge(s, REPAIR_CUES, REPAIR_OWN))


@query(rf"""WITH {HALVES}, m AS (SELECT *, min(CASE WHEN section = 'method' AND sentence_index >= floor(n * 0.72) AND regexp_matches(text, '(?i)(^| )(the|und|les|los) ') THEN sentence_index END) OVER (PARTITION BY doc_id) AS first FROM h)
SELECT doc_id, sentence_index, CASE WHEN n >= 10 AND sentence_index >= first AND section = 'method' THEN 'conclusion' ELSE section END AS section FROM m""")
def conclusion_tail(spark, sf_dir):
    return repaired(spark, sf_dir, lambda s: S.conclusion_tail(s, "(?i)" + REPAIR_TAIL))


@query(rf"""WITH {HALVES}, m AS (SELECT *, min(CASE WHEN sentence_index >= floor(n * 0.92) AND regexp_matches(text, '(?i)(^| )(the|und|les|los) ') THEN sentence_index END) OVER (PARTITION BY doc_id) AS first FROM h)
SELECT doc_id, sentence_index, CASE WHEN n < 40 THEN section WHEN sentence_index >= first THEN 'conclusion' WHEN sentence_index / n < 0.20 THEN 'intro' WHEN sentence_index / n < 0.35 THEN 'related_work'
  WHEN sentence_index / n < 0.65 THEN 'method' ELSE 'experiment' END AS section FROM m""")
def low_coverage_repair(spark, sf_dir):
    return repaired(spark, sf_dir, lambda s: S.low_coverage(s, "(?i)" + REPAIR_TAIL))


@query(f"""WITH {Q.SENT}, t AS (SELECT doc_id, section, text, {Q.toks(Q.norm('text'))} AS w FROM sent), c AS (SELECT doc_id, section, count(*) AS sentence_count, sum(len(w)) AS token_count FROM t GROUP BY ALL),
u AS (SELECT doc_id, section, unnest(w) AS w FROM t), v AS (SELECT doc_id, section, count(DISTINCT w) AS type_count FROM u GROUP BY ALL)
SELECT doc_id, section, sentence_count, CAST(token_count AS BIGINT) AS token_count, coalesce(type_count, 0) AS type_count, CASE WHEN token_count > 0 THEN coalesce(type_count, 0) / token_count ELSE 0.0 END AS type_token_ratio FROM c LEFT JOIN v USING (doc_id, section)""")
def section_token_stats(spark, sf_dir):
    return stats.section_token_stats(sents(spark, sf_dir))


@query(f"""WITH {Q.SENT}, t AS (SELECT section, unnest({Q.toks(Q.norm('text'))}) AS w FROM sent)
SELECT coalesce(section, 'all') AS section, count(*) AS token_count, count(DISTINCT w) AS type_count FROM t GROUP BY GROUPING SETS ((section), ())""")
def corpus_statistics(spark, sf_dir):
    return stats.corpus_statistics(sents(spark, sf_dir))


def top_ngram_sql(n: int) -> str:
    stop = ",".join(f"'{w}'" for w in rules.STOPWORDS)
    return f"""WITH t AS (SELECT doc_id, list_filter({Q.toks(Q.norm("coalesce(text, '')"))}, lambda w: length(w) > 1 AND w NOT IN ({stop})) AS w FROM documents),
g AS (SELECT doc_id, unnest({Q.grams('w', n)}) AS term, unnest(range(1, len(w) - {n - 2})) AS pos FROM t),
c AS (SELECT doc_id, term, count(*) AS n, min(pos) AS first FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM c)
SELECT doc_id, term, n, rank FROM r WHERE rank <= 20"""


@query(top_ngram_sql(1))
def top_unigrams(spark, sf_dir):
    return stats.top_ngrams(docs(spark, sf_dir), 1)


@query(top_ngram_sql(2))
def top_bigrams(spark, sf_dir):
    return stats.top_ngrams(docs(spark, sf_dir), 2)


@query(top_ngram_sql(3))
def top_trigrams(spark, sf_dir):
    return stats.top_ngrams(docs(spark, sf_dir), 3)


@query(f"""WITH {Q.SENT} SELECT doc_id, sentence_index, lag(text, 1, '') OVER (PARTITION BY doc_id ORDER BY sentence_index) AS previous, text AS current, lead(text, 1, '') OVER (PARTITION BY doc_id ORDER BY sentence_index) AS next FROM sent""")
def context_window(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.transform(T.split_sentences(F.coalesce("text", F.lit(""))), lambda s: F.struct(s.alias("text"))).alias("p"))
    d = barrier(d, sents=F.col("p")).drop("p")
    return d.select("doc_id", F.inline(S.context_window("sents"))).withColumn("sentence_index", F.col("sentence_index").cast("int"))


@query(f"""WITH {Q.LEX}, {Q.SENT}, g AS (SELECT doc_id, sentence_index, section AS own, unnest({Q.grams('w', 2)}) AS alias FROM (SELECT *, {Q.toks(Q.norm('text'))} AS w FROM sent)),
h AS (SELECT DISTINCT doc_id, sentence_index, own, alias FROM g), j AS (SELECT doc_id, sentence_index, canonical_term, section AS term_section, confidence, tf, row_number() OVER (PARTITION BY doc_id, sentence_index ORDER BY CASE WHEN section = own THEN 1 ELSE 0 END DESC, confidence DESC, tf DESC, canonical_term, section) AS rank
FROM h JOIN lex USING (alias) WHERE confidence >= 0.65) SELECT doc_id, sentence_index, canonical_term, term_section, confidence, tf, rank FROM j WHERE rank <= 8""")
def dictionary_hits(spark, sf_dir):
    out = L.sentence_hits(sents(spark, sf_dir), bench_terms(spark, sf_dir), ["doc_id", "sentence_index"])
    return out.withColumn("sentence_index", F.col("sentence_index").cast("int"))


@query(f"""WITH {Q.LEX}, {Q.SENT}, cues AS (SELECT alias, CASE WHEN is_generic THEN 'claim' ELSE 'detail' END AS evidence_type, section AS hint FROM lex WHERE df >= 2),
g AS (SELECT DISTINCT doc_id, sentence_index, own, alias FROM (SELECT doc_id, sentence_index, section AS own, unnest({Q.grams('w', 2)}) AS alias FROM (SELECT *, {Q.toks(Q.norm('text'))} AS w FROM sent))),
r AS (SELECT doc_id, sentence_index, alias AS cue_phrase, evidence_type, row_number() OVER (PARTITION BY doc_id, sentence_index ORDER BY CASE WHEN hint = own THEN 1 ELSE 0 END DESC, length(alias) DESC, alias) AS rank FROM g JOIN cues USING (alias))
SELECT * FROM r WHERE rank <= 8""")
def cue_hits(spark, sf_dir):
    cues = bench_terms(spark, sf_dir).where("df >= 2").select(F.col("alias").alias("cue_phrase"), F.when(F.col("is_generic"), F.lit("claim")).otherwise(F.lit("detail")).alias("evidence_type"), F.lit("").alias("role_prior"), F.col("section").alias("section_hint"))
    out = L.cue_hits(sents(spark, sf_dir), cues, ["doc_id", "sentence_index"])
    return out.select("doc_id", F.col("sentence_index").cast("int"), "cue_phrase", "evidence_type", "rank")


#: Phrases: the first three words of each sentence of documents.
PHRASES = f"p AS (SELECT DISTINCT array_to_string({Q.toks(Q.norm('text'))}[1:3], ' ') AS phrase, section FROM sent), q AS (SELECT * FROM p WHERE phrase <> '')"


def lead_phrases(spark, sf_dir):
    s = sents(spark, sf_dir).select("section", T.tokens("text").alias("w"))
    return s.select("section", F.array_join(F.slice("w", 1, 3), " ").alias("phrase")).where("phrase <> ''").distinct()


@query(f"""WITH {Q.LEX}, {Q.SENT}, {PHRASES} SELECT phrase, section, coalesce(canonical_term, phrase) AS canonical, coalesce(confidence, 0.0) AS bow_confidence FROM q LEFT JOIN (SELECT alias, canonical_term, confidence FROM lex) ON alias = phrase""")
def alias_canonicalize(spark, sf_dir):
    return L.canonicalize(lead_phrases(spark, sf_dir), bench_terms(spark, sf_dir)).select("phrase", "section", "canonical", "bow_confidence")


FUZZY = f"""{Q.LEX}, {Q.SENT}, {PHRASES},
l AS (SELECT *, list_distinct(string_split(alias, ' ')) AS a FROM lex), f AS (SELECT DISTINCT phrase, list_distinct(string_split(phrase, ' ')) AS t FROM q),
k AS (SELECT DISTINCT phrase, t, alias FROM (SELECT phrase, t, unnest(t) AS tok FROM f) JOIN (SELECT alias, unnest(a) AS tok FROM l) USING (tok)),
m AS (SELECT phrase, l.*, CASE WHEN phrase = alias THEN 1.0 WHEN len(a) >= 2 AND len(list_intersect(a, t)) = len(a) THEN 0.84 WHEN len(t) >= 2 AND len(list_intersect(a, t)) = len(t) THEN 0.78
  WHEN len(list_intersect(a, t)) / len(list_distinct(list_concat(a, t))) >= 0.72 THEN len(list_intersect(a, t)) / len(list_distinct(list_concat(a, t))) ELSE 0.0 END AS quality FROM k JOIN l USING (alias))"""


@query(f"""WITH {FUZZY}, s AS (SELECT q.phrase, q.section, canonical_term, m.section AS term_section, quality, confidence, quality + 0.15 * confidence + CASE WHEN m.section = q.section THEN 0.10 ELSE 0.0 END
  + 0.05 * least(1.0, ln(1.0 + tf) / 6) - CASE WHEN is_generic THEN 0.18 ELSE 0.0 END AS score FROM q JOIN m USING (phrase) WHERE quality > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY phrase, section ORDER BY score DESC, canonical_term) AS k FROM s) SELECT phrase, section, canonical_term, term_section, quality, least(1.0, greatest(0.0, confidence * quality)) AS bow_support FROM r WHERE k = 1""")
def fuzzy_alias_match(spark, sf_dir):
    return L.match_terms(lead_phrases(spark, sf_dir), bench_terms(spark, sf_dir)).drop("score")


@query(f"""WITH {FUZZY}, r AS (SELECT q.phrase, q.section, canonical_term, quality, least(1.0, confidence * quality) AS bow_support, row_number() OVER (PARTITION BY q.phrase, q.section ORDER BY confidence * quality DESC, canonical_term) AS k FROM q JOIN m ON m.phrase = q.phrase AND m.section = q.section WHERE quality > 0)
SELECT phrase, section, canonical_term, quality, bow_support FROM r WHERE k = 1""")
def section_alias_match(spark, sf_dir):
    return L.match_terms(lead_phrases(spark, sf_dir), bench_terms(spark, sf_dir), same_section=True).select("phrase", "section", "canonical_term", "quality", "bow_support")


@query(f"""WITH {Q.LEX}, s AS (SELECT unnest({Q.SECTION_LIST}) AS section) SELECT canonical_term, s.section, (CASE WHEN lex.section = s.section THEN tf ELSE 0 END + 1.0) / (tf + 5.0) AS prior FROM lex CROSS JOIN s""")
def section_prior(spark, sf_dir):
    return L.section_prior(bench_terms(spark, sf_dir), rules.SECTIONS)


@query(f"""WITH {Q.SENT}, a AS (SELECT doc_id, sentence_index, list_distinct({Q.toks(Q.norm('text'))}) AS t FROM sent), b AS (SELECT item_id, list_distinct({Q.toks(Q.norm('text'))}) AS u FROM benchmark),
k AS (SELECT DISTINCT doc_id, sentence_index, t, item_id, u FROM (SELECT *, unnest(t) AS x FROM a WHERE len(t) >= 6) JOIN (SELECT *, unnest(u) AS x FROM b) USING (x) WHERE len(t) >= 0.68 * len(u) AND len(u) >= 0.68 * len(t)),
s AS (SELECT doc_id, sentence_index, item_id, len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))) AS overlap FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, sentence_index ORDER BY overlap DESC, item_id) AS n FROM s WHERE overlap >= 0.68)
SELECT doc_id, sentence_index, item_id, overlap FROM r WHERE n = 1""")
def external_overlap(spark, sf_dir):
    """Document sentences and the benchmark passage that they overlap most with."""
    left = sents(spark, sf_dir).select("doc_id", F.col("sentence_index").cast("int"), "text").where(F.size(F.array_distinct(T.tokens("text"))) >= 6)
    return L.nearest_by_overlap(left, load(spark, sf_dir, "benchmark").select("item_id", "text"), ["doc_id", "sentence_index"], "item_id")


@query(f"""WITH {Q.LEX}, {Q.SENT}, g AS (SELECT doc_id, section, unnest({Q.grams('w', 2)}) AS term FROM (SELECT *, {Q.toks(Q.norm('text'))} AS w FROM sent)),
c AS (SELECT doc_id, section, term, count(*) AS frequency FROM g SEMI JOIN lex ON lex.alias = g.term GROUP BY ALL), n AS (SELECT count(*) AS n FROM documents),
d AS (SELECT term, count(DISTINCT doc_id) AS df FROM c GROUP BY term) SELECT doc_id, section, term, frequency, round(frequency * (ln((1.0 + n) / (1.0 + df)) + 1.0), 9) AS tfidf FROM c JOIN d USING (term) CROSS JOIN n""")
def doc_section_tfidf(spark, sf_dir):
    return stats.term_matrix(sents(spark, sf_dir), bench_terms(spark, sf_dir), load(spark, sf_dir, "documents").count()).withColumn("tfidf", F.round("tfidf", 9))
