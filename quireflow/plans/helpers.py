"""Queries of text helpers, score helpers, feature summaries and event windows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..functions import scores as C
from ..functions import text as T
from ..functions.frames import barrier, load
from ..operators import features as E
from ..operators import metrics as M
from ..operators import stats
from ..streaming import sessions as W
from . import sql as Q
from .core import bench_terms, query_into, sents

QUERIES: dict = {}
SQL: dict = {}
query = query_into(QUERIES, SQL)

HEADINGS = list(dict.fromkeys([*(w for words in rules.HEADING_WORDS.values() for w in words), *rules.SECTION_ALIASES, "overview", "thanks"]))


def quoted(values: list) -> str:
    return "[" + ",".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def picked(values: list, key: str):
    """The value of number key modulo their count."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def picked_sql(values: list, key: str) -> str:
    return f"{quoted(values)}[1 + {key} % {len(values)}]"


def norm_heading_sql(x: str) -> str:
    bare = rf"regexp_replace(regexp_replace(lower({x}), '^\s*(?:\d+(?:\.\d+)*|[a-z])\.?\s+', ''), '[:.]\s*$', '')"
    return rf"trim(regexp_replace(regexp_replace({bare}, '[^a-z0-9+\-\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""WITH h AS (SELECT p_partkey, {picked_sql(HEADINGS, 'p_partkey')} AS word FROM part), g AS (SELECT *, CASE p_partkey % 4 WHEN 0 THEN '3.' || p_partkey % 7 || ' ' WHEN 1 THEN 'B. ' ELSE '' END || upper(word) || ' (' || p_partkey % 3 || ')' || CASE WHEN p_partkey % 2 = 0 THEN ': ' ELSE '' END AS heading FROM h)
SELECT p_partkey, {norm_heading_sql('heading')} AS normalized, CASE {" ".join(f"WHEN regexp_matches({norm_heading_sql('heading')}, '{'|'.join(words)}') THEN '{s}'" for s, words in rules.HEADING_WORDS.items())} ELSE 'intro' END AS heading_section,
  CASE {" ".join(f"WHEN word = '{k}' THEN '{v}'" for k, v in {**rules.SECTION_ALIASES, **{s: s for s in rules.SECTIONS}}.items())} ELSE 'intro' END AS section, {picked_sql([r if k % 3 else 'none' for k, r in enumerate(rules.ROLES)], 'p_partkey')} AS role FROM g""")
def heading_names(spark, sf_dir):
    key = F.col("p_partkey")
    d = load(spark, sf_dir, "part").select("p_partkey", picked(HEADINGS, "p_partkey").alias("word"))
    number = F.when(key % 4 == 0, F.concat(F.lit("3."), (key % 7).cast("string"), F.lit(" "))).when(key % 4 == 1, F.lit("B. ")).otherwise(F.lit(""))
    heading = F.concat(number, F.upper("word"), F.lit(" ("), (key % 3).cast("string"), F.lit(")"), F.when(key % 2 == 0, F.lit(": ")).otherwise(F.lit("")))
    d = barrier(d, heading=heading, said=picked([f" {r.upper()} " if k % 3 else "unheard of" for k, r in enumerate(rules.ROLES)], "p_partkey"))
    return d.select("p_partkey", T.normalize_heading("heading").alias("normalized"), T.heading_section("heading").alias("heading_section"), T.canonical_section(F.concat(F.lit(" "), F.initcap("word"))).alias("section"), T.canonical_role("said").alias("role"))


@query(r"""WITH n AS (SELECT *, p_name || ' ' || p_brand AS name, CASE WHEN p_partkey % 5 = 0 THEN '##' ELSE '_' || p_brand || ' ' || p_type END AS file, string_split(p_name || ' ' || lower(p_type) || ' of, ' || p_size, ' ') AS w FROM part)
SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  CASE WHEN p_partkey % 5 = 0 THEN 'paper' ELSE regexp_replace(regexp_replace(file, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') END AS safe_name,
  CASE WHEN p_partkey % 5 = 1 THEN 'the paper' ELSE p_name END AS title,
  array_to_string(w, ' ') AS whole,
  regexp_replace(array_to_string(w[1:4], ' '), '[ ,;:]+$', '') || ' ...' AS short,
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN w[1] WHEN 2 THEN w[1] || ' and ' || w[2] ELSE w[1] || ', ' || w[2] || ', and ' || w[3] END AS terms,
  CASE WHEN p_partkey % 3 < 2 THEN replace(p_name, ' ', '/') ELSE p_name END AS phrases,
  array_to_string(list_sort(list_distinct([lower(p_name), replace(lower(p_name), '-', ' '), replace(lower(p_name), ' ', '-')])), '|') AS variants FROM n""")
def name_tools(spark, sf_dir):
    key = F.col("p_partkey")
    words = F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("of,"), F.col("p_size").cast("string")), " ")
    d = barrier(load(spark, sf_dir, "part"), w=words, name=F.concat_ws(" ", "p_name", "p_brand"), file=F.when(key % 5 == 0, F.lit("##")).otherwise(F.concat(F.lit("_"), "p_brand", F.lit(" "), "p_type")))
    title = F.when(key % 5 == 1, F.lit("2024_ ")).otherwise(F.concat(F.lit("2024_"), F.replace("p_name", F.lit(" "), F.lit("_"))))
    parted = F.when(key % 3 == 0, F.replace("p_name", F.lit(" "), F.lit(" ;; "))).when(key % 3 == 1, F.replace("p_name", F.lit(" "), F.lit(" | "))).otherwise(F.col("p_name"))
    whole = F.array_join("w", " ")
    return d.select(
        "p_partkey", T.slug("name").alias("slug"), T.safe_name("file").alias("safe_name"), T.clean_title(title).alias("title"), T.trim_words(whole, 20).alias("whole"), T.trim_words(whole, 4).alias("short"),
        T.join_terms(F.slice("w", 1, (key % 4).cast("int"))).alias("terms"), F.array_join(T.keyphrase_list(parted), "/").alias("phrases"), F.array_join(F.array_sort(T.alias_variants("p_name")), "|").alias("variants"),
    )


TAGS, FLAGS = ["B-KEY", "i-key", "O", " b ", None, "inside", ""], ["1", "TRUE", " yes", "no", "y", None, "0"]


@query(f"""SELECT event_id, {picked_sql(['B', 'I', 'O', 'B', 'O', 'I', 'O'], 'event_id')} AS bio, CASE WHEN event_id % 3 = 0 THEN 0.25 ELSE value END AS number, CASE WHEN event_id % 3 = 0 THEN -1 ELSE CAST(trunc(value) AS INT) END AS whole,
  {picked_sql(FLAGS, 'event_id')} IS NOT NULL AND trim({picked_sql(FLAGS, 'event_id')}) IN ('1', 'TRUE', 'yes', 'y') AS flag, CASE event_id % 3 WHEN 0 THEN event_type ELSE 'other' END AS present FROM events""")
def value_parsing(spark, sf_dir):
    """Values as text, every third not a number; tags and flags in several spellings."""
    key = F.col("event_id")
    d = load(spark, sf_dir, "events").withColumn("said", F.when(key % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string")))
    blank = F.when(key % 3 == 0, F.col("event_type")).when(key % 3 == 1, F.lit("  "))
    return d.select(
        "event_id", T.bio_prefix(picked(TAGS, "event_id")).alias("bio"), T.as_float("said", 0.25).alias("number"), T.as_int("said", -1).alias("whole"), T.as_bool(picked(FLAGS, "event_id")).alias("flag"),
        T.first_present(blank, F.lit("other")).alias("present"),
    )


@query(rf"""SELECT item_id, array_to_string(regexp_extract_all({Q.norm("text")}, '[a-z0-9]+'), ' ') AS rouge, array_to_string(regexp_extract_all(lower(text), '[a-z0-9+\-]+'), ' ') AS context FROM benchmark""")
def token_variants(spark, sf_dir):
    d = load(spark, sf_dir, "benchmark")
    return d.select("item_id", F.array_join(T.rouge_tokens("text"), " ").alias("rouge"), F.array_join(T.context_words(F.lower("text")), " ").alias("context"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings), e AS (SELECT vec_id, z, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM v)
SELECT vec_id, round(e[1] / list_sum(e), 9) AS p_first, round(1 / (1 + exp(-z[1])), 9) AS gate, CAST(list_position(z, list_max(z)) - 1 AS INT) AS best FROM e""")
def probabilities(spark, sf_dir):
    d = load(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("z"))
    return d.select("vec_id", F.round(F.element_at(C.softmax(F.col("z")), 1), 9).alias("p_first"), F.round(C.sigmoid(F.element_at("z", 1)), 9).alias("gate"), C.argmax(F.col("z")).cast("int").alias("best"))


@query("""WITH n AS (SELECT lang, count_if(quality >= 0.5) AS p, count_if(quality < 0.5) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, CASE WHEN p > 0 AND n > 0 THEN greatest(1.0, least(4.0, n / p)) ELSE 1.0 END AS positive_weight, CASE WHEN p > 0 AND n > 0 THEN greatest(1.0, least(4.0, p / n)) ELSE 1.0 END AS negative_weight FROM n""")
def class_weights(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count_if(F.col("quality") >= 0.5).alias("p"), F.count_if(F.col("quality") < 0.5).alias("n"))
    return d.select("lang", M.positive_weight(F.col("p"), F.col("n"), 4.0).alias("positive_weight"), M.positive_weight(F.col("n"), F.col("p"), 4.0).alias("negative_weight"))


@query(f"""WITH {Q.LEX} SELECT alias AS term, CASE WHEN length(alias) % 4 = 0 THEN 0.5 ELSE greatest(0.35, least(0.95, 0.82 + CASE WHEN tf > 1 THEN 0.06 ELSE 0.0 END + CASE WHEN length(alias) % 2 = 0 THEN 0.03 ELSE 0.0 END - CASE WHEN is_generic THEN 0.20 ELSE 0.0 END)) END AS confidence FROM lex""")
def term_confidences(spark, sf_dir):
    n = F.length("alias")
    made = C.term_confidence(F.when(n % 4 == 0, F.lit("0.5")), F.when(F.col("tf") > 1, F.lit(" Both")).otherwise(F.lit("one")), F.when(n % 2 == 0, F.lit("Q1")).otherwise(F.lit(" ")), F.col("is_generic"))
    return bench_terms(spark, sf_dir).select(F.col("alias").alias("term"), made.alias("confidence"))


GRAMS = f"""{Q.LEX}, {Q.SENT}, g AS (SELECT doc_id, section, unnest({Q.grams('w', 2)}) AS term FROM (SELECT *, {Q.toks(Q.norm('text'))} AS w FROM sent))"""


@query(f"""WITH {GRAMS}, n AS (SELECT g.doc_id, g.section, term, count(*) AS frequency FROM g JOIN lex ON lex.alias = term AND lex.section = g.section GROUP BY ALL)
SELECT doc_id, section, term, frequency, frequency * CASE WHEN length(term) % 4 > 0 THEN (length(term) % 4) / 2.0 ELSE 1.0 END AS tfidf FROM n""")
def section_term_tfidf(spark, sf_dir):
    """Terms with known idf, some of them zero, in their own sections."""
    terms = bench_terms(spark, sf_dir).select(F.col("alias").alias("term"), "section", (F.length("alias") % 4 / 2).alias("idf"))
    s = sents(spark, sf_dir).withColumn("sentence_index", F.col("sentence_index").cast("int"))
    return E.on_the_fly_tfidf(s, terms).withColumn("frequency", F.col("frequency").cast("bigint"))


MATRIX = f"""{GRAMS}, c AS (SELECT doc_id, section, term, count(*) AS frequency FROM g SEMI JOIN lex ON lex.alias = g.term GROUP BY ALL), d AS (SELECT term, count(DISTINCT doc_id) AS df FROM c GROUP BY term),
m AS (SELECT doc_id, section, term, frequency, round(frequency * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0), 9) AS tfidf FROM c JOIN d USING (term))"""


def matrix(spark, sf_dir):
    return stats.term_matrix(sents(spark, sf_dir), bench_terms(spark, sf_dir), load(spark, sf_dir, "documents").count()).withColumn("tfidf", F.round("tfidf", 9))


@query(f"WITH {MATRIX} SELECT doc_id, count(*) AS features, max(frequency) AS max_frequency, max(tfidf) AS max_tfidf FROM m GROUP BY doc_id")
def feature_summary(spark, sf_dir):
    return stats.matrix_summary(matrix(spark, sf_dir))


@query(f"""WITH {MATRIX}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, section ORDER BY tfidf DESC, frequency DESC, term) AS INT) AS rank FROM m) SELECT doc_id, section, term, frequency, tfidf, rank FROM r WHERE rank <= 12""")
def top_section_features(spark, sf_dir):
    return stats.top_features(matrix(spark, sf_dir)).select("doc_id", "section", "term", "frequency", "tfidf", "rank")


@query("""SELECT time_bucket(INTERVAL 10 MINUTE, CAST(ts AS TIMESTAMP)) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    return W.windowed_counts(load(spark, sf_dir, "events")).withColumn("total", F.round("total", 6))


@query("""WITH e AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts FROM events), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM e),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    return W.sessions(load(spark, sf_dir, "events"))


@query("""SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def latest_turns(spark, sf_dir):
    return W.latest_turns(load(spark, sf_dir, "conversations"))
