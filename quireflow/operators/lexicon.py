"""Joins of phrases and sentences with term, alias and cue lexicons.

Containment of an alias in a sentence is equality with one of its word n-grams, so it is a hash join on n-grams of
the lengths that aliases have. A fuzzy match needs a shared token, so it is a hash join on tokens and a check of
the pairs. Neither tests all pairs. Lexicons are broadcast when counted and small, and shuffled otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import barrier, best, small
from ..functions.scores import clamp, match_quality
from ..functions.text import ngrams, normalize, tokens


def section_lexicon(rows: DataFrame) -> DataFrame:
    """Canonical rows of a section lexicon as (term_id, section, canonical_term, alias, alias_order, confidence, is_generic, tf).

    rows: term_id, section, canonical_term, aliases (array), confidence, is_generic, total_frequency. One row for each normalised alias of a term.
    """
    each = rows.select("*", F.posexplode("aliases").alias("alias_order", "raw")).withColumn("alias", normalize("raw")).where("alias <> ''")
    each = best(each, ["term_id", "alias"], [F.col("alias_order")])
    return each.select("term_id", "section", "canonical_term", "alias", "alias_order", "confidence", "is_generic", F.greatest(F.col("total_frequency"), F.lit(0)).alias("tf"))


def alias_index(lexicon: DataFrame) -> DataFrame:
    """One term for each alias: the most confident, then the first."""
    return best(lexicon, ["alias"], [F.desc("confidence"), F.col("term_id")])


def canonicalize(phrases: DataFrame, lexicon: DataFrame, phrase_col: str = "phrase") -> DataFrame:
    """Adds canonical and bow_confidence: the term whose alias the phrase is, else the phrase itself and 0."""
    index = small(alias_index(lexicon).select(F.col("alias").alias("__key"), F.col("canonical_term").alias("__term"), F.col("confidence").alias("__conf")))
    out = phrases.withColumn("__key", normalize(phrase_col)).join(index, "__key", "left")
    return out.withColumn("canonical", F.coalesce("__term", F.col(phrase_col))).withColumn("bow_confidence", F.coalesce("__conf", F.lit(0.0))).drop("__key", "__term", "__conf")


def contained(sentences: DataFrame, aliases: DataFrame, keys: list[str], lengths: list[int], text_col: str = "text", also: tuple[str, ...] = (), occurrences: bool = False) -> DataFrame:
    """Joins sentences with the aliases they contain: keys, every column of aliases, first_pos (word position). also: keys that aliases share.

    occurrences: adds how many positions the alias stands at.
    """
    s = barrier(sentences.select(*keys, F.col(text_col).alias("__text")), __tokens=tokens("__text"))
    grams = F.flatten(F.array(*[F.transform(ngrams(F.col("__tokens"), n), lambda g, i: F.struct(g.alias("alias"), i.alias("at"))) for n in lengths]))
    return s.select(*keys, F.inline(grams)).join(small(aliases), ["alias", *also]).groupBy(*keys, *[c for c in aliases.columns if c not in also]).agg(F.min("at").alias("first_pos"), *([F.count("*").alias("occurrences")] if occurrences else []))


def alias_lengths(aliases: DataFrame) -> list[int]:
    """The token lengths that aliases have, all of them; read from the lexicon."""
    return sorted(r[0] for r in aliases.select(F.size(F.split("alias", " ")).alias("n")).distinct().collect())


def sentence_hits(sentences: DataFrame, lexicon: DataFrame, keys: list[str], section_col: str = "section", min_confidence: float = 0.65, limit: int = 8) -> DataFrame:
    """keys, canonical_term, term_section, confidence, tf, rank: the terms a sentence contains, those of its own section first."""
    usable = lexicon.where(F.col("confidence") >= min_confidence).select("alias", "canonical_term", F.col("section").alias("term_section"), "confidence", "tf")
    hits = contained(sentences, usable, [*keys, section_col], alias_lengths(usable))
    own = F.col("term_section") == F.col(section_col)
    one = best(hits, [*keys, "canonical_term", "term_section"], [F.desc("confidence"), F.desc("tf"), F.col("alias")])
    return best(one, keys, [F.desc(own.cast("int")), F.desc("confidence"), F.desc("tf"), F.col("canonical_term"), F.col("term_section")], "rank", limit).select(*keys, "canonical_term", "term_section", "confidence", "tf", "rank")


def cue_hits(sentences: DataFrame, cues: DataFrame, keys: list[str], section_col: str = "section", limit: int = 8) -> DataFrame:
    """keys, cue_phrase, evidence_type, rank. cues: cue_phrase, evidence_type, role_prior, section_hint."""
    named = cues.select(normalize("cue_phrase").alias("alias"), "cue_phrase", "evidence_type", "role_prior", "section_hint").where("alias <> ''")
    hits = contained(sentences, named, [*keys, section_col], alias_lengths(named))
    own = (F.col("section_hint") == F.col(section_col)).cast("int")
    one = best(hits, [*keys, "alias"], [F.desc(own), F.col("cue_phrase"), F.col("evidence_type")])
    return best(one, keys, [F.desc(own), F.desc(F.length("cue_phrase")), F.col("cue_phrase")], "rank", limit).select(*keys, "cue_phrase", "evidence_type", "role_prior", "rank")


def fuzzy_pairs(phrases: DataFrame, aliases: DataFrame, phrase_col: str, carry: list[str]) -> DataFrame:
    """Pairs of a distinct phrase and an alias with a match quality over 0. aliases: alias and the columns in carry.

    Tokens are ranked by how few aliases have them. An alias within a phrase, or one with a Jaccard of .72, shares one
    of its own first tokens in that order with the phrase; a phrase within an alias shares its own first. So common
    words join nothing unless an alias or phrase has no other.
    """
    p = phrases.select(normalize(phrase_col).alias("phrase")).where("phrase <> ''").distinct()
    p = barrier(p, p_tokens=F.array_distinct(F.split("phrase", " ")))
    a = barrier(aliases.select("alias", *carry).where("alias <> ''"), a_tokens=F.array_distinct(F.split("alias", " ")))
    names = a.select("alias", "a_tokens").distinct()
    each = names.select("alias", F.size("a_tokens").alias("n"), F.explode("a_tokens").alias("token"))
    counts = small(each.groupBy("token").agg(F.count("*").alias("aliases")))
    ranked = each.join(counts, "token").groupBy("alias", "n").agg(F.array_sort(F.collect_list(F.struct("aliases", "token"))).alias("r"))
    first = ranked.select("alias", F.explode(F.slice("r", 1, F.col("n") - F.ceil(0.72 * F.col("n")).cast("int") + 1)).alias("x")).select("alias", F.col("x.token").alias("token"))
    tokens_of = p.select("phrase", F.size("p_tokens").alias("n"), F.explode("p_tokens").alias("token"))
    within = tokens_of.join(counts, "token").groupBy("phrase", "n").agg(F.count("*").alias("known"), F.min(F.struct("aliases", "token")).alias("m")).where("known = n and n >= 2")
    pairs = tokens_of.join(small(first), "token").select("phrase", "alias")
    pairs = pairs.unionByName(within.select("phrase", F.col("m.token").alias("token")).join(small(each), "token").select("phrase", "alias")).distinct()
    full = pairs.join(small(a), "alias").withColumn("p_tokens", F.array_distinct(F.split("phrase", " ")))
    quality = match_quality(F.col("phrase"), F.col("alias"), F.col("p_tokens"), F.col("a_tokens"))
    return full.select("phrase", "alias", *carry, quality.alias("quality")).where("quality > 0")


def match_terms(phrases: DataFrame, lexicon: DataFrame, phrase_col: str = "phrase", section_col: str = "section", same_section: bool = False) -> DataFrame:
    """phrase, section, canonical_term, term_section, quality, score, confidence: the best term of each (normalised phrase, section).

    score = quality + .15 confidence + .10 if of the section + .05 min(1, ln(1 + tf) / 6) - .18 if generic; with
    ``same_section`` only terms of the section compete, by confidence times quality.
    """
    carry = ["term_id", "section", "canonical_term", "alias_order", "confidence", "is_generic", "tf"]
    pairs = fuzzy_pairs(phrases, lexicon, phrase_col, carry).withColumnRenamed("section", "term_section")
    wanted = phrases.select(normalize(phrase_col).alias("phrase"), F.col(section_col).alias("section")).where("phrase <> ''").distinct()
    both = wanted.join(pairs, "phrase")
    own = F.col("term_section") == F.col("section")
    if same_section:
        both = both.where(own).withColumn("score", F.col("confidence") * F.col("quality"))
    else:
        score = F.col("quality") + 0.15 * F.col("confidence") + F.when(own, F.lit(0.10)).otherwise(F.lit(0.0)) + 0.05 * F.least(F.lit(1.0), F.log1p(F.col("tf").cast("double")) / 6)
        both = both.withColumn("score", score - F.when(F.col("is_generic"), F.lit(0.18)).otherwise(F.lit(0.0)))
    out = best(both, ["phrase", "section"], [F.desc("score"), F.col("term_id"), F.col("alias_order")])
    return out.select("phrase", "section", "canonical_term", "term_section", "quality", "score", clamp(F.col("confidence") * F.col("quality")).alias("bow_support"))


def section_prior(lexicon: DataFrame, sections: list[str], alpha: float = 1.0) -> DataFrame:
    """canonical_term, section, prior: smoothed shares of a term's frequency by section."""
    per = lexicon.select("term_id", "canonical_term", "section", "tf").distinct().groupBy("canonical_term")
    sums = per.agg(F.sum("tf").alias("total"), *[F.sum(F.when(F.col("section") == s, F.col("tf")).otherwise(F.lit(0))).alias(f"in_{s}") for s in sections])
    rows = F.array(*[F.struct(F.lit(s).alias("section"), ((F.col(f"in_{s}") + alpha) / (F.col("total") + alpha * len(sections))).alias("prior")) for s in sections])
    return sums.select("canonical_term", F.inline(rows))


def nearest_by_overlap(left: DataFrame, right: DataFrame, left_key: list[str], right_key: str, text_col: str = "text", least: float = 0.68) -> DataFrame:
    """left_key, right_key, overlap: for each left sentence the right one of greatest token Jaccard of at least ``least``.

    A pair over the threshold shares a token among the first n - ceil(least n) + 1 of either side in one fixed
    order of tokens, that of their hashes, so only those prefixes are joined; lengths must fit too.
    """

    def side(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        d = barrier(df.select(*keys, tokens(text_col).alias("__t")), **{name: F.transform(F.array_sort(F.transform(F.array_distinct("__t"), lambda t: F.struct(F.xxhash64(t).alias("h"), t.alias("t")))), lambda x: x["t"])}).drop("__t")
        n = F.size(name)
        return d.where(n > 0).withColumn(f"{name}_n", n).withColumn("token", F.explode(F.slice(name, 1, n - F.ceil(n * least - 1e-9).cast("int") + 1)))

    a, b = side(left, left_key, "lt"), side(right, [right_key], "rt")
    fits = (F.col("lt_n") >= least * F.col("rt_n")) & (F.col("rt_n") >= least * F.col("lt_n"))
    pairs = a.join(small(b), "token").where(fits)
    shared = F.size(F.array_intersect("lt", "rt"))
    pairs = pairs.withColumn("overlap", shared / (F.col("lt_n") + F.col("rt_n") - shared)).where(F.col("overlap") >= least)
    return best(pairs, left_key, [F.desc("overlap"), F.col(right_key)]).select(*left_key, right_key, "overlap")


def phrase_present(text: Column, phrase: Column) -> Column:
    """Whether a normalised text has a normalised phrase at word borders."""
    return (phrase != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), phrase, F.lit(" ")))
