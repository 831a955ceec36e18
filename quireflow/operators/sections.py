"""Documents to sectioned sentences. All within a document's row: nothing is shuffled until sentences are exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.frames import any_of, barrier
from ..functions.text import clean_lines, normalize_heading, split_sentences
from .inline import INLINE_SCHEMA, inline_chunks

CHUNKS = "array<struct<section:string,title:string,text:string>>"
SENTENCES = "array<struct<text:string,section:string,section_title:string>>"


def is_noise_line(line: Column) -> Column:
    n = F.size(F.split(line, " "))
    low = F.lower(line)
    return (
        (line == "")
        | line.rlike(r"^\s*\f?\s*\d{1,3}\s*$")
        | line.rlike(r"^\s*(?:\d+(?:\.\d+)*|[A-Z])\.?\s*$")
        | (low.startswith("published as a conference paper at") & (n <= 8))
        | (low.startswith("arxiv:") & (n <= 5))
    )


def line_section(line: Column, patterns: dict[str, list[str]] | None = None) -> Column:
    """The section that a heading line opens, or null. Patterns of a section are one expression."""
    heading = normalize_heading(F.regexp_replace(line, r"^\s*(?:\d+(?:\.\d+)*\.?\s+)?", ""))
    out = F.lit(None).cast("string")
    for section, ps in reversed(list((patterns or rules.HEADING_PATTERNS).items())):
        out = F.when(heading.rlike("^(?:" + "|".join(ps) + ")$"), F.lit(section)).otherwise(out)
    return F.when((F.size(F.split(line, " ")) <= 9) & (heading != ""), out)


def line_chunks(docs: DataFrame, text_col: str = "text", inline: bool = True) -> DataFrame:
    """Adds chunks (section, title, text) by heading lines; by headings inside the text if there are none; else all of it as Unsectioned.

    A terminal heading such as References ends the document if a heading came before it.
    """
    d = barrier(docs, s_lines=clean_lines(F.coalesce(F.col(text_col), F.lit(""))))
    kind = lambda x: F.when(is_noise_line(x), F.lit("#noise")).when(x.rlike(rules.TERMINAL_HEADING), F.lit("#end")).otherwise(F.coalesce(line_section(x), F.lit("")))
    d = barrier(d, s_kinds=F.transform("s_lines", kind))
    d = barrier(d, s_end=F.when(F.array_contains("s_kinds", "#end"), F.array_position("s_kinds", "#end")).otherwise(F.size("s_lines") + 1).cast("int"))
    at = F.filter(F.transform("s_kinds", lambda k, i: F.when(k.isin(rules.SECTIONS) & (i + 1 < F.col("s_end")), i + 1)), lambda i: i.isNotNull())
    d = barrier(d, s_heads=at)

    def body(start: Column, stop: Column) -> Column:
        """Lines after ``start`` and before ``stop``, counted from 1, without noise."""
        picked = F.filter(F.transform("s_lines", lambda x, i: F.when((i + 1 > start) & (i + 1 < stop) & (F.element_at("s_kinds", i + 1) == ""), x)), lambda x: x.isNotNull())
        return F.array_join(picked, " ")

    next_head = F.concat(F.slice("s_heads", 2, F.greatest(F.size("s_heads"), F.lit(1))), F.array(F.col("s_end")))
    headed = F.zip_with(
        "s_heads", next_head,
        lambda h, nxt: F.struct(F.element_at("s_kinds", h).alias("section"), F.element_at("s_lines", h).alias("title"), body(h, nxt).alias("text")),
    )
    lead = F.array(F.struct(F.lit("intro").alias("section"), F.lit("Introduction").alias("title"), body(F.lit(0), F.element_at("s_heads", 1)).alias("text")))
    lined = F.when(F.size("s_heads") > 0, F.filter(F.concat(lead, headed), lambda c: c["text"] != "")).cast(CHUNKS)
    d = barrier(d, s_lined=lined)
    if inline:
        d = d.withColumn("s_inline", F.when(F.size("s_heads") == 0, inline_chunks(F.col(text_col))))
    else:
        d = d.withColumn("s_inline", F.lit(None).cast(INLINE_SCHEMA))
    whole = F.array(F.struct(F.lit("intro").alias("section"), F.lit("Unsectioned").alias("title"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))).cast(CHUNKS)
    chosen = F.when(F.size("s_heads") > 0, F.col("s_lined")).when(F.size("s_inline") > 0, F.col("s_inline")).otherwise(whole)
    return d.withColumn("chunks", chosen).drop("s_lines", "s_kinds", "s_end", "s_heads", "s_lined", "s_inline")


def chunk_sentences(chunks: Column) -> Column:
    """Sentences of all chunks in order."""
    return F.flatten(F.transform(chunks, lambda c: F.transform(split_sentences(c["text"]), lambda s: F.struct(s.alias("text"), c["section"].alias("section"), c["title"].alias("section_title"))))).cast(SENTENCES)


def at_share(ratio: Column, positions: list[tuple[str, float]]) -> Column:
    out = F.lit(None).cast("string")
    for section, end in reversed(positions):
        out = F.when(ratio < end, F.lit(section)).otherwise(out)
    return out


def retitled(s: Column, section: Column, title: Column) -> Column:
    return F.struct(s["text"].alias("text"), section.alias("section"), title.alias("section_title"))


def positional(sents: str, positions: list = rules.POSITIONS, least: int = 8) -> Column:
    """Sections by position where a document of enough sentences has none."""
    n = F.size(sents)
    real = F.exists(sents, lambda s: (s["section"] != "intro") | (s["section_title"] != "Unsectioned"))
    by = lambda s, i: retitled(s, at_share(i / n, positions), F.concat(F.lit("Positional "), at_share(i / n, positions)))
    return F.when(real | (n < least), F.col(sents)).otherwise(F.transform(sents, by))


def bridge(sents: str, cues: list[str] | None = None, own: list[str] | None = None) -> Column:
    """Related work among the five sentences before the first method sentence, where there is none."""
    low = lambda s: F.lower(s["text"])
    first = F.array_position(F.transform(sents, lambda s: s["section"]), "method") - 1
    fits = lambda s: any_of([F.contains(low(s), F.lit(c)) for c in cues or rules.BRIDGE_CUES]) & ~any_of([F.contains(low(s), F.lit(c)) for c in own or rules.OWN_WORK_CUES])
    keep = F.exists(sents, lambda s: s["section"] == "related_work") | (F.size(sents) < 10) | (first < 4)
    move = lambda s, i: F.when((i >= F.greatest(F.lit(2), first - 5)) & (i < first) & fits(s), retitled(s, F.lit("related_work"), F.lit("Inferred related-work bridge"))).otherwise(s)
    return F.when(keep, F.col(sents)).otherwise(F.transform(sents, move))


def first_index(sents: str, test) -> Column:
    """The first position, from 0, at which test(sentence, position) holds; -1 if none."""
    return F.array_position(F.transform(sents, lambda s, i: F.coalesce(test(s, i), F.lit(False))), True) - 1


def conclusion_tail(sents: str, tail: str = rules.CONCLUSION_TAIL) -> Column:
    """Method and experiment sentences from the first one in the last .28 that sounds like a conclusion, where there is none."""
    late = F.floor(F.size(sents) * 0.72)
    body = lambda s: s["section"].isin("method", "experiment")
    start = first_index(sents, lambda s, i: (i >= late) & body(s) & s["text"].rlike(tail))
    keep = F.exists(sents, lambda s: s["section"] == "conclusion") | (F.size(sents) < 10) | (start < 0)
    move = lambda s, i: F.when((i >= start) & body(s), retitled(s, F.lit("conclusion"), F.lit("Inferred conclusion tail"))).otherwise(s)
    return F.when(keep, F.col(sents)).otherwise(F.transform(sents, move))


def low_coverage(sents: str, tail: str = rules.CONCLUSION_TAIL, positions: list = rules.BODY_POSITIONS) -> Column:
    """Cuts a long document by position if most of its sections are all but empty."""
    n = F.size(sents)
    count = lambda name: F.size(F.filter(sents, lambda s: s["section"] == name))
    least = F.greatest(F.lit(2), F.floor(n * 0.03).cast("int"))
    effective = sum((count(s) >= least).cast("int") for s in rules.SECTIONS)
    found = first_index(sents, lambda s, i: s["section"] == "conclusion")
    end = F.when(found > 8, found).otherwise(n)
    keep = (n < 40) | ((effective > 2) & (count("method") > 0) & (count("experiment") > 0)) | (end < 30)
    start = F.when(found < 0, first_index(sents, lambda s, i: (i >= F.floor(n * 0.92)) & s["text"].rlike(tail))).otherwise(F.lit(-1))
    place = lambda s, i: (
        F.when((start >= 0) & (i >= start), retitled(s, F.lit("conclusion"), F.lit("Low-coverage inferred conclusion")))
        .when(i < end, retitled(s, at_share(i / end, positions), F.concat(F.lit("Low-coverage positional "), at_share(i / end, positions))))
        .otherwise(s)
    )
    return F.when(keep, F.col(sents)).otherwise(F.transform(sents, place))


def section_documents(docs: DataFrame, text_col: str = "text", inline: bool = True) -> DataFrame:
    """Adds sents: the sentences of each document with sections, after all repairs."""
    d = barrier(line_chunks(docs, text_col, inline), s0=chunk_sentences(F.col("chunks"))).drop("chunks")
    for k, repair in enumerate((positional, bridge, conclusion_tail, low_coverage)):
        d = barrier(d, **{f"s{k + 1}": repair(f"s{k}")}).drop(f"s{k}")
    return d.withColumnRenamed("s4", "sents")


def explode_sentences(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sentence_index, text, section, section_title, n_sentences."""
    return docs.select(*keys, F.size("sents").alias("n_sentences"), F.posexplode("sents").alias("sentence_index", "s")).select(*keys, "sentence_index", "s.*", "n_sentences")


def sentence_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", inline: bool = True) -> DataFrame:
    return explode_sentences(section_documents(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", inline), ["doc_id"])


def context_window(sents: str = "sents") -> Column:
    """Each sentence with the one before and after, empty at the ends."""
    at = lambda i: F.coalesce(F.get(F.col(sents), i)["text"], F.lit(""))
    return F.transform(sents, lambda s, i: F.struct(i.alias("sentence_index"), F.when(i > 0, at(i - 1)).otherwise(F.lit("")).alias("previous"), s["text"].alias("current"), at(i + 1).alias("next")))


def section_paths(names: Column, paragraphs: Column) -> Column:
    """Sentences of parallel arrays of section names and paragraph lists, sectioned by their headings."""
    from ..functions.text import heading_section

    return F.flatten(
        F.transform(
            F.arrays_zip(names.alias("name"), paragraphs.alias("parts")),
            lambda x: F.flatten(F.transform(x["parts"], lambda p: F.transform(split_sentences(p), lambda s: F.struct(s.alias("text"), heading_section(F.coalesce(x["name"], F.lit(""))).alias("section"), x["name"].alias("section_title"))))),
        )
    ).cast(SENTENCES)
