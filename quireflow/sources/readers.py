"""Readers. Each gives a lazy DataFrame with a stated schema."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.frames import lookup
from ..functions.scores import term_confidence
from ..functions.text import as_bool, as_float, as_int, canonical_section, first_present, html_text, keyphrase_list, safe_name

SENTENCE = "struct<text:string,section:string,role:string,evidence_label:double,importance_label:double,section_title:string,source:string,sentence_index:int>"
STRUCTURED = f"doc_id string, title string, abstract string, sentences array<{SENTENCE}>, summaries map<string,string>, source string"


def stem(path: Column) -> Column:
    """A file's name without folder and extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def texts(spark: SparkSession, path: str, pattern: str = "*.txt", names: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """doc_id, text, path of whole files, invalid bytes dropped; of the named ones only, the first ``limit`` by path.

    Raises FileNotFoundError if a named file isn't there.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    if names:
        files = files.where(name.isin(names))
        missing = set(names) - {r[0] for r in files.select(name).distinct().collect()}
        if missing:
            raise FileNotFoundError("missing input files: " + "; ".join(sorted(missing)))
    if limit is not None:
        files = files.orderBy("path").limit(limit)
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return files.select(stem(F.col("path")).alias("doc_id"), text.alias("text"), "path")


def json_lines(spark: SparkSession, path: str, schema: str = STRUCTURED, limit: int | None = None) -> DataFrame:
    """Records of a JSON lines file; blank lines are skipped."""
    df = spark.read.schema(schema).json(path)
    return df.limit(limit) if limit is not None else df


def with_sentences(docs: DataFrame) -> DataFrame:
    """Documents with at least one sentence that isn't blank."""
    return docs.where(F.exists("sentences", lambda s: F.trim(s["text"]) != ""))


def strings_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with header as strings; columns that it lacks are empty, a byte order mark is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns])


SECTION_COLUMNS = [
    "section_mapped", "section", "section_original", "canonical_term", "display_term", "term", "normalized_term", "matched_surface_terms", "search_terms", "source_corpus",
    "wikidata_id", "wiki_category", "term_type", "role_prior", "is_generic", "document_frequency", "total_frequency", "confidence_score",
]


def section_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """term_id, section, canonical_term, aliases, confidence, is_generic, document_frequency, total_frequency, role_prior, wiki_category.

    Rows without a term are skipped. Aliases are all spellings of a row, those of more words and characters first.
    """
    r = strings_csv(spark, path, SECTION_COLUMNS).withColumn("term_id", F.monotonically_increasing_id())
    generic = as_bool("is_generic")
    lists = F.concat(*[F.transform(F.split(c, ";"), lambda x: F.trim(x)) for c in ("matched_surface_terms", "search_terms")])
    canonical = first_present("canonical_term", "display_term", "term", "normalized_term")
    spellings = F.filter(F.array_distinct(F.concat(F.array(canonical, *[F.trim(c) for c in ("display_term", "term", "normalized_term", "canonical_term")]), lists)), lambda a: a.isNotNull() & (a != ""))
    ordered = F.transform(F.array_sort(F.transform(spellings, lambda a: F.struct((-F.size(F.split(a, r"\s+"))).alias("w"), (-F.length(a)).alias("n"), a.alias("a")))), lambda x: x["a"])
    return r.select(
        "term_id", canonical_section(first_present("section_mapped", "section", "section_original")).alias("section"), canonical.alias("canonical_term"), ordered.alias("aliases"),
        term_confidence(F.col("confidence_score"), F.col("source_corpus"), F.col("wikidata_id"), generic).alias("confidence"), generic.alias("is_generic"),
        as_int("document_frequency").alias("document_frequency"), as_int("total_frequency").alias("total_frequency"), "role_prior", "wiki_category",
    ).where("canonical_term is not null")


def cue_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return strings_csv(spark, path, ["cue_phrase", "evidence_type", "role_prior", "section_hint", "notes"]).where("trim(cue_phrase) <> ''")


def matrix(spark: SparkSession, path: str, doc_ids: list[str] | None = None) -> DataFrame:
    """A wide document-term CSV as doc_id, section, term, value; only the named documents if any."""
    from ..operators.stats import unpivot_matrix

    wide = spark.read.option("header", True).csv(path)
    wide = wide.toDF(*[c.lstrip("\ufeff") for c in wide.columns])
    return unpivot_matrix(wide.where(F.col("document").isin(doc_ids)) if doc_ids else wide)


def external_evidence(spark: SparkSession, path: str, doc_id: str | None = None) -> DataFrame:
    r = strings_csv(spark, path, ["document_id", "section_original", "section_mapped", "sentence", "evidence_type", "matched_cue", "role_prior", "confidence"])
    r = r.where("trim(sentence) <> ''").withColumn("confidence", as_float("confidence")).withColumn("section", canonical_section(first_present("section_mapped", "section_original")))
    return r.where(F.col("document_id") == doc_id) if doc_id is not None else r


def parse_labelled_lines(contents: DataFrame, source: str = "pubmed_rct") -> DataFrame:
    """doc_id, sentence_index, text, section, role, source of whole files (value) of ###id lines, LABEL<tab>sentence lines and blanks.

    Documents are cut within the row, so no order over lines is needed.
    """
    parts = F.filter(F.split("value", r"(?m)^\s*(?=###)"), lambda p: F.ltrim(p).startswith("###"))
    doc = contents.select(F.explode(parts).alias("p")).select(F.trim(F.regexp_extract("p", r"^\s*#+([^\n]*)", 1)).alias("doc_id"), F.split("p", "\n").alias("l"))
    lines = F.filter(F.transform("l", lambda x: F.trim(x)), lambda x: ~x.startswith("###") & (F.instr(x, "\t") > 0))
    rows = doc.select("doc_id", F.posexplode(lines).alias("sentence_index", "x")).withColumn("label", F.upper(F.substring_index("x", "\t", 1)))
    section, role = ({k: v[i] for k, v in rules.PUBMED_LABELS.items()} for i in (0, 1))
    return rows.select(
        "doc_id", "sentence_index", F.expr("substring(x, instr(x, '\t') + 1)").alias("text"), F.coalesce(lookup(section, F.col("label")), F.lit("intro")).alias("section"),
        F.coalesce(lookup(role, F.col("label")), F.lit("background")).alias("role"), F.lit(source).alias("source"),
    )


def labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_labelled_lines(spark.read.text(path, wholetext=True))


def keyphrase_records(raw: DataFrame) -> DataFrame:
    """doc_id, title, abstract, full_text, keyphrases of records under any of several field names; lists or ; | text."""
    has = set(raw.columns)
    text = lambda *names: first_present(*[F.col(n).cast("string") for n in names if n in has], F.lit(" "))
    kinds = dict(raw.dtypes)
    name = next((n for n in ("keyphrases", "keywords", "extractive_keyphrases", "present_kps") if n in has), None)
    phrases = F.array().cast("array<string>") if name is None else F.col(name) if kinds[name].startswith("array") else keyphrase_list(name)
    return raw.select(
        F.coalesce(text("doc_id", "id", "paper_id"), F.lit("")).alias("doc_id"), F.coalesce(text("title", "name"), F.lit("")).alias("title"), F.coalesce(text("abstract", "summary"), F.lit("")).alias("abstract"),
        F.coalesce(text("full_text", "text", "body"), F.lit("")).alias("full_text"), F.filter(F.transform(phrases, lambda x: F.trim(x)), lambda p: p != "").alias("keyphrases"),
    )


def first_readable(spark: SparkSession, paths: list[str], reader) -> tuple[DataFrame | None, list[str]]:
    """The first path that reader(spark, path) can read, and the errors of those before."""
    errors = []
    for p in paths:
        try:
            return reader(spark, p), errors
        except (AnalysisException, FileNotFoundError) as e:
            errors.append(f"{p}: {str(e).splitlines()[0]}")
    return None, errors


def optional(spark: SparkSession, path: str | None, schema: str, reader) -> DataFrame:
    """reader's rows, or none with that schema if there is no such path."""
    if path:
        try:
            return reader(spark, path)
        except (AnalysisException, FileNotFoundError):
            pass
    return spark.createDataFrame([], schema)


def html_documents(pages: DataFrame) -> DataFrame:
    """doc_id, text of HTML pages: the stand-in for PDF text, for which no library is at hand."""
    return pages.select(F.col("page_id").cast("string").alias("doc_id"), html_text("html").alias("text"))


def report_summary(reports: DataFrame, titles: list[str], text_col: str = "text") -> DataFrame:
    """Adds parts: the blocks under the ### headings of those titles in a Markdown report, by title."""
    quoted = [(t, rf"(?s)###\s*{t}\s*\n(.*?)(?=\n###|\z)") for t in titles]
    return reports.withColumn("parts", F.map_from_arrays(F.array(*[F.lit(t) for t in titles]), F.array(*[F.btrim(F.regexp_extract(text_col, p, 1), F.lit(" \t\r\n")) for _, p in quoted])))


def named(df: DataFrame, column: str) -> DataFrame:
    """Adds file_name: a safe name from a title or id."""
    return df.withColumn("file_name", safe_name(column))
