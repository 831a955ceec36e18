"""Text normalisation, tokens, n-grams and sentence splitting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .frames import lookup


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    """White space of any kind as single spaces, trimmed."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def normalize(c: Column | str) -> Column:
    """Lower case, a-z 0-9 _ + - kept, all else one space."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9_+\-]+", " "))


def normalize_term(c: Column | str) -> Column:
    """As normalize, without the underscore; null is empty and byte order marks vanish."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "\ufeff", ""), r"[^a-z0-9+\-]+", " "))


def normalize_match(c: Column | str) -> Column:
    """Letters and digits only."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def words(c: Column | str) -> Column:
    """Words between white space."""
    return F.filter(F.split(squeeze(c), " "), lambda w: w != "")


def tokens(c: Column | str) -> Column:
    """Normalised tokens."""
    return F.filter(F.split(normalize(c), " "), lambda w: w != "")


def rouge_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(normalize(c), F.lit("([a-z0-9]+)"), F.lit(1))


def context_words(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"([a-z0-9+\-]+)"), F.lit(1))


def ngrams(array: Column, n: int) -> Column:
    """Runs of n tokens, space-joined, in order. ``array`` should be a plain column: it is read in a lambda."""
    last = F.size(array) - (n - 1)
    runs = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(array, i, n), " "))
    return F.when(last >= 1, runs).otherwise(F.array().cast("array<string>"))


def chunk_words(array: Column, size: int) -> Column:
    """Tiles of ``size`` words."""
    tiles = F.transform(F.sequence(F.lit(0), F.size(array) - 1, F.lit(size)), lambda i: F.array_join(F.slice(array, i + 1, size), " "))
    return F.when(F.size(array) > 0, tiles).otherwise(F.array().cast("array<string>"))


def split_sentences(c: Column | str, fallback_words: int = 80) -> Column:
    """Splits after . ! ? before a capital, digit or parenthesis; unpunctuated text of over twice ``fallback_words`` becomes tiles of so many words."""
    whole = squeeze(c)
    pieces = F.filter(F.transform(F.split(whole, r"(?<=[.!?])\s+(?=[A-Z0-9(])"), lambda x: F.trim(x)), lambda p: p != "")
    parts = F.filter(F.split(whole, " "), lambda w: w != "")
    tiles = F.filter(F.split(F.regexp_replace(whole, rf"((?:[^ ]+ ){{{fallback_words - 1}}}[^ ]+) ", "$1\u0001"), "\u0001"), lambda p: p != "")
    return F.when((F.size(pieces) <= 1) & (F.size(parts) > 2 * fallback_words), tiles).otherwise(pieces)


def split_sentences_browser(c: Column | str) -> Column:
    """The stricter variant: only capitals start a sentence, and pieces of up to 15 characters go."""
    return F.filter(F.transform(F.split(squeeze(c), r"(?<=[.?!])\s+(?=[A-Z])"), lambda x: F.trim(x)), lambda p: F.length(p) > 15)


def clean_lines(c: Column | str) -> Column:
    """Lines at LF, CR or form feed, squeezed, without byte order marks."""
    lines = F.split(F.regexp_replace(F.regexp_replace(col(c), "\r\n", "\n"), "[\r\f]", "\n"), "\n")
    return F.transform(lines, lambda x: F.regexp_replace(squeeze(x), "^\ufeff+|\ufeff+$", ""))


def normalize_heading(c: Column | str) -> Column:
    """A heading without its number, closing mark or symbols."""
    out = F.regexp_replace(F.lower(col(c)), r"^\s*(?:\d+(?:\.\d+)*|[a-z])\.?\s+", "")
    out = F.regexp_replace(out, r"[:.]\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9+\-\s]", " "), r"\s+", " "))


def heading_section(c: Column | str) -> Column:
    """The section whose words a heading contains; intro if none."""
    h = normalize_heading(c)
    out = F.lit("intro")
    for section, cues in reversed(list(rules.HEADING_WORDS.items())):
        out = F.when(h.rlike("|".join(cues)), F.lit(section)).otherwise(out)
    return out


def canonical_section(c: Column | str) -> Column:
    key = F.trim(F.lower(F.coalesce(col(c), F.lit(""))))
    return F.coalesce(F.when(key.isin(rules.SECTIONS), key), lookup(rules.SECTION_ALIASES, key), F.lit("intro"))


def canonical_role(c: Column | str) -> Column:
    key = F.trim(F.lower(F.coalesce(col(c), F.lit(""))))
    return F.when(key.isin(rules.ROLES), key).otherwise(F.lit("none"))


def alias_variants(c: Column | str) -> Column:
    """The normalised term and its variants with hyphens for spaces and spaces for hyphens."""
    t = normalize_term(c)
    return F.filter(F.array_distinct(F.array(t, F.replace(t, F.lit("-"), F.lit(" ")), F.replace(t, F.lit(" "), F.lit("-")))), lambda x: x != "")


def keyphrase_list(c: Column | str) -> Column:
    """Phrases between semicolons or else bars, trimmed."""
    x = col(c)
    parts = F.when(F.instr(x, ";") > 0, F.split(x, ";")).when(F.instr(x, "|") > 0, F.split(x, r"\|")).otherwise(F.array(x))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda p: p != "")


def first_present(*cs: Column | str) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(col(c)) != "", col(c)) for c in cs])


def bio_prefix(c: Column | str) -> Column:
    t = F.upper(F.trim(F.coalesce(col(c), F.lit(""))))
    return F.when(t.startswith("B"), F.lit("B")).when(t.startswith("I"), F.lit("I")).otherwise(F.lit("O"))


def as_float(c: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(col(c).try_cast("double"), F.lit(default))


def as_int(c: Column | str, default: int = 0) -> Column:
    return F.coalesce(col(c).try_cast("double").try_cast("int"), F.lit(default))


def as_bool(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(c))).isin("1", "true", "yes", "y"), F.lit(False))


def safe_name(c: Column | str, default: str = "paper") -> Column:
    out = F.regexp_replace(F.regexp_replace(col(c), "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.when(out != "", out), F.lit(default))


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col(c))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clean_title(c: Column | str) -> Column:
    out = squeeze(F.translate(F.regexp_replace(col(c), r"^\d{4}_", ""), "_", " "))
    return F.when(out != "", out).otherwise(F.lit("the paper"))


def trim_words(c: Column | str, limit: int) -> Column:
    """The first ``limit`` words, with an ellipsis if there are more."""
    w = F.split(col(c), " ")
    cut = F.concat(F.regexp_replace(F.array_join(F.slice(w, 1, limit), " "), "[ ,;:]+$", ""), F.lit(" ..."))
    return F.when(F.size(w) <= limit, col(c)).otherwise(cut)


def join_terms(array: Column) -> Column:
    """a; a and b; a, b, and c."""
    n = F.size(array)
    return (
        F.when(n == 0, F.lit(""))
        .when(n == 1, F.element_at(array, 1))
        .when(n == 2, F.array_join(array, " and "))
        .otherwise(F.concat(F.array_join(F.slice(array, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), F.element_at(array, -1)))
    )


def query_keywords(c: Column | str, limit: int = 12) -> Column:
    """Content words of a question and the pairs of them, pairs first."""
    found = F.filter(F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z][a-z0-9\\-']+)"), F.lit(1)), lambda t: ~t.isin(rules.QUERY_STOPWORDS) & (F.length(t) > 2))
    pairs = F.zip_with(found, F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    pairs = F.slice(pairs, 1, F.greatest(F.size(found) - 1, F.lit(0)))
    return F.slice(F.array_distinct(F.concat(pairs, found)), 1, limit)


def html_text(c: Column | str) -> Column:
    """Text of markup without scripts and styles, as a stand-in where no PDF reader is at hand."""
    out = F.regexp_replace(col(c), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return squeeze(F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " "))
