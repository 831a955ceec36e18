"""Quality rules with distribution divergence, in DataFrame expressions alone.

A document's histograms of character classes and of its language's common words are compared with those of all
documents of that language by Jensen-Shannon distance; below a minimum length a histogram says too little and is
not judged. Base rules on length and repetition go first.

The references are sums over all documents that the base rules keep, then once more over those of them that are
near the first sums, so that junk doesn't blur what it is measured against. How far a document may be depends on
its length: a share of n things strays by about one in the root of n. Common-word candidates are words of up to ``max_word_chars``
characters, counted over all documents, the ``top_words`` most frequent of each language; the bins are the candidates of
all languages and a rest. The text is read once; each document's counts of short words are written, and candidates,
references and distances are joins of those, so any number of languages has references.

Edge cases: a null or empty text has no words and fails the base rule; a document whose language is null has no
reference and is judged by the base rules alone; very long texts are read whole; repeated rows are judged one by one;
an empty table gives no rows; columns with other names are carried or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WS, cut, maybe_broadcast

SYMBOLS = "#*$%&|<>"
#: Character classes, each by a Java expression; what none of them names is the last class.
CLASSES = {"lower": r"\p{Ll}", "upper": r"\p{Lu}", "digit": r"\p{Nd}", "stop": r"[.,;:?'\"()-]", "shout": r"[!#*$%&+@]", "bars": r"[|<>_=~^/\\{}\[\]]"}


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{WS}]+"), "")


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that later expressions read as values: a generator of one row keeps the optimiser from repeating them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def repeat_words(df: DataFrame) -> DataFrame:
    """Adds q_repeat: positions of words in windows of five words that occur twice or more in the document.

    q_word_hash has the words' hashes, so that words are hashed once; a window's hash is of its words' hashes.
    """
    n = F.size("q_word_hash")
    window = lambda i: F.xxhash64(*[F.get(F.col("q_word_hash"), i + k) for k in range(5)])
    hashes = F.when(n > 5, F.transform(F.sequence(F.lit(0), n - 5), window)).otherwise(F.array().cast("array<bigint>"))
    df = barrier(df, q_hash=hashes).drop("q_word_hash")
    again = F.size(F.array_distinct("q_hash")) < F.size("q_hash")
    keyed = F.when(again, F.array_sort(F.transform("q_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.lit(None))
    df = barrier(df, q_keyed=keyed).drop("q_hash")
    pairs = F.zip_with(F.slice("q_keyed", 1, F.greatest(F.size("q_keyed") - 1, F.lit(1))), F.slice("q_keyed", 2, F.greatest(F.size("q_keyed"), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.array_sort(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    df = barrier(df, q_starts=F.when(F.col("q_keyed").isNotNull(), starts)).drop("q_keyed")
    steps = F.aggregate(
        "q_starts",
        F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(-5).alias("last")),
        lambda acc, s: F.struct((acc["sum"] + F.least(F.lit(5), s - acc["last"])).alias("sum"), s.alias("last")),
        lambda acc: acc["sum"],
    )
    return df.withColumn("q_repeat", F.coalesce(F.when(F.size("q_starts") > 0, steps), F.lit(0)).cast("bigint")).drop("q_starts")


def class_counts(df: DataFrame, chars: str) -> DataFrame:
    """Replaces a column without white space by q_classes, characters of each class and the rest, and n_symbols.

    Each class is taken out of what the ones before it left, so only the first reads all characters.
    """
    first, *others = CLASSES.values()
    df = barrier(df, q_chars=F.length(chars).cast("bigint"), q_left=F.regexp_replace(F.col(chars), f"{first}+", "")).drop(chars)
    left = F.col("q_left")
    counts = [F.col("q_chars") - F.length(left)]
    for p in others:
        rest = F.regexp_replace(left, f"{p}+", "")
        counts.append((F.length(left) - F.length(rest)).cast("bigint"))
        left = rest
    symbols = (F.length("q_left") - F.length(F.translate("q_left", SYMBOLS, ""))).cast("bigint")
    return df.withColumns({"q_classes": F.array(*counts, F.length(left).cast("bigint")), "n_symbols": symbols}).drop("q_left")


def js(p: Column, q: Column) -> Column:
    """A bin's part of the Jensen-Shannon divergence in bits, of the shares p and q."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return (part(p) + part(q)) / 2


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)


def divergence(counts: str, reference: str, n: str, of: str) -> Column:
    """Jensen-Shannon distance (0 to 1) of two columns with counts over the same bins and with totals n and of; 0 if either total is."""
    bins = F.zip_with(counts, reference, lambda a, b: js(a / F.col(n), b / F.col(of)))
    return F.when((F.col(n) > 0) & (F.col(of) > 0), F.sqrt(F.greatest(F.lit(0.0), total(bins)))).otherwise(F.lit(0.0))


def word_counts(df: DataFrame, max_word_chars: int) -> DataFrame:
    """Replaces q_short, lower-case words in order, by their distinct ones of up to max_word_chars characters with counts."""
    new = F.transform("q_short", lambda w, i: F.when((i == 0) | (F.get("q_short", i - 1) != w), i))
    df = barrier(df, q_new=F.filter(new, lambda i: i.isNotNull()))
    until = lambda k: F.coalesce(F.get("q_new", k + 1), F.size("q_short"))
    counts = F.transform("q_new", lambda i, k: F.struct(F.get("q_short", i).alias("word"), (until(k) - i).cast("bigint").alias("n")))
    return df.withColumn("q_short", F.filter(counts, lambda x: F.length(x["word"]).between(1, max_word_chars))).drop("q_new")


def common_words(counted: DataFrame, top_words: int) -> DataFrame:
    """word: the top_words most frequent short words of each language, over all rows of counted(lang, q_short)."""
    counts = counted.select("lang", F.inline("q_short")).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= top_words)
    return cut(ranked.select("word").distinct())


def judge_quality(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    top_words: int = 12,
    max_word_chars: int = 4,
    min_chars: int = 120,
    min_common_words: int = 60,
    class_limit: tuple[float, float] = (0.21, 2.2),
    word_limit: tuple[float, float] = (0.26, 1.6),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Columns ``keep``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance, kept. A distance is null where the document is too short for it."""
    renamed = [F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)]
    src = docs.select(*renamed, F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).alias("lang"))

    # all that reads the words or the text does so in one step: what later steps carry is copied with each
    df = barrier(src, q_words=words_of(F.col("text")))
    df = barrier(
        df,
        q_n=F.size("q_words").cast("bigint"),
        q_joined=F.array_join("q_words", ""),
        q_word_hash=F.transform("q_words", lambda w: F.xxhash64(w)),
        q_short=F.sort_array(F.transform(F.filter("q_words", lambda w: F.length(w) <= max_word_chars), F.lower)),
        q_lines=F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{WS}]")),
    ).drop("q_words", "text")
    df = df.withColumn("n_dup_lines", (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("bigint")).drop("q_lines")
    df = repeat_words(class_counts(word_counts(df, max_word_chars), "q_joined"))
    df = df.select(
        F.monotonically_increasing_id().alias("uid"),
        *[f"k_{i}" for i in range(len(keep))],
        "lang",
        F.col("q_n").alias("n_words"),
        F.col("q_chars").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        F.col("q_repeat").alias("n_repeat_words"),
        "q_classes",
        "q_short",
    )
    df = cut(df)
    vocabulary = maybe_broadcast(common_words(df, top_words))

    found = lambda rows: rows.where("lang IS NOT NULL").select("uid", "lang", "n_words", F.inline("q_short")).join(vocabulary, "word")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    far = F.coalesce(F.col("class_distance") > class_limit[0] + class_limit[1] / F.sqrt("word_chars"), F.lit(False))
    far = far | F.coalesce(F.col("word_distance") > word_limit[0] + word_limit[1] / F.sqrt("n_words"), F.lit(False))

    def judged(near: DataFrame) -> DataFrame:
        """df with distances from the sums over near."""
        shares = cut(found(near).groupBy("lang", "word").agg(F.sum("n").alias("r")))
        sums = near.where("lang IS NOT NULL").groupBy("lang").agg(
            F.array(*[F.sum(F.col("q_classes")[i]) for i in range(len(CLASSES) + 1)]).alias("r_classes"),
            F.sum("word_chars").alias("r_chars"),
            F.sum("n_words").alias("r_words"),
        )
        sums = maybe_broadcast(cut(sums.join(shares.groupBy("lang").agg(F.sum("r").alias("r_common")), "lang", "left")))
        # a bin that a document lacks adds half its share in the reference; each of the others has that taken off
        of = shares.join(sums.select("lang", "r_words"), "lang").select("lang", "word", (F.col("r") / F.col("r_words")).alias("q"))
        of = maybe_broadcast(of)
        q = F.coalesce("q", F.lit(0.0))
        parts = found(df).join(of, ["lang", "word"], "left").groupBy("uid").agg(F.sum("n").alias("w_n"), F.sum(js(F.col("n") / F.col("n_words"), q) - q / 2).alias("w_part"))
        rest_p = 1 - F.coalesce("w_n", F.lit(0)) / F.col("n_words")
        rest_q = 1 - F.coalesce("r_common", F.lit(0)) / F.col("r_words")
        words = F.coalesce("w_part", F.lit(0.0)) + js(rest_p, rest_q) - rest_q / 2 + 0.5
        return barrier(
            df.join(sums, "lang", "left").join(parts, "uid", "left"),
            class_distance=F.when(F.col("lang").isNotNull() & (F.col("word_chars") >= min_chars), divergence("q_classes", "r_classes", "word_chars", "r_chars")),
            word_distance=F.when(
                F.col("lang").isNotNull() & (F.col("n_words") >= min_common_words),
                F.when((F.col("n_words") > 0) & (F.col("r_words") > 0), F.sqrt(F.greatest(F.lit(0.0), words))).otherwise(F.lit(0.0)),
            ),
        )

    good = df.where(~failed)
    strays = maybe_broadcast(cut(judged(good).where(~failed & far).select("uid")))
    return judged(good.join(strays, "uid", "left_anti")).select(
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "class_distance", "word_distance", (~failed & ~far).alias("kept"),
    )
