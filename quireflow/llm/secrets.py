"""Secret scan with corpus-wide ownership frequency, in DataFrame expressions alone.

Base patterns name assignments, access keys and hexadecimal runs; one more kind, ``opaque``, takes long tokens
that mix letters and digits and that no base span covers. Every candidate's hash is counted over the corpus by
distinct repositories and owners: a value that many owners or many repositories have is a copied example, one that
few have looks like a live credential of its owner. Base spans always stay; of opaque spans only those that look
live are added.

Counts are by value, owner and repository first, one row for each, so a common value is dealt out by its
repositories; then sums are combined before each shuffle. Values are joined back to their spans by a join that
adaptive execution splits. Texts are scanned once, never shuffled.

Edge cases: a null or empty text has no spans; a very long text is scanned whole, in time that grows with its
length; repeated rows are scanned one by one but count once as a repository; a null owner or repository counts as
none; an empty table gives no rows; other columns are ignored. Positions are code points, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group with the value, least characters of that value; maximal runs are asked for with their least length at once.
BASE = (("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]{14,}", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16))
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "opaque")
SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,hash:bigint>>"


def empty_spans() -> Column:
    return F.array().cast(SPAN)


def mixed(value: Column) -> Column:
    """Whether a token has a letter and a digit: one of letters alone is a long word, and one of digits alone a number."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]")


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int, accept: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches whose group has the least length and is accepted: start, rank of the kind, kind, end, hash.

    Matches and the text between them, taken by the same pattern, add up to the positions.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern if group else f"({pattern})"), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern if group else f"({pattern})"), F.lit(group or 1))
    between = F.split(text, pattern, -1)
    rank = KINDS.index(kind)
    steps = F.arrays_zip(between.alias("gap"), matches.alias("hit"), values.alias("value"))
    walked = F.aggregate(
        steps,
        F.struct(F.lit(0).cast("bigint").alias("at"), empty_spans().alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).cast("bigint").alias("at"),
            F.when(
                (F.length(x["value"]) >= least) & accept(x["value"]) if accept else F.length(x["value"]) >= least,
                F.concat(
                    acc["found"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(x["gap"])).cast("bigint").alias("start"),
                            F.lit(rank).alias("rank"),
                            F.lit(kind).alias("kind"),
                            (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).cast("bigint").alias("end"),
                            F.xxhash64(x["value"]).alias("hash"),
                        )
                    ).cast(SPAN),
                ),
            )
            .otherwise(acc["found"])
            .alias("found"),
        ),
        lambda acc: acc["found"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(empty_spans())


def uncovered(opaque: Column, base: Column) -> Column:
    apart = F.filter(opaque, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return F.when(F.size(opaque) > 0, apart).otherwise(empty_spans())


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(
    docs: DataFrame,
    text_col: str = "text",
    repo_col: str = "doc_id",
    owner_col: str = "source",
    keep: tuple[str, ...] = ("doc_id",),
    example_owners: int = 3,
    example_repos: int = 10,
) -> DataFrame:
    """Columns ``keep``, base and spans (arrays of start, rank, kind, end, hash), live and examples (likewise).

    A value that ``example_owners`` distinct owners or ``example_repos`` distinct repositories have is an example;
    live: spans of other values; examples: the rest of the spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        *[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)],
        F.col(repo_col).cast("string").alias("s_repo"),
        F.col(owner_col).cast("string").alias("s_owner"),
        F.concat(*[spans_of(text, *x) for x in BASE]).alias("base"),
        spans_of(text, "opaque", OPAQUE, 0, 20, mixed).alias("opaque"),
    )
    found = found.select("*", F.inline(F.array(F.struct(uncovered(F.col("opaque"), F.col("base")).alias("more"))))).drop("opaque")
    found = cut(found.withColumn("s_uid", F.monotonically_increasing_id()))
    hits = found.where((F.size("base") > 0) | (F.size("more") > 0))

    counts = (
        hits.select("s_repo", "s_owner", F.explode(F.array_distinct(F.transform(F.concat("base", "more"), lambda s: s["hash"]))).alias("hash"))
        .groupBy("hash", "s_owner", "s_repo")
        .agg(F.count("*").alias("rows"))
        .groupBy("hash", "s_owner")
        .agg(F.count("s_repo").alias("repos"))
        .groupBy("hash")
        .agg(F.count("s_owner").alias("owners"), F.sum("repos").alias("repos"))
    )
    each = hits.select("s_uid", F.explode(F.concat("base", "more")).alias("span")).select("s_uid", "span", F.col("span.hash").alias("hash"))
    widely = counts.where((F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)).select("hash", F.lit(True).alias("example"))
    told = each.join(widely, "hash", "left").groupBy("s_uid").agg(
        F.collect_list(F.when(F.col("example").isNull(), F.col("span"))).alias("live"),
        F.collect_list(F.when(F.col("example") & (F.col("span.kind") != "opaque"), F.col("span"))).alias("examples"),
    )
    kept = [f"k_{i}" for i in range(len(keep))]
    rest = found.where((F.size("base") == 0) & (F.size("more") == 0)).select(*kept, "base", empty_spans().alias("live"), empty_spans().alias("examples"))
    out = rest.unionByName(hits.join(told, "s_uid").select(*kept, "base", F.col("live").cast(SPAN), F.col("examples").cast(SPAN)))
    return out.select(
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)],
        F.array_sort("base").alias("base"),
        F.array_sort(F.concat("live", "examples")).alias("spans"),
        F.array_sort("live").alias("live"),
        F.array_sort("examples").alias("examples"),
    )


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, overlapping ones as one, replaced by a mark."""
    done = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
