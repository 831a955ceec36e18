"""URL filtering by allow and block rules and, where none fits, by a Bloom filter cascade over listed hosts.

The keys are all suffixes, at label borders, of all hosts of the corpus: the complete key universe. Level 0 of the
cascade encodes the listed keys, level 1 the other keys that level 0 takes for listed, level 2 the listed keys
that level 1 takes for its own, and so on until a level takes none wrongly. Membership of any key of the universe
is then exact: the first level that does not hold a key decides by its parity. A row is judged by constants in
its own expression, without a join. All of it is DataFrame expressions.

Filter bits are the only thing that comes to the driver; their size is bounded by ``max_filter_bytes``. A longer
list is judged by joins on distinct hosts.

Edge cases: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; hosts and
lists compare with A-Z in lower case; repeated rows are judged one by one; an empty table gives no rows; other
columns are carried only if named in ``keep``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts of the corpus whose first label has one of these words make the default list.
SPAM_TERMS = ("casino", "pills", "spam", "viagra", "porn", "betting")
#: kind, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and each of its parents: a.b.c, b.c, c."""
    labels = F.split(host, r"\.")
    return F.when(host != "", F.transform(labels, lambda x, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The rule of most characters that fits (on ties the longer host, then block), and its kind; nulls if none."""
    rule, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    order = sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == "block", r[1:]))
    for k, h, p in order:  # the last one set wins
        h = h.lower()
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, kind = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(k)).otherwise(kind)
    return rule, kind


@dataclass(frozen=True)
class Level:
    bits: bytes
    hashes: int
    seed: int

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.seed + j)), F.lit(8 * len(self.bits))) for j in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        data, out = F.lit(self.bits), F.lit(True)
        for at in self.positions(key):
            byte = F.conv(F.hex(F.substring(data, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & (F.getbit(byte.cast("bigint"), (at % 8).cast("int")) == 1)
        return out


def encode_level(keys: DataFrame, n: int, seed: int, bits_per_key: float, hashes: int) -> Level:
    size = max(8, math.ceil(n * bits_per_key / 8))
    level = Level(bytes(size), hashes, seed)
    at = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("at"))
    rows = at.groupBy(F.floor(F.col("at") / 8).alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(at % 8 as int))")).alias("bits")).collect()
    data = bytearray(size)
    for r in rows:
        data[r["byte"]] = r["bits"]
    return Level(bytes(data), hashes, seed)


class Cascade:
    """Exact membership of the keys of a universe."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, universe: DataFrame, bits_per_key: float = 8.0, hashes: int = 4, max_levels: int = 48) -> Cascade:
        """universe: key, listed; each key once. The sets shrink from level to level by the filters' error rate."""
        levels: list[Level] = []
        own, other = universe.where("listed").select("key"), universe.where("not listed").select("key")
        n = own.count()
        while n:
            if len(levels) == max_levels:
                raise RuntimeError("the cascade doesn't end")
            levels.append(encode_level(own, n, 1000 * (len(levels) + 1), bits_per_key, hashes))
            wrong = cut(other.where(levels[-1].holds(F.col("key"))))
            own, other, n = wrong, own, wrong.count()
        return cls(levels)

    def holds(self, key: Column) -> Column:
        """Whether the key is listed: level 0 says no: not listed; level 1 says no: listed; and so on."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(~self.levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def key_universe(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Every host suffix of the corpus once; hosts are made distinct before they are taken apart."""
    hosts = pages.select(host_of(F.col(url_col)).alias("host")).where("host <> ''").distinct()
    return hosts.select(F.explode(suffixes(F.col("host"))).alias("key")).distinct()


def listed_by_terms(universe: DataFrame, terms: tuple[str, ...] = SPAM_TERMS) -> DataFrame:
    first = F.split(F.element_at(F.split("key", r"\."), 1), "[-_]")
    return universe.where(F.arrays_overlap(first, F.array(*map(F.lit, terms)))).select("key")


def filter_urls(
    pages: DataFrame,
    listed: DataFrame | None = None,
    url_col: str = "url",
    rules: tuple = RULES,
    keep: tuple[str, ...] = ("page_id",),
    bits_per_key: float = 8.0,
    max_filter_bytes: int = 4 << 20,
) -> DataFrame:
    """Columns ``keep``, host, path, rule, listed (whether the cascade holds a suffix of the host), verdict.

    listed: a table of blocked hosts in the column key (with all subdomains); null: hosts of the corpus by SPAM_TERMS.
    """
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    universe = cut(key_universe(pages, url_col))
    names = listed_by_terms(universe) if listed is None else listed.select(F.translate(F.col("key"), UPPER, LOWER).alias("key")).where("key is not null").distinct()
    flagged = cut(universe.join(names.withColumn("listed", F.lit(True)), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")))
    base = pages.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)], host.alias("host"), path.alias("path"))
    if flagged.where("listed").count() * bits_per_key / 8 <= max_filter_bytes:
        cascade = Cascade.build(flagged, bits_per_key)
        judged = base.withColumn("listed", F.exists(suffixes(F.col("host")), cascade.holds))
    else:
        bad = base.select("host").distinct().select("host", F.explode(suffixes(F.col("host"))).alias("key")).join(flagged.where("listed"), "key", "left_semi")
        judged = base.join(bad.select("host").distinct().withColumn("listed", F.lit(True)), "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    rule, kind = matching_rule(F.col("host"), F.col("path"), rules)
    return judged.select(
        *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "host", "path", rule.alias("rule"), "listed",
        F.coalesce(kind, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
