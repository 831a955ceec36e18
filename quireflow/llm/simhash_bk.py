"""SimHash near-duplicates by sharded BK-trees.

A fingerprint has, for each of 64 bits, the majority of the XXH64 values of a text's word shingles. Two
fingerprints link at ``radius`` or fewer differing bits. Equal fingerprints are first taken together. Then the
bits are cut into blocks: of ``radius + extra`` blocks at least ``extra`` are equal in any two that link, so every
fingerprint goes to one shard for each choice of ``extra`` blocks, named by their values. A shard's fingerprints
form a BK-tree, children keyed by their integer Hamming distance to the parent; a search follows only the edges
within the radius of its own distance. Found members leave the tree, so a large group of near copies costs each
member the few that remain instead of all pairs, and a shard gives one link for each member to the first of its
group, never all pairs.

``extra`` is chosen by the number of distinct fingerprints so that shards stay small as the corpus grows. A shard
beyond ``shard_limit`` members is dealt out in tiles of two parts of it each, so no task takes an unbounded group;
each tile finds its own links. Groups are connected components of the links.

Edge cases: a null, empty or white text has fingerprint zero and links like any other; a text of fewer words than
a shingle is one shingle; rows with one doc_id keep their own fingerprints but share the smallest component of
them; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, maybe_broadcast
from .decontam import Powers, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash: a bit is 1 if it is set in over half of the shingles' XXH64 values."""
    from xxhash import xxh64_intdigest

    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    if len(words) <= size:
        return xxh64_intdigest(" ".join(words), seed)
    runs = map(" ".join, zip(*(words[k:] for k in range(size))))
    n = len(words) - size + 1
    h = np.fromiter((xxh64_intdigest(x, seed) for x in runs), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 8192):
        ones += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def word_print(words: np.ndarray) -> int:
    """The SimHash of the distinct ones of hashed words, as a signed long: a changed word changes one of them but several shingles."""
    h = np.unique(words)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 4, seed: int = 42, features: str = "shingles") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of shingles or of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            if features == "vocabulary":
                fp = np.array([word_print(word_hashes(x.as_py() or "", powers)) for x in batch.column(1)], dtype=np.int64)
            else:
                fp = np.array([fingerprint(x.as_py(), size, seed) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(radius: int, extra: int) -> list[int]:
    """Bit masks of every choice of ``extra`` of ``radius + extra`` blocks of the 64 bits."""
    n = radius + extra
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(blocks, extra)]


def extra_blocks(n: int, radius: int, shard_size: int = 64) -> int:
    """The fewest blocks that name a shard so that the n fingerprints, if they were even, make shards of that size."""
    return next((e for e in (1, 2, 3, 4) if n >> (64 * e // (radius + e)) <= shard_size), 4)


class BKTree:
    """Integers under Hamming distance, with search by radius that takes what it finds out of the tree."""

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = [{}]
        self.parent = [-1] * len(values)
        self.live = [True] * len(values)
        self.below = [1] * len(values)  # members still in the tree, from here on
        for k in range(1, len(values)):
            self.children.append({})
            at, v = 0, values[k]
            while True:
                d = (v ^ values[at]).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = k
                    self.parent[k] = at
                    break
                at = nxt
        for k in range(len(values) - 1, 0, -1):
            self.below[self.parent[k]] += self.below[k]

    def take(self, k: int) -> None:
        self.live[k] = False
        while k >= 0:
            self.below[k] -= 1
            k = self.parent[k]

    def search(self, value: int, radius: int) -> list[int]:
        found, stack = [], [0]
        while stack:
            at = stack.pop()
            if not self.below[at]:
                continue
            d = (value ^ self.values[at]).bit_count()
            if d <= radius and self.live[at]:
                found.append(at)
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)
        return found


def shard_links(values: list[int], radius: int, near: bool = False) -> list[tuple[int, int]]:
    """(member, first of its group) for the members of groups that links within the shard connect.

    near: the member that was within the radius of it in place of the first.
    """
    tree, links = BKTree(values), []
    for k, v in enumerate(values):
        if not tree.live[k]:
            continue
        tree.take(k)
        todo = [k]
        while todo:
            at = todo.pop()
            for m in tree.search(values[at], radius):
                tree.take(m)
                links.append((values[m], values[at] if near else v))
                todo.append(m)
    return links


def link_fingerprints(distinct: DataFrame, n: int, radius: int = 4, shard_limit: int = 4096, near: bool = False) -> DataFrame:
    """Links a, b that connect what is within the radius; distinct: fp, each once. near: only links within the radius."""
    masks = block_masks(radius, extra_blocks(n, radius))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("value")) for i, m in enumerate(signed)])
    sharded = distinct.select("fp", F.inline(keys))
    # shards with one member have no links; of those over the limit, members go to tiles (i, j) of two parts
    sizes = sharded.groupBy("block", "value").agg(F.count("*").alias("size")).where("size > 1")
    large = cut(sizes.where(F.col("size") > shard_limit))
    if large.isEmpty():
        tiled = sharded.select("fp", "block", "value", F.lit(0).alias("i"), F.lit(0).alias("j"))
    else:
        sharded = sharded.join(large, ["block", "value"], "left")
        parts = F.ceil(F.col("size") / (shard_limit // 2)).cast("int")
        part = F.pmod(F.xxhash64("fp"), parts).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(part, j).alias("i"), F.greatest(part, j).alias("j")))
        tiles = F.when(F.col("size").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(tiles)
        tiled = sharded.select("fp", "block", "value", F.inline(tiles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []

        def links(found: list[int]) -> list[tuple[int, int]]:
            return shard_links([v & (1 << 64) - 1 for v in found], radius, near) if len(found) > 1 else []

        def batch_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            out: list[tuple[int, int]] = []
            for *k, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if k != key:
                    out += links(members)
                    key, members = k, []
                members.append(fp)
            yield batch_of(out)
        yield batch_of(links(members))

    dealt = tiled.repartition("block", "value", "i", "j").sortWithinPartitions("block", "value", "i", "j", "fp")
    return dealt.select("block", "value", "i", "j", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 4, radius: int = 4, shard_limit: int = 4096, features: str = "shingles") -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach from the row's fingerprint."""
    prints = cut(fingerprints(docs, text_col, id_col, size, features=features))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    distinct = cut(distinct)
    n = distinct.count()
    links = cut(link_fingerprints(distinct.select("fp"), n, radius, shard_limit).distinct())
    roots = components(links) if not links.isEmpty() else None
    if roots is None:
        first = distinct.select("fp", F.col("first").alias("component_id"))
    else:
        # most fingerprints have no links; only those that do are dealt out by their root
        roots = cut(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
        linked = cut(distinct.join(maybe_broadcast(roots), distinct.fp == roots.node).select("fp", "first", "root"))
        low = cut(linked.groupBy("root").agg(F.min("first").alias("component_id")))
        named = linked.join(maybe_broadcast(low), "root").select("fp", F.col("component_id").alias("named"))
        first = distinct.join(maybe_broadcast(cut(named)), "fp", "left").select("fp", F.coalesce("named", "first").alias("component_id"))
    return prints.join(cut(first), "fp").select("doc_id", "fp", "component_id")
