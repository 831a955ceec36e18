"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles, in powers of two. For each partition of up to u shingles a
document is seen as overlapping windows of 2u shingles, one at every u, so an item lies whole in one window and
its Jaccard similarity to it is near one half however long the document is. Signatures are one-permutation
MinHashes: the least value in each of ``bins`` ranges of a shingle's hash. A document and an item are a
candidate pair if a window and the item agree in a bin. A document's shingles are hashed once; a window's
minimum is only worked out for values that are an item's minimum, which gives the same pairs as full signatures.
Candidates are verified by exact containment: the share of the item's distinct shingles in the whole document.

Benchmarks come to the driver in blocks of at most ``block_bytes`` of text, each a pass over the documents, so
what is sent to the executors is bounded. Documents are never shuffled.

Edge cases: null, empty or white texts match nothing; an item of fewer words than a shingle is one shingle of its
own length; repeated rows give one row; a null doc_id or item_id stays null; empty tables give no rows; other
columns are ignored. Words are split at white space and compared in lower case.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xBF58476D1CE4E5B9)
BLANK = np.zeros(256, dtype=bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            grow = lambda b: np.cumprod(np.append(np.uint64(1), np.full(2 * n, b, dtype=np.uint64)))
            self.up, self.down = grow(BASE), grow(BASE_INVERSE)
        return self.up[:n], self.down[:n]


def word_hashes(text: str, powers: Powers) -> np.ndarray:
    """A hash of each word, from prefix sums of a polynomial over the bytes."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    inside = np.concatenate(([False], ~BLANK[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not starts.size:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers.upto(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)])))
    return mixed((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        h = (h + words[k : k + n]) * BASE
    return mixed(h)


def shingles(words: list[str], size: int) -> set[str]:
    return set(map(" ".join, zip(*(words[k:] for k in range(size))))) if len(words) >= size else set()


class Index:
    """Signatures of items by (shingle length, size class)."""

    def __init__(self, items: list[tuple], size: int, bins: int):
        powers = Powers()
        self.shift = np.uint64(64 - (bins - 1).bit_length())
        self.exact: list[tuple] = []
        self.classes: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for key, text in items:
            words = WORD.findall((text or "").lower())
            if not words:
                continue
            length = min(size, len(words))
            own = shingles(words, length)
            hashes = np.unique(shingle_hashes(word_hashes(text, powers), length))
            _, first = np.unique(hashes >> self.shift, return_index=True)  # sorted: the first of a bin is its least
            bound = 1 << (len(hashes) - 1).bit_length()
            for h in hashes[first].tolist():
                self.classes[length, bound][h].append(len(self.exact))
            self.exact.append((key, own, length))
        self.classes = {k: dict(v) for k, v in self.classes.items()}
        self.sorted = {k: np.array(sorted(v), dtype=np.uint64) for k, v in self.classes.items()}
        self.maps = {}
        for k, values in self.sorted.items():
            seen = np.zeros(1 << 20, dtype=bool)
            seen[values >> np.uint64(44)] = True
            self.maps[k] = seen

    def candidates(self, text: str, powers: Powers) -> set[int]:
        words = word_hashes(text, powers)
        out: set[int] = set()
        by_length: dict[int, np.ndarray] = {}
        for (length, bound), values in self.sorted.items():
            if length not in by_length:
                by_length[length] = shingle_hashes(words, length)
            h = by_length[length]
            at = np.flatnonzero(self.maps[length, bound][h >> np.uint64(44)])
            if at.size:
                at = at[values[np.minimum(np.searchsorted(values, h[at]), len(values) - 1)] == h[at]]
            for p in at.tolist():
                for w in (p // bound, p // bound - 1):
                    window = h[max(0, w * bound) : (w + 2) * bound]
                    if w >= -1 and not ((window < h[p]) & (window >> self.shift == h[p] >> self.shift)).any():
                        out.update(self.classes[length, bound][int(h[p])])
                        break
        return out


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    id_col: str | tuple[str, ...] = "doc_id",
    item_text_col: str = "text",
    item_id_col: str = "item_id",
    size: int = 5,
    threshold: float = 0.8,
    bins: int = 32,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment, for pairs with containment of at least the threshold.

    id_col: one column, which becomes doc_id, or several long ones, which keep their names.
    """
    ids = ["doc_id"] if isinstance(id_col, str) else list(id_col)
    named = [F.col(id_col).cast("long").alias("doc_id")] if isinstance(id_col, str) else [F.col(c).cast("long").alias(c) for c in ids]
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    src = docs.select(F.struct(*named).alias("d_id"), F.col(text_col).alias("text"))
    spark, out = docs.sparkSession, None
    for b in range(blocks):
        rows = [(r[0], r[1]) for r in (items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)).collect()]
        sent = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index, powers = Index(sent.value, size, bins), Powers()
            for batch in batches:
                found: list[list] = [[] for _ in range(5)]
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    text = text.as_py()
                    near = index.candidates(text, powers) if text else ()
                    if not near:
                        continue
                    words, own = WORD.findall(text.lower()), {}
                    for k in sorted(near):
                        item, wanted, length = index.exact[k]
                        if length not in own:
                            own[length] = shingles(words, length)
                        shared = len(wanted & own[length])
                        if shared >= threshold * len(wanted):
                            for column, value in zip(found, (key, item, shared, len(wanted), shared / len(wanted))):
                                column.append(value)
                kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(found, kinds)], ["d_id", "item_id", "shared", "item_shingles", "containment"])

        part = src.mapInArrow(run, f"d_id {src.schema['d_id'].dataType.simpleString()}, item_id long, shared long, item_shingles long, containment double")
        out = part if out is None else out.unionByName(part)
    return out.select("d_id.*", "item_id", "shared", "item_shingles", "containment").distinct()
