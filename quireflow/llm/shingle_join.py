"""Near copies: SimHash candidates of BK-trees, verified on five-word shingles, and an exact join for the rest.

Two texts link if their sets of distinct shingles (as 64-bit hashes) have a Jaccard similarity of ``threshold`` or
more; groups are connected components of the links. Equal sets are first taken together.

1. SimHash: each set's text has a fingerprint of its distinct words, as one changed word changes one of those and
   five shingles. Pairs within ``radius`` bits come from sharded BK-trees (``simhash_bk``) and are verified. They
   are most of the links, and they join large groups without all of their pairs.
2. Exact join: in any total order of the shingles, two sets of that similarity have a shingle in common among the
   first n - ceil(threshold * n) + 1 of each, wherever the texts differ. A shingle's documents are a bucket. Each
   document without a link is first compared with one leader of its buckets; then all pairs of a bucket that are
   not yet in one component, but for those whose lengths or positions exclude the similarity. So no link is missed
   that fingerprints are too far apart for, such as an added header or paragraph.

A pair is passed over if bitmaps of its sets, in which each shingle turns one bit, differ in more bits than sets of
that similarity have shingles apart. Every other pair is verified on the whole sets before it links.

The order puts shingles last that are frequent in a sample of the documents, which keeps a common passage out of
most prefixes; the sample decides the cost alone, never the result. Prefixes travel as binary blocks by part of the
hash range; a shingle that the sample knows as frequent is dealt by document instead, so a passage in a third of
all documents loads no single task. Buckets over ``BUCKET_ROWS`` are compared in tiles, and a group's members are
verified in blocks of ``GROUP_ROWS``. Intermediate results are written tables, so Spark knows their sizes and
broadcasts a side only if it is small; adaptive execution splits hot keys of the other joins.

Edge cases: words are split at white space and compared in lower case; a text of fewer words than a shingle is
one shingle; null, empty and white texts have no shingles and are copies of each other; rows with one doc_id must
have one text; a row with a null doc_id has a null component; very long texts have as many shingles as words; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, small_batches, trim
from .decontam import Powers, mixed, shingle_hashes, word_hashes
from .simhash_bk import link_fingerprints, word_print

#: Frequent shingles that the order knows; others are taken as rare.
KNOWN_FREQUENT = 100_000
#: Rows of a bucket that one task compares, members of a group that one head is sent with, prefix shingles of a part.
BUCKET_ROWS, GROUP_ROWS, PART_ROWS = 4096, 256, 200_000
#: Rows of a bucket from which its pairs are screened by bitmaps before they are made; those of others are screened after.
SCREEN_ROWS = 32
#: A prefix shingle in a block: hash, document, shingles of the document, and of those the ones from here on.
ENTRY = np.dtype([("s", "<u8"), ("doc", "<i8"), ("n", "<u4"), ("left", "<u4")])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """Parts of batches, which bound what a worker holds of its sets."""
    for batch in batches:
        yield from (batch.slice(k, rows) for k in range(0, batch.num_rows, rows))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles' hashes of hashed words in ascending order."""
    return np.unique(shingle_hashes(words, min(size, len(words)))) if len(words) else words


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """A power of two of at least 1024 bits and two for each shingle; a bit is the parity of the shingles that fall to it."""
    width = max(1024, 1 << max(0, 2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps (rows) at half their width: a shingle's place there is its place modulo the width."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def differing(bits: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Differing bits of a bitmap and each of others (rows), at the lesser width if one is twice as wide."""
    if len(bits) > others.shape[1]:
        bits = folded(bits)
    elif len(bits) < others.shape[1]:
        others = folded(others)
    return np.bitwise_count(bits ^ others).sum(axis=1, dtype=np.int64)


def sketches(src: DataFrame, size: int) -> DataFrame:
    """doc_id, digest of the set, n, fp (fingerprint), bits (bitmap) of src(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        powers = Powers()
        for batch in slices(batches):
            words = [word_hashes(x.as_py() or "", powers) for x in batch.column(1)]
            sets = [shingle_set(w, size) for w in words]
            columns = [
                pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([word_print(w) for w in words], pa.int64()),
                pa.array([bitmap(s).tobytes() for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "digest", "n", "fp", "bits"])

    return src.mapInArrow(run, "doc_id long, digest binary, n long, fp long, bits binary")


def shingle_sets(src: DataFrame, size: int) -> DataFrame:
    """doc_id, shingles: the sets in ascending order, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches):
            sets = [shingle_set(word_hashes(x.as_py() or "", powers), size).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc_id", "shingles"])

    return src.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def frequent_shingles(src: DataFrame, n: int, size: int) -> np.ndarray:
    """The shingles, ascending, that are most frequent in a sample; at most KNOWN_FREQUENT, with their counts: dtype (s, n)."""
    parts = max(1, min(16, n // 2000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, rows = Powers(), [], 0

        def counted() -> pa.RecordBatch:
            # what a task sees once is rare, and only the order depends on it
            s, many = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(s[many > 1].view(np.int64)), pa.array(many[many > 1], pa.int64())], ["s", "n"])

        for batch in slices(batches):
            for x in batch.column(1):
                held.append(shingle_set(word_hashes(x.as_py() or "", powers), size))
                rows += len(held[-1])
                if rows > 500_000:
                    yield counted()
                    held.clear()
                    rows = 0
        yield counted()
        trim()

    sample = src.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0).select("doc_id", "text")
    counts = cut(sample.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where("n > 3"))
    least, rows = 4, 0
    for k, many in sorted(((r["k"], r["many"]) for r in counts.groupBy(F.least("n", F.lit(10_000)).alias("k")).agg(F.count("*").alias("many")).collect()), reverse=True):
        rows += many
        if rows > KNOWN_FREQUENT:
            least = k + 1
            break
    found = sorted((r["s"] & (1 << 64) - 1, r["n"]) for r in counts.where(F.col("n") >= least).collect())
    return np.array(found, dtype=[("s", "<u8"), ("n", "<i8")])


def is_known(known: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether shingles are among the frequent ones, and their places there."""
    if not len(known):
        return np.zeros(len(s), dtype=bool), np.zeros(len(s), dtype=np.int64)
    at = np.minimum(np.searchsorted(known["s"], s), len(known) - 1)
    return known["s"][at] == s, at


def prefix_blocks(src: DataFrame, size: int, threshold: float, known: np.ndarray, parts: int) -> DataFrame:
    """p, block: ENTRY records of the prefixes, dealt to parts by shingle, or by document if the shingle is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, rows = Powers(), [], 0

        def dealt() -> pa.RecordBatch:
            e = np.concatenate(held) if held else np.zeros(0, dtype=ENTRY)
            p = (mixed(np.where(is_known(known, e["s"])[0], e["doc"].view(np.uint64), e["s"])) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(p, kind="stable")
            e, p = e[order], p[order]
            first = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.zeros(0, dtype=np.int64)
            blocks = [e[a:b].tobytes() for a, b in zip(first.tolist(), [*first.tolist()[1:], len(e)])]
            return pa.RecordBatch.from_arrays([pa.array(p[first]), pa.array(blocks, pa.binary())], ["p", "block"])

        for batch in slices(batches):
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_set(word_hashes(x.as_py() or "", powers), size)
                often, at = is_known(known, s)
                if often.any():
                    s = s[np.lexsort((s, np.where(often, known["n"][at], 0)))]
                e = np.zeros(len(s) - ceil(threshold * len(s) - 1e-9) + 1 if len(s) else 0, dtype=ENTRY)
                e["s"], e["doc"], e["n"], e["left"] = s[: len(e)], doc, len(s), np.arange(len(s), len(s) - len(e), -1)
                held.append(e)
                rows += len(e)
            if rows > 300_000:
                yield dealt()
                held.clear()
                rows = 0
        yield dealt()
        trim()

    return src.select("doc_id", "text").mapInArrow(run, "p long, block binary")


def shared_shingles(blocks: DataFrame, known: np.ndarray) -> DataFrame:
    """s, doc_id, n, left, b, m: prefix shingles that two documents or more have, with a leader b of m shingles.

    Frequent ones come without a leader, and as they are: the sample has counted them.
    """

    def shared(parts: list[bytes]) -> pa.RecordBatch:
        e = np.concatenate([np.frombuffer(x, dtype=ENTRY) for x in parts])
        e = e[np.lexsort((e["doc"], mixed(e["doc"].view(np.uint64)), e["s"]))]
        same = (e["s"][1:] == e["s"][:-1]) & (e["doc"][1:] == e["doc"][:-1])
        e = e[np.append(True, ~same)]
        new = np.append(True, e["s"][1:] != e["s"][:-1])
        run = np.cumsum(new) - 1
        often = is_known(known, e["s"])[0]
        keep = often | (np.bincount(run)[run] > 1)
        head = e[np.flatnonzero(new)[run]]
        columns = [e["s"].view(np.int64), e["doc"], e["n"].astype(np.int64), e["left"].astype(np.int64), head["doc"], head["n"].astype(np.int64)]
        masks = [None] * 4 + [often[keep]] * 2
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[keep]), mask=m) for c, m in zip(columns, masks)], ["s", "doc_id", "n", "left", "b", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            for p, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if p != key:
                    if parts:
                        yield shared(parts)
                    key, parts = p, []
                parts.append(block.as_py())
        if parts:
            yield shared(parts)
        trim()

    return blocks.repartition("p").sortWithinPartitions("p").mapInArrow(run, "s long, doc_id long, n long, left long, b long, m long")


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of one run of the first columns' values at a time, from batches that are sorted by them."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        held = own if held is None else [np.concatenate(x) for x in zip(held, own)]
        new = np.append(True, np.any([c[1:] != c[:-1] for c in held[:keys]], axis=0))
        edges = np.flatnonzero(new).tolist()
        for a, b in zip(edges, edges[1:]):
            yield [c[a:b] for c in held]
        held = [c[edges[-1] :] for c in held]
    if held is not None:
        yield held


def apart(placed: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of a bucket that are in two components and that sizes, positions and, in large buckets, bitmaps allow.

    placed: s, doc_id, n, left, c. The largest component of a
    bucket is compared with the others, and those with each other. A large bucket's documents are dealt out to tiles,
    and those of the others go to each of its tiles.
    """
    sizes = placed.groupBy("s", "c").agg(F.count("*").alias("k")).groupBy("s").agg(F.max(F.struct("k", "c")).alias("m"), F.sum("k").alias("k"), F.count("*").alias("cs")).where("cs > 1")
    sizes = sizes.select("s", F.col("m.c").alias("main"), F.ceil(F.col("k") / BUCKET_ROWS).cast("int").alias("tiles"), (F.col("k") >= SCREEN_ROWS).alias("large"))
    rows = placed.join(sizes, "s").withColumn("other", F.col("c") != F.col("main"))
    home = F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")
    tiles = F.when(F.col("other"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(home))
    rows = cut(rows.select("s", "doc_id", "n", "left", "c", "other", home.alias("home"), F.explode(tiles).alias("tile"), "large"))
    sketched = rows.where("large").drop("large").join(keys.select("doc_id", "bits").dropDuplicates(["doc_id"]), "doc_id")
    rows = sketched.unionByName(rows.where("NOT large").drop("large").withColumn("bits", F.lit(None).cast("binary")))
    share = (1 - threshold) / (1 + threshold)

    def pairs(doc: np.ndarray, n: np.ndarray, left: np.ndarray, c: np.ndarray, other: np.ndarray, at_home: np.ndarray, bits: list[np.ndarray]) -> Iterator[np.ndarray]:
        width = np.array([len(x) for x in bits])
        by = {w: (np.flatnonzero(width == w), np.stack([x for x in bits if len(x) == w])) for w in set(width.tolist()) - {0}}
        for k in np.flatnonzero(other):
            fits = at_home & (c != c[k]) & (~other | (doc > doc[k]))
            fits &= np.minimum(n, n[k]) >= threshold * np.maximum(n, n[k]) - 1e-6
            fits &= np.minimum(left, left[k]) >= threshold / (1 + threshold) * (n + n[k]) - 1e-6
            if not width[k]:
                found = doc[fits]
                if len(found):
                    yield np.stack((np.minimum(found, doc[k]), np.maximum(found, doc[k])), axis=1)
                continue
            for w in (width[k] // 2, width[k], width[k] * 2):  # sizes that differ more are excluded
                if w in by:
                    at, rows = by[w]
                    chosen = fits[at]
                    at = at[chosen]
                    near = differing(bits[k], rows[chosen]) <= (share + 1e-6) * (n[at] + n[k])
                    if near.any():
                        found = doc[at[near]]
                        yield np.stack((np.minimum(found, doc[k]), np.maximum(found, doc[k])), axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def distinct() -> pa.RecordBatch:
            p = np.unique(np.concatenate(held), axis=0) if held else np.zeros((0, 2), dtype=np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(p[:, 0])), pa.array(np.ascontiguousarray(p[:, 1]))], ["a", "b"])

        for _, tile, doc, n, left, c, other, home, bits in runs_of(batches, 2):
            for p in pairs(doc, n, left, c, other.astype(bool), home == tile, [np.frombuffer(x or b"", dtype=np.uint64) for x in bits]):
                held.append(p)
                rows += len(p)
                if rows > 250_000:
                    yield distinct()
                    rows = 0
        yield distinct()

    dealt = rows.repartition("s", "tile").sortWithinPartitions("s", "tile").select("s", "tile", "doc_id", "n", "left", "c", "other", "home", "bits")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def screened(pairs: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """a, b, apart: pairs whose sizes and bitmaps allow the similarity; apart: the share of shingles that differ at least."""
    of = lambda k: keys.select(F.col("doc_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a").where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-6)
    share = (1 - threshold) / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v.as_py(), dtype=np.uint64) for v in batch.column(k)] for k in (3, 4))
            differ = np.array([int(differing(p, q[None, :])[0]) / max(n, 1) for p, q, n in zip(x, y, batch.column(2).to_pylist())], dtype=np.float64)
            rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(differ)], ["a", "b", "apart"])
            yield rows.filter(pa.array(differ <= share + 1e-6))

    return both.select("a", "b", F.col("n_a") + F.col("n_b"), "bits_a", "bits_b").mapInArrow(run, "a long, b long, apart double")


def verified(pairs: DataFrame, src: DataFrame, size: int, threshold: float) -> DataFrame:
    """The pairs a, b whose sets have the similarity; b is the side that may have many pairs.

    Each pair sends the set of a to a block of b's pairs, and each block has the set of b once.
    """
    pairs = cut(pairs.select("a", "b").distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("blocks"))
    members = pairs.join(many, "b").select("b", F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"), F.lit(1).alias("member"), F.col("a").alias("doc_id"))
    heads = members.select("b", "block", F.lit(0).alias("member"), F.col("b").alias("doc_id")).distinct()
    sets = shingle_sets(src.join(wanted, "doc_id", "left_semi"), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, whole = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for b, block, member, doc, raw in zip(*(batch.column(k).to_pylist() for k in range(4)), batch.column(4)):
                s = np.frombuffer(raw.as_py(), dtype=np.uint64)
                if not member:
                    head, whole = (b, block), s
                elif head == (b, block):
                    shared = int((whole[np.minimum(np.searchsorted(whole, s), len(whole) - 1)] == s).sum()) if len(whole) else 0
                    if shared >= threshold * (len(s) + len(whole) - shared):
                        out.append((doc, b))
            both = np.array(out, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], ["a", "b"])

    dealt = sets.join(members.unionByName(heads), "doc_id").select("b", "block", "member", "doc_id", "shingles")
    return dealt.repartition("b", "block").sortWithinPartitions("b", "block", "member", "doc_id").mapInArrow(run, "a long, b long").distinct()


def print_pairs(distinct: DataFrame, radius: int) -> DataFrame:
    """Pairs a, b of documents whose fingerprints are equal or linked by the BK-trees; distinct: doc_id, fp."""
    first = cut(distinct.groupBy("fp").agg(F.min("doc_id").alias("b"), F.count("*").alias("docs")))
    links = link_fingerprints(first.select("fp"), first.count(), radius, near=True).distinct()
    of = lambda k: first.select(F.col("fp").alias(f"fp_{k}"), F.col("b").alias(k))
    linked = of("a").join(links.select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")), "fp_a").join(of("b"), "fp_b").select("a", "b")
    equal = distinct.join(first.where("docs > 1").select("fp", "b"), "fp").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b")
    return linked.unionByName(equal).distinct()


def rooted(links: DataFrame) -> DataFrame:
    """node, root for every document of a link, the root itself among them."""
    roots = components(links)
    return cut(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct())


def near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 5, threshold: float = 0.8, radius: int = 4) -> DataFrame:
    """doc_id, component_id: the smallest doc_id that links reach from the row.

    All but joins of tables are done when this returns; until then workers get small batches.
    """
    with small_batches(docs.sparkSession):
        return grouped(docs, text_col, id_col, size, threshold, radius)


def grouped(docs: DataFrame, text_col: str, id_col: str, size: int, threshold: float, radius: int) -> DataFrame:
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    src = every.where("doc_id IS NOT NULL")
    keys = cut(sketches(src, size))
    low = keys.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    copies = cut(low.where("rows > 1"))
    named = cut(keys.join(copies, "digest", "left").select("doc_id", F.coalesce("first", "doc_id").alias("first"), "n", "fp"))
    spare = cut(named.where("doc_id <> first").select("doc_id").distinct())
    single = src.join(spare, "doc_id", "left_anti")

    tried = cut(print_pairs(named.where("doc_id = first").select("doc_id", "fp").distinct(), radius))
    links = cut(verified(screened(tried, keys, threshold), src, size, threshold))

    n, entries = named.agg(F.count("*"), F.sum((1 - threshold) * F.col("n") + 1)).first()
    known = frequent_shingles(src, n, size)
    buckets = cut(shared_shingles(prefix_blocks(single, size, threshold, known, max(64, int((entries or 0) / PART_ROWS))), known))
    leaders = F.broadcast(buckets.where("b IS NULL").groupBy("s").agg(F.min(F.struct(F.xxhash64("doc_id"), "doc_id", "n")).alias("l")))  # at most KNOWN_FREQUENT rows
    led = buckets.join(leaders, "s", "left").select(F.col("doc_id").alias("a"), "n", F.coalesce("b", "l.doc_id").alias("b"), F.coalesce("m", "l.n").alias("m"))
    led = led.where((F.col("a") != F.col("b")) & (F.least("n", "m") >= F.lit(threshold) * F.greatest("n", "m") - 1e-6))
    led = led.join(links.select("a").distinct(), "a", "left_anti")
    led = led.groupBy("a", "b").agg(F.count("*").alias("n")).groupBy("a").agg(F.max(F.struct("n", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    led = cut(led)
    tried = tried.unionByName(led)
    links = cut(links.unionByName(verified(screened(led, keys, threshold), src, size, threshold)))

    roots = rooted(links)
    placed = buckets.join(roots, F.col("doc_id") == F.col("node"), "left").select("s", "doc_id", "n", "left", F.coalesce("root", "doc_id").alias("c"))
    tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = cut(screened(cut(apart(placed, keys, threshold).join(tried, ["a", "b"], "left_anti")), keys, threshold))
    if not more.isEmpty():
        # each document's nearest first: most of the other pairs are in one component then
        ends = more.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e"), "apart")
        nearest = ends.groupBy("e.x").agg(F.min(F.struct("apart", "e.y")).alias("m")).select(F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b"))
        nearest = cut(nearest.distinct())
        links = cut(links.unionByName(verified(nearest, src, size, threshold)))
        roots = rooted(links)
        of = lambda k: roots.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
        rest = more.join(nearest, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left")
        rest = cut(rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
        if not rest.isEmpty():
            links = cut(links.unionByName(verified(rest, src, size, threshold)))
            roots = rooted(links)
    found = roots.select(F.col("node").alias("first"), "root").where("first <> root")
    nameless = every.where("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("component_id"))
    return named.join(found, "first", "left").select("doc_id", F.coalesce("root", "first").alias("component_id")).unionByName(nameless)
