"""Helpers shared by the corpus operators: lineage cuts, size-checked hints, worker caches, components."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType

#: Code points 9 to 13 and 32, the white space that every word contract here names.
WS = r"\x20\x09-\x0D"
#: A side is broadcast up to this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's spark.checkpoint.dir; a temporary folder only in local mode where none is configured, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quireflow-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: computed once, survives lost executors, and its size is known.

    A checkpoint would carry the estimated size of its plan on, which loops of joins multiply to numbers of
    millions of digits.
    """
    ensure_checkpoint_dir(df.sparkSession)
    folder = f"{df.sparkSession.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Within it, what is computed sends Python workers so many rows at a time: a long text has a hundred kilobytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def trim() -> None:
    """Gives freed memory of the Python worker back, as workers live on between stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in a broadcast table: 16 bytes for each field, and its strings, arrays and maps."""
    size = F.lit(24 + 16 * len(df.columns))
    for f in df.schema.fields:
        if isinstance(f.dataType, (StringType, BinaryType)):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, (ArrayType, MapType)):
            size = size + 32 * F.greatest(F.coalesce(F.size(f.name), F.lit(0)), F.lit(0))
    return size.cast("long")


def maybe_broadcast(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only if the (checkpointed) side was measured and is small enough."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= max_bytes else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores until no column of df has them; columns compare without case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, also for functions that were pickled by value."""
    m = sys.modules.get("_quireflow_worker_cache")
    if m is None:
        m = types.ModuleType("_quireflow_worker_cache")
        m.store = {}
        sys.modules["_quireflow_worker_cache"] = m
    return m.store


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(a, b) by alternating large-star and small-star steps.

    Returns (node, root), root the smallest node of the component, for every node of an edge between two
    different nodes. Each step takes a minimum per node (combined before the shuffle) and joins it back to the edges. The
    edges are written tables, so their sizes are known: adaptive execution broadcasts the minima if they are few,
    and else splits nodes with very many neighbours. No component is ever gathered in one task or on the driver.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").distinct())
        # every node points downwards here: small-star links all lower neighbours to the lowest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        pairs = cut(small.where("u <> v").distinct())
        got = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == got:
            break
        mark = got
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("root"))

