"""Small DataFrame helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that has fewer files than the cluster has cores is dealt out, so that small inputs use them all.

    A large table has many files or row groups and is read as it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in ("documents", "pages") and len(df.inputFiles()) * 2 <= cores else df


def barrier(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns whose values later expressions, lambdas above all, read without computing them again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once for each row.

    Within it rows are evaluated node by node: code of an expression with many repeats would be too large for the compiler.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def best(df: DataFrame, keys: list[str], order: list[Column], rank: str | None = None, limit: int = 1) -> DataFrame:
    """The first ``limit`` rows of each key in a total order; ``rank`` keeps their numbers from 1.

    A rank filter on row_number lets Spark cut each task's groups before the shuffle.
    """
    out = df.withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("__rank") <= limit)
    return out.withColumnRenamed("__rank", rank) if rank else out.drop("__rank")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast hint for a lexicon that was counted and is small; a larger one is joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a key in a small fixed table; null if it isn't there."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
