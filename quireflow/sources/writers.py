"""Writers. Paths are folders, as parallel writers make several files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", True).json(path)


def by_document(df: DataFrame, path: str, buckets: int = 64, id_col: str = "doc_id") -> None:
    """JSON in a bounded number of folders by hash of the document, so that one document is found without reading all."""
    df.withColumn("bucket", F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").json(path)


def csv_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, path: str, column: str = "markdown") -> None:
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def put_overview(reports: DataFrame, title: str, body_col: str, text_col: str = "text") -> DataFrame:
    """Replaces the block under ### title in a Markdown report, or puts it first."""
    block = F.concat(F.lit(f"### {title}\n\n"), F.col(body_col), F.lit("\n"))
    has = F.col(text_col).rlike(rf"(?m)^###\s*{title}\s*$")
    swapped = F.regexp_replace(F.col(text_col), F.lit(rf"(?s)###\s*{title}\s*\n.*?(?=\n###|\z)"), F.replace(F.replace(block, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")))
    return reports.withColumn(text_col, F.when(has, swapped).otherwise(F.concat(block, F.lit("\n"), F.col(text_col))))


def upsert(spark, df: DataFrame, path: str, key: str = "doc_id") -> None:
    """A key-value store as Parquet partitioned by key: the documents in df replace their own partitions only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
