"""File relations made from the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, path, size, content): documents as text files in a folder for each source."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select("doc_id", "source", path.alias("path"), F.octet_length("text").cast("bigint").alias("size"), F.col("text").cast("binary").alias("content"))


FILES_SQL = "files AS (SELECT doc_id, source, '/' || source || '/' || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS size, text FROM documents)"
