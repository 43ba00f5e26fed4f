"""Finding equal files. Identity is (size, strong hash); only hashes are shuffled, never contents.

A file relation has ``path``, ``size`` and ``content``; :func:`hashed` gives it the hash columns in the
scan, so that contents are read once and dropped there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterloom.functions.paths import under_prefix

PREFIX_BYTES = 4096


def fast_hash(content: Column) -> Column:
    """Hash of the first 4 KiB."""
    return F.xxhash64(F.substring(content, 1, PREFIX_BYTES))


def hashed(files: DataFrame, secure: bool = True) -> DataFrame:
    """Hash columns in place of the content; empty files are left out."""
    strong = F.sha2("content", 512) if secure else F.hex(F.xxhash64("content"))
    kept = files.where("size > 0")
    return kept.select(*(c for c in files.columns if c != "content"), fast_hash(F.col("content")).alias("fast"), strong.alias("strong"))


def duplicate_groups(files: DataFrame) -> DataFrame:
    """(size, strong, n, paths) of groups of two or more, the largest size first: a report, with a list of paths a row.
    What follows from groups takes :func:`classes`."""
    groups = files.groupBy("size", "strong").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("path")).alias("paths"))
    return groups.where("n > 1").orderBy(F.desc("size"), "paths")


def in_output(source: DataFrame, output: DataFrame) -> DataFrame:
    """Source files whose content the output holds."""
    return source.join(output.select("size", "fast", "strong").distinct(), ["size", "fast", "strong"], "left_semi")


def not_in_output(source: DataFrame, output: DataFrame) -> DataFrame:
    """Source files whose content the output lacks."""
    return source.join(output.select("size", "fast", "strong"), ["size", "fast", "strong"], "left_anti")


def first_wins(files: DataFrame) -> DataFrame:
    """The first path of each content, as a serial run in path order would keep."""
    rank = F.row_number().over(Window.partitionBy("size", "strong").orderBy("path"))
    return files.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources, one row for each path."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates(["path"])


def except_prefix(files: DataFrame, prefix: str) -> DataFrame:
    return files.where(~under_prefix(F.col("path"), prefix))


def classes(files: DataFrame, *more: Column) -> DataFrame:
    """(size, strong, n, first_path, more aggregates) of contents that two or more files have; a row each, whatever
    the number of files."""
    of = files.groupBy("size", "strong").agg(F.count("*").alias("n"), F.min("path").alias("first_path"), *more)
    return of.where("n > 1")


def delete_plan(files: DataFrame, output: str | None) -> DataFrame:
    """(size, path, action, is_survivor) of each of the files (size, strong, path) that has equals.

    Without an output folder nothing is deleted. Members below it are kept and the others deleted; if
    none lies below it, the first one survives. Members meet their class in a join, so no list of them is ever made.
    """
    below = under_prefix(F.col("path"), output) if output else F.lit(False)
    rows = files.select("size", "strong", "path").join(classes(files, F.bool_or(below).alias("some")), ["size", "strong"])
    survivor = F.lit(bool(output)) & ~F.col("some") & (F.col("path") == F.col("first_path"))
    keep = F.lit(not output) | below | survivor
    return rows.select("size", "path", F.when(keep, "keep").otherwise("delete").alias("action"), survivor.alias("is_survivor"))


def bytes_read(files: DataFrame, secure: bool = False) -> DataFrame:
    """Bytes that prefix hashes, and strong hashes within buckets of equal prefix hash, have to read."""
    by_prefix = files.groupBy("fast").agg(F.count("*").alias("n"), F.sum(F.least("size", F.lit(PREFIX_BYTES))).alias("heads"), F.sum("size").alias("sizes"))
    return by_prefix.agg(F.sum(F.col("heads") + F.when(F.col("n") > 1, F.col("sizes")).otherwise(0)).alias("bytes_read"))


def scan_stats(listing: DataFrame) -> DataFrame:
    """Counters of a scan from (kind, size, status)."""
    file = F.col("kind") == "file"
    return listing.agg(
        F.count_if(file & (F.col("size") > 0) & (F.col("status") == "ok")).alias("indexed"),
        F.count_if(file & (F.col("size") == 0) & (F.col("status") == "ok")).alias("skipped_empty"),
        F.count_if(file & (F.col("status") == "unreadable")).alias("skipped_unreadable"),
        F.count_if(F.col("status") == "walk_error").alias("walker_errors"),
    )
