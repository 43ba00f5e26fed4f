"""Target names without collisions, and sidecar lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shutterloom.functions.paths import split_ext
from shutterloom.session import written


def numbered(name, i):
    """``stem_i.ext``; the name itself for 0."""
    stem, ext = split_ext(name)
    return F.when(i == 0, name).otherwise(F.concat(stem, F.lit("_"), i.cast("string"), F.when(ext.isNotNull(), F.concat(F.lit("."), ext)).otherwise("")))


def _family(name):
    """The name without the numbers that :func:`numbered` may have put there."""
    stem, ext = split_ext(name)
    return F.concat(F.regexp_replace(stem, r"(_\d+)+$", ""), F.when(ext.isNotNull(), F.concat(F.lit("."), ext)).otherwise(""))


def unique_names(files: DataFrame, taken: DataFrame, attempts: int = 10) -> DataFrame:
    """Adds ``target_name`` to (path, dir, name): the first free of name, name_1 .. name_N in its folder,
    in path order; null if none is free. ``taken``: (dir, name) that exist.

    Files of one name share its numbers out by one window. Only where a folder's files want both a name
    and a numbered form of it (a.jpg and a_1.jpg) do they go through rounds.
    """
    family = Window.partitionBy("dir", "family")
    named = files.withColumn("family", _family(F.col("name"))).withColumn("_mixed", F.min("name").over(family) != F.max("name").over(family))
    out = _by_window(named.where("NOT _mixed").select(*files.columns), taken, attempts)
    several = written(named.where("_mixed").select(*files.columns), "several")
    return out if several.isEmpty() else out.unionByName(_by_rounds(several, taken, attempts))


def _by_rounds(files: DataFrame, taken: DataFrame, attempts: int) -> DataFrame:
    """Each unplaced file proposes its next name; the first path of those that want a free name gets it.
    ``attempts`` + 1 rounds at most, each two equi-joins."""
    placed, used = None, taken.select("dir", "name").distinct()
    left = files
    for i in range(attempts + 1):
        wanted = left.withColumn("target_name", numbered(F.col("name"), F.lit(i)))
        free = wanted.join(used.select("dir", F.col("name").alias("target_name")), ["dir", "target_name"], "left_anti")
        won = free.withColumn("_r", F.row_number().over(Window.partitionBy("dir", "target_name").orderBy("path"))).where("_r = 1").drop("_r").select(*files.columns, "target_name")
        won = written(won, "placed")  # each round is cut: later rounds read it several times
        placed = won if placed is None else placed.unionByName(won)
        used = used.unionByName(won.select("dir", F.col("target_name").alias("name")))
        left = written(left.join(won.select("path"), "path", "left_anti"), "unplaced")
        if left.isEmpty():
            break
    return placed.unionByName(left.withColumn("target_name", F.lit(None).cast("string")))


def _by_window(files: DataFrame, taken: DataFrame, attempts: int) -> DataFrame:
    """The k-th file of a name gets the k-th of its numbers that no existing file has."""
    stem, ext = split_ext(F.col("name"))
    number = F.regexp_extract(stem, r"^(.*)_([1-9]\d{0,8})$", 2)
    base = F.concat(F.regexp_extract(stem, r"^(.*)_([1-9]\d{0,8})$", 1), F.when(ext.isNotNull(), F.concat(F.lit("."), ext)).otherwise(""))
    own = taken.select("dir", "name", F.lit(0).alias("number")).unionByName(taken.where(number != "").select("dir", base.alias("name"), number.cast("int").alias("number")))
    used = own.where(F.col("number") <= attempts).groupBy("dir", "name").agg(F.collect_set("number").alias("used"))
    rows = files.withColumn("_k", F.row_number().over(Window.partitionBy("dir", "name").orderBy("path"))).join(used, ["dir", "name"], "left")
    free = F.array_except(F.sequence(F.lit(0), F.lit(attempts)), F.coalesce("used", F.array().cast("array<int>")))
    return rows.withColumn("target_name", numbered(F.col("name"), F.get(free, F.col("_k") - 1))).select(*files.columns, "target_name")


def sidecars(media: DataFrame, listing: DataFrame) -> DataFrame:
    """Media rows (path) with the paths of ``stem.xmp`` and ``full name.json`` beside them, if listed."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    xmp = listing.select(F.col("path").alias("xmp"))
    takeout = listing.select(F.col("path").alias("takeout"))
    return media.join(xmp, F.concat(stem, F.lit(".xmp")) == F.col("xmp"), "left").join(takeout, F.concat("path", F.lit(".json")) == F.col("takeout"), "left")
