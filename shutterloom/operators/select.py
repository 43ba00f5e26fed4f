"""Choosing the image to keep of a burst."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterloom.functions.faces import kept_boxes
from shutterloom.session import shared_folder, ship


def without_blurry(rows: DataFrame, group: str, sharpness: str, least: float) -> DataFrame:
    """Rows of groups of two or more without the blurry ones, where two or more stay. NaN stays; a
    limit that is not finite and positive turns the filter off."""
    many = F.count("*").over(Window.partitionBy(group))
    rows = rows.withColumn("_n", many).where("_n > 1").drop("_n")
    if np.isfinite(least) and least > 0:
        rows = rows.where(F.isnan(sharpness) | (F.col(sharpness) >= least))
    return rows.withColumn("_n", many).where("_n > 1").drop("_n")


def blink(aspect: Column, left: Column, right: Column, least_aspect: float = 0.21, most_closed: float = 0.5) -> Column:
    """Whether a face has its eyes closed: by the mesh, or by either eye's score."""
    return F.coalesce(aspect < least_aspect, F.lit(False)) | (F.greatest(left, right) > most_closed)


def face_counts(is_blink: str | Column = "is_blink", smile: str | Column = "smile") -> list[Column]:
    """Aggregates of an image's faces: blinks and smile_avg; faces without a mesh have a null smile."""
    return [F.count_if(is_blink).alias("blinks"), F.avg(smile).alias("smile_avg")]


def with_total(rows: DataFrame, w_sharpness: float = 1.0, w_blink: float = 2.0, w_smile: float = 0.5) -> DataFrame:
    """Adds total to images with sharpness, blinks and smile_avg; images without faces have none of either."""
    rows = rows.withColumn("blinks", F.coalesce("blinks", F.lit(0))).withColumn("smile_avg", F.coalesce("smile_avg", F.lit(0.0)))
    return rows.withColumn("total", w_sharpness * F.col("sharpness") - w_blink * F.col("blinks") + w_smile * F.col("smile_avg"))


def scored(images: DataFrame, faces: DataFrame, key: str, w_sharpness: float = 1.0, w_blink: float = 2.0, w_smile: float = 0.5) -> DataFrame:
    """Adds blinks, smile_avg and total to images (key, sharpness) from faces (key, is_blink, smile)."""
    return with_total(images.join(faces.groupBy(key).agg(*face_counts()), key, "left"), w_sharpness, w_blink, w_smile)


def best_of(rows: DataFrame, group: str, score: str, seq: str) -> DataFrame:
    """The row of the highest score in each group; NaN is lowest, and the last one wins a tie."""
    order = [F.isnan(score).asc(), F.desc(score), F.desc(seq)]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_r = 1").drop("_r")


def group_names(groups: DataFrame, order: str) -> DataFrame:
    """Adds ``group-001`` and so on in the given order; one row a group. Ranks come from partition counts
    and places within partitions, so no partition sees all groups. Ranges are sampled, and not twice alike:
    rows keep their partition and place through a checkpoint, from which both are read."""
    shared_folder(groups.sparkSession)
    ordered = groups.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    ordered = ordered.select(*groups.columns, part.alias("_p"), (place + 1).alias("_i"))
    counts = ordered.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))  # a row a partition
    return ordered.join(before, "_p").withColumn("group_id", F.format_string("group-%03d", F.col("_before") + F.col("_i"))).drop("_p", "_i", "_before")


def suppressed(boxes: DataFrame, image: str, most: float) -> DataFrame:
    """Greedy non-maximum suppression within each image of (image, box, x1, y1, x2, y2, score)."""

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("box")
        return part.iloc[kept_boxes(part[["x1", "y1", "x2", "y2"]].to_numpy(), part["score"].to_numpy(), most)]

    ship(boxes.sparkSession)
    return boxes.groupBy(image).applyInPandas(keep, boxes.schema)


def laplacian_variances(images: DataFrame, key: str, pixels: str, width: int) -> DataFrame:
    """(key, sharpness) of grey images as arrays of rows."""
    from shutterloom.functions.images import laplacian_variance

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({key: part[key], "sharpness": [laplacian_variance(np.asarray(p, np.float64).reshape(-1, width)) for p in part[pixels]]})

    return images.select(key, pixels).mapInPandas(run, f"`{key}` long, sharpness double")
