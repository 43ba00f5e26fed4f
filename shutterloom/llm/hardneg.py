"""Hard-negative mining by one-dimensional distance keys.

Vectors of integers get one more component, the root of what their squared norm lacks to the largest one,
so that the order by inner product with an anchor is that by distance to (anchor, 0). Every row is
stored under the key (pivot, distance to the pivot), pivots being fitted on a bounded sample; the table is
sorted by that key and packed into blocks, each an interval of distances to one pivot: an annulus.

By the triangle inequality the annulus [lo, hi] of a pivot at distance D from an anchor holds nothing
nearer than ``max(lo - D, D - hi, 0)``. A search visits blocks in the order of that bound, in rounds of
growing intervals; what the k-th best found so far has as its distance is a radius, and once the bounds of all
blocks left exceed it, the top k are certified. Positives are the top k of the anchor's label; negatives of an
anchor and a positive the top k of other labels with a score in a band, whose ends bound the search too.

Anchors meet blocks in groups of ``GROUP``, the groups being packed from the same sorted keys, so anchors
that share blocks lie together; a block is multiplied with a group whole, and a task gives at most k
rows for each anchor, whatever it has read. Nothing is grouped by label or vector: a hot label or a vector
with many copies is many blocks. The driver sees counts, the sample and the pivots.

Defined results: rows with a null key, label or vector or a null or non-finite component take no part; of rows
that share a key one takes part, the least by label and vector; shorter vectors are filled up with zeros;
ties go to smaller keys; an empty table or one without anchors gives no rows; columns besides the three are
ignored. Squared norms of 2^51 and more are refused: products would not be exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterloom.llm.common import by_batches
from shutterloom.session import scratch, written

#: Pivots, and rows of the sample that they are fitted on.
PIVOTS, SAMPLE_ROWS = 32, 4096
#: Rows of a block, anchors of a group, tasks that share a group's blocks, blocks of the first round (then
#: WIDER times as many), and rows of a slice of products.
BLOCK, GROUP, BUCKETS, FIRST, WIDER, SLICE = 2048, 8192, 16, 8, 8, 512
#: Bounds are looser by this, and by the rounding of distances.
SLACK = 1e-3
LEAST = -(1 << 62)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _augmented(x: np.ndarray, norm: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(0, norm - (x * x).sum(1)))[:, None]])


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0, squares))


def fitted(sample: np.ndarray, pivots: int = PIVOTS, steps: int = 5) -> np.ndarray:
    """Pivots: each starts as the row furthest from those before it, then moves to the mean of its rows."""
    at, far = [0], _distances(sample, sample[:1])[:, 0]
    while len(at) < min(pivots, len(sample)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[at[-1:]])[:, 0])
    out = sample[at]
    for _ in range(steps):
        nearest = _distances(sample, out).argmin(1)
        out = np.stack([sample[nearest == i].mean(0) if (nearest == i).any() else out[i] for i in range(len(out))])
    return out


def prepared(vectors: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """(id, label, x array<long>, norm2): the rows that take part, by whole numbers."""
    good = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(good)
    whole = F.transform(F.col(vector), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    rows = rows.select(F.col(key).cast("long").alias("id"), F.struct(F.col(label).cast("long").alias("label"), whole.alias("x")).alias("row")).groupBy("id").agg(F.min("row").alias("row"))
    return rows.select("id", "row.label", "row.x").withColumn("norm2", F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))


class _Space:
    """What tasks need to place vectors: number of components, largest squared norm, pivots."""

    def __init__(self, dims: int, norm: float, widest: int):
        self.dims, self.norm, self.pivots = dims, norm, np.zeros((1, dims + 1))
        self.kept = np.int16 if widest < 1 << 15 else np.int32 if widest < 1 << 31 else np.int64
        #: Sums of products stay below the largest squared norm, so they are exact in these numbers.
        self.product = np.float32 if norm < 1 << 24 else np.float64
        #: Squares of distances are off by the size of the norms, which shows most in small ones.
        self.slack = SLACK + 4 * float(np.sqrt((dims + 1) * 2.0**-52 * norm))

    def unpacked(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), np.frombuffer(row["x"], self.kept).reshape(-1, self.dims)


def placed(rows: DataFrame, space: _Space) -> DataFrame:
    """(pivot int, distance double, id, label, x binary): every row with its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), space.dims)
            far = _distances(_augmented(x, space.norm), space.pivots)
            pivot = far.argmin(1)
            packed = [row.tobytes() for row in x.astype(space.kept)]
            yield pa.RecordBatch.from_arrays([pa.array(pivot, pa.int32()), pa.array(far[np.arange(len(x)), pivot]), batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["pivot", "distance", "id", "label", "x"])

    return by_batches(rows.select("id", "label", "x"), run, "pivot int, distance double, id long, label long, x binary")


def blocks_of(placed_rows: DataFrame, rows: int) -> DataFrame:
    """(block, pivot, lo, hi, ids, labels, x): consecutive rows of one pivot, in the order of the key."""

    def packed(held: list[pa.RecordBatch]) -> dict:
        t = pa.Table.from_batches(held).sort_by("id")
        far = t["distance"].to_numpy()
        return {"pivot": t["pivot"][0].as_py(), "lo": far.min(), "hi": far.max(), "ids": t["id"].to_numpy().tobytes(), "labels": t["label"].to_numpy().tobytes(), "x": b"".join(t["x"].to_pylist())}

    schema = pa.schema([("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.binary()), ("labels", pa.binary()), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            out, at = [], 0
            pivots = batch.column(0).to_numpy()
            while at < len(pivots):
                if held and held[0].column(0)[0].as_py() != pivots[at]:
                    out.append(packed(held))
                    held, n = [], 0
                end = min(int(np.searchsorted(pivots, pivots[at], "right")), at + rows - n)
                held.append(batch.slice(at, end - at))
                at, n = end, n + end - at
                if n == rows:
                    out.append(packed(held))
                    held, n = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if held:
            yield pa.RecordBatch.from_pylist([packed(held)], schema)

    order = ["pivot", "distance", "id"]
    dealt = placed_rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return by_batches(dealt, run, "pivot int, lo double, hi double, ids binary, labels binary, x binary").withColumn("block", F.monotonically_increasing_id())


def _reach(groups: DataFrame, space: _Space) -> DataFrame:
    """(group, pivot, nearest, furthest): distances of a group's anchors to each pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                x = space.unpacked(row)[2].astype(np.float64)
                far = _distances(np.hstack([x, np.zeros((len(x), 1))]), space.pivots)
                out += [{"group": row["block"], "pivot": i, "nearest": far[:, i].min(), "furthest": far[:, i].max()} for i in range(len(space.pivots))]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("group", pa.int64()), ("pivot", pa.int32()), ("nearest", pa.float64()), ("furthest", pa.float64())]))

    return by_batches(groups.select("block", "ids", "labels", "x"), run, "group long, pivot int, nearest double, furthest double")


def _anchors(groups: DataFrame, space: _Space) -> DataFrame:
    """(group, anchor, norm2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, _, x = space.unpacked(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["block"])), pa.array(ids), pa.array((x.astype(np.float64) ** 2).sum(1))], names=["group", "anchor", "norm2"])

    return by_batches(groups.select("block", "ids", "labels", "x"), run, "group long, anchor long, norm2 double")


class _Scan:
    """The search of one group's anchors through blocks: the k best of each slot so far."""

    def __init__(self, space: _Space, row: dict, k: int, same: bool):
        self.space, self.k, self.same = space, k, same
        self.ids, self.labels, x = space.unpacked(row)
        self.x = x.astype(space.product)
        x = x.astype(np.float64)
        self.norms = (x * x).sum(1)
        self.far = _distances(np.hstack([x, np.zeros((len(x), 1))]), space.pivots)
        slots = pa.array(row["slots"], pa.struct([("anchor", pa.int64()), ("slot", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])).flatten()
        self.anchor, self.slot, self.low, self.high = (c.to_numpy() for c in slots)
        self.low = self.low.copy()
        self.of = np.searchsorted(self.ids, self.anchor)
        self.best = np.full((len(self.of), k), LEAST)
        self.who = np.full((len(self.of), k), np.iinfo(np.int64).max)

    def visit(self, row: dict) -> None:
        ids, labels, x = self.space.unpacked(row)
        far = self.far[self.of, row["pivot"]]
        bound = np.maximum(np.maximum(far - row["hi"], row["lo"] - far), 0)
        radius = np.sqrt(np.maximum(0, self.norms[self.of] + self.space.norm - 2.0 * np.maximum(self.low, -self.space.norm)))
        live = np.flatnonzero((bound <= radius + self.space.slack) & (self.low <= self.high))
        y = x.astype(self.space.product).T
        # among equal scores the smaller key, which comes first, is to be the larger number
        place = len(ids) - 1 - np.arange(len(ids))
        for at in (live[i : i + SLICE] for i in range(0, len(live), SLICE)):
            of, back = np.unique(self.of[at], return_inverse=True)
            score = (self.x[of] @ y).astype(np.int64)[back]
            alike = labels == self.labels[self.of[at]][:, None]
            ok = (alike & (ids != self.anchor[at][:, None])) if self.same else ~alike
            ok &= (score >= self.low[at][:, None]) & (score <= self.high[at][:, None])
            some = np.flatnonzero(ok.any(1))
            if not len(some):
                continue
            at, score, ok = at[some], score[some], ok[some]
            ranked = np.where(ok, score * len(ids) + place, LEAST)
            k = min(self.k, len(ids))
            top = np.argpartition(ranked, len(ids) - k, axis=1)[:, len(ids) - k :]
            good = np.take_along_axis(ok, top, 1)
            found = np.where(good, np.take_along_axis(score, top, 1), LEAST)
            who = np.where(good, ids[top], np.iinfo(np.int64).max)
            found, who = np.hstack([self.best[at], found]), np.hstack([self.who[at], who])
            order = np.lexsort((who, -found), axis=-1)[:, : self.k]
            self.best[at], self.who[at] = np.take_along_axis(found, order, 1), np.take_along_axis(who, order, 1)
            self.low[at] = np.maximum(self.low[at], self.best[at, -1])

    def found(self, group: int) -> pa.RecordBatch:
        r, c = np.nonzero(self.best > LEAST)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(r), group), pa.int64()), pa.array(self.anchor[r]), pa.array(self.slot[r]), pa.array(self.best[r, c]), pa.array(self.who[r, c])], names=["group", "anchor", "slot", "score", "id"])


def _scanned(todo: DataFrame, blocks: DataFrame, groups: DataFrame, needs: DataFrame, space: _Space, k: int, same: bool) -> DataFrame:
    """(group, anchor, slot, score, id): at most k for each slot and task, from the blocks of ``todo``."""
    none = F.lit(None)
    slots = needs.schema["slots"].dataType
    heads = groups.withColumnRenamed("block", "group").join(needs, "group").select("group", F.explode(F.array(*map(F.lit, range(BUCKETS)))).alias("bucket"), F.lit(-1).cast("long").alias("rank"), "pivot", "lo", "hi", "ids", "labels", "x", "slots")
    rest = todo.join(blocks.drop("pivot"), "block").select("group", F.pmod("rank", F.lit(BUCKETS)).cast("int").alias("bucket"), F.col("rank").cast("long").alias("rank"), "pivot", "lo", "hi", "ids", "labels", "x", none.cast(slots).alias("slots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, group = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["rank"] < 0:
                    if scan:
                        yield scan.found(group)
                    scan, group = _Scan(space, row, k, same), row["group"]
                else:
                    scan.visit(row)
        if scan:
            yield scan.found(group)

    dealt = heads.unionAll(rest).repartition("group", "bucket").sortWithinPartitions("group", "bucket", "rank")
    return by_batches(dealt, run, "group long, anchor long, slot int, score long, id long")


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _search(wants: DataFrame, ranked: DataFrame, blocks: DataFrame, groups: DataFrame, space: _Space, k: int, same: bool) -> DataFrame:
    """(group, anchor, slot, score, id, rank): the k best of each of ``wants`` (group, anchor, norm2, slot, low, high)."""
    best = wants.sparkSession.createDataFrame([], "group long, anchor long, slot int, score long, id long, rank int")
    first, last = 0, FIRST
    while True:
        kth = best.where(F.col("rank") == k).select("anchor", "slot", F.col("score").alias("kth"))
        left = wants.join(kth, ["anchor", "slot"], "left").withColumn("low", F.greatest("low", "kth"))
        # no product is below minus the largest squared norm
        radius = F.sqrt(F.greatest(F.lit(0.0), F.col("norm2") + F.lit(space.norm) - 2.0 * F.greatest(F.col("low").cast("double"), F.lit(-space.norm))))
        needs = written(left.where("low <= high").groupBy("group").agg(F.max(radius).alias("radius"), F.collect_list(F.struct("anchor", "slot", "low", "high")).alias("slots")), "needs")
        ahead = ranked.where(F.col("rank") > first).join(needs.select("group", "radius"), "group").where(F.col("bound") <= F.col("radius") + space.slack)
        if ahead.isEmpty():
            return best
        found = _scanned(ahead.where(F.col("rank") <= last), blocks, groups, needs.select("group", "slots"), space, k, same)
        best = written(_top(best.drop("rank").unionAll(found), k), "best")
        first, last = last, last * WIDER


def hard_negatives(vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for rows whose key
    satisfies ``anchors`` (an expression on column ``id``) and each of their first positives, the first rows of other
    labels that score ``low`` to ``high`` per cent of the positive."""
    with scratch() as made:
        far, band = _mined(vectors, anchors, key, vector, label, scale, positives, negatives, low, high)
        made.keep(far, band)
    out = far.join(band.select("anchor", "slot", "positive_id", "positive_score"), ["anchor", "slot"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _mined(vectors: DataFrame, anchors: Column, key: str, vector: str, label: str, scale: int, positives: int, negatives: int, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """Negatives by (anchor, slot), and what each slot's positive is."""
    spark = vectors.sparkSession
    rows = written(prepared(vectors, key, vector, label, scale), "vectors")
    told = rows.agg(F.max("norm2").alias("norm"), F.max(F.size("x")).alias("dims"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v)))).alias("widest")).first()
    if told["norm"] is None:
        none = "group long, anchor long, slot int, score long, id long, rank int"
        return spark.createDataFrame([], none), spark.createDataFrame([], "anchor long, slot int, positive_id long, positive_score long")
    if told["norm"] >= 1 << 51:
        raise ValueError("squared norms of 2^51 and more can't be multiplied exactly; lower the scale")
    space = _Space(told["dims"], float(told["norm"]), told["widest"] or 0)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("x").toArrow()["x"].combine_chunks()
    space.pivots = fitted(_augmented(_matrix(sample, space.dims), space.norm))

    blocks = written(blocks_of(placed(rows, space), BLOCK), "annuli")
    groups = written(blocks_of(placed(rows.where(anchors), space), GROUP), "anchors")
    bound = F.greatest(F.lit(0.0), F.col("lo") - F.col("furthest"), F.col("nearest") - F.col("hi"))
    met = _reach(groups, space).join(blocks.select("block", "pivot", "lo", "hi"), "pivot").withColumn("bound", bound)
    ranked = written(met.withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy("bound", "block"))).select("group", "block", "pivot", "bound", "rank"), "ranked")

    every = _anchors(groups, space).select("group", "anchor", "norm2", F.lit(0).alias("slot"), F.lit(LEAST).alias("low"), F.lit(1 << 62).alias("high"))
    near = _search(every, ranked, blocks, groups, space, positives, True)
    band = near.where("score >= 0").select("group", "anchor", F.col("rank").alias("slot"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    band = band.join(every.select("anchor", "norm2"), "anchor").withColumn("low", F.expr(f"({low} * positive_score + 99) div 100")).withColumn("high", F.expr(f"({high} * positive_score) div 100"))
    band = written(band, "band")
    far = _search(band.select("group", "anchor", "norm2", "slot", "low", "high"), ranked, blocks, groups, space, negatives, False)
    return far, band
