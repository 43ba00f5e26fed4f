"""Similarity joins of perceptual hashes and of embeddings, and their groups."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterloom.functions.vectors import hamming
from shutterloom.operators.components import components
from shutterloom.session import ship, written

#: Rows of a block of the cosine join. Rows that its pivots are fitted on, and most pivots.
BLOCK_ROWS, SAMPLE_ROWS, PIVOTS = 4096, 4096, 32
#: Stripes of blocks of the cosine join and bytes of vectors of one, beyond which there are more: a task holds two stripes.
STRIPES, STRIPE_BYTES = 12, 1 << 26
#: Rows of a block of hashes, those that make a second block worth while, blocks of a smaller table.
HASHES, FEW_HASHES, LEAST_BLOCKS = 65_536, 2_048, 8
#: Share of all pairs that bands or balls may let meet; beyond it, comparing all pairs takes less.
MOST_MET = 0.01
#: Different hashes from which on balls take less than tiles, for radii up to that of ``BALL_BITS``, and their blocks of bits.
BALL_ROWS, BALL_BITS, BALL_BLOCKS = 1 << 20, 11, 3


def _band_widths(most: int) -> list[int]:
    bands = min(most + 1, 64)
    return [64 // bands + (i < 64 % bands) for i in range(bands)]


def _wide(most: int) -> bool:
    return sum(0.5**w for w in _band_widths(most)) > MOST_MET


def hamming_pairs(hashes: DataFrame, most: int, key: str = "id", value: str = "hash") -> DataFrame:
    """(a, b, distance) with a < b of rows whose 64-bit hashes differ in ``most`` bits or fewer.

    Small radii: hashes within k bits agree in one of k + 1 bands at least, so rows meet on (band, its
    bits); a pair that meets in several bands is kept in the first. Equal hashes are joined once, as one
    row with all of its keys. Wide radii (6 bits and more) make bands of a few bits, on which more pairs
    meet than there are; there, blocks of rows are compared whole, or, up to 11 bits and from ``BALL_ROWS`` rows on, meet
    on balls around blocks of bits (:func:`_ball_pairs`). All are exact.
    """
    rows = hashes.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    found = _by_radius(rows, most, key, value, False)
    return found.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.col("distance").cast("int").alias("distance"))


def hamming_links(hashes: DataFrame, most: int, key: str = "id", value: str = "hash") -> DataFrame:
    """(a, b): fewer links with the same components as the pairs. Equal hashes link with the least of
    their keys, and only these are compared; a pair of blocks gives a link a row at most."""
    rows = hashes.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("id"), F.col(value).alias("hash"))
    least = rows.groupBy("hash").agg(F.min("id").alias("first"))
    copies = rows.join(least, "hash").where("id <> first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    across = _by_radius(least, most, "first", "hash", True)
    return copies.unionByName(across.select(F.col("p").alias("a"), F.col("q").alias("b")))


def _by_radius(rows: DataFrame, most: int, key: str, value: str, links: bool) -> DataFrame:
    if not _wide(most):
        return _band_pairs(rows, most, key, value)
    if most <= BALL_BITS and rows.count() >= BALL_ROWS:
        sides = _balls(rows, most, value)
        if _meetings(*sides) <= MOST_MET * rows.count() ** 2 / 2:
            return _ball_pairs(rows, sides, most, key, value)
    return _tiles(rows, most, key, value, links)


def _masks(width: int, radius: int) -> list[int]:
    """All numbers of so many bits that have ``radius`` bits set at most."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _balls(hashes: DataFrame, most: int, value: str) -> tuple[DataFrame, DataFrame]:
    """(h, block, bits) twice: a row for each point of a ball around each block of a hash's bits. Hashes within
    ``most`` bits differ by a third of that at most in one of three blocks, and then have a point there that is in the
    smaller ball of one and the larger of the other."""
    radius = most // BALL_BLOCKS
    width = [64 // BALL_BLOCKS + (i < 64 % BALL_BLOCKS) for i in range(BALL_BLOCKS)]
    begin = [sum(width[:i]) for i in range(BALL_BLOCKS)]
    distinct = hashes.select(F.col(value).alias("h")).distinct()

    def around(b: int, w: int, r: int):
        own = F.shiftrightunsigned("h", b).bitwiseAND(F.lit((1 << w) - 1))
        return F.transform(F.array(*(F.lit(m).cast("long") for m in _masks(w, r))), lambda m: own.bitwiseXOR(m))

    def side(r: int) -> DataFrame:
        points = [around(b, w, r) for b, w in zip(begin, width, strict=True)]
        rows = distinct.select("h", F.posexplode(F.array(*points)).alias("block", "points"))
        return rows.select("h", "block", F.explode("points").alias("bits"))

    return side(radius // 2), side(radius - radius // 2)


def _meetings(small: DataFrame, large: DataFrame) -> int:
    """Pairs that meet on a point, counted without making them."""
    x, y = (t.groupBy("block", "bits").agg(F.count("*").alias(n)) for t, n in ((small, "x"), (large, "y")))
    return x.join(y, ["block", "bits"]).agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0))).first()[0]


def _ball_pairs(hashes: DataFrame, sides: tuple[DataFrame, DataFrame], most: int, key: str, value: str) -> DataFrame:
    """(p, q, distance) of the pairs that meet in balls and are within ``most`` bits."""
    a, b = sides[0].withColumnRenamed("h", "x"), sides[1].withColumnRenamed("h", "y")
    near = a.join(b, ["block", "bits"]).where((F.col("x") != F.col("y")) & (hamming(F.col("x"), F.col("y")) <= most))
    once = near.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    of = hashes.select(F.col(value).alias("h"), F.col(key).alias("id"))
    across = once.join(of.select(F.col("h").alias("x"), F.col("id").alias("p")), "x").join(of.select(F.col("h").alias("y"), F.col("id").alias("q")), "y")
    same = of.join(of.select("h", F.col("id").alias("q")), "h").where("id < q").select(F.col("id").alias("p"), "q", F.lit(0).alias("distance"))
    return across.select("p", "q", hamming(F.col("x"), F.col("y")).alias("distance")).unionByName(same)


def _band_pairs(hashes: DataFrame, most: int, key: str, value: str) -> DataFrame:
    distinct = hashes.groupBy(value).agg(F.sort_array(F.collect_list(key)).alias("ids"))
    width = _band_widths(most)
    bands = len(width)
    begin = [sum(width[:i]) for i in range(bands)]
    parts = [F.shiftrightunsigned(F.col(value), b).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1)) for b, w in zip(begin, width, strict=True)]
    rows = distinct.select(F.col(value).alias("h"), "ids", F.posexplode(F.array(*parts)).alias("band", "bits"))
    a, b = rows.alias("a"), rows.alias("b")
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.h") < F.col("b.h")) & (hamming(F.col("a.h"), F.col("b.h")) <= most))
    difference = F.col("a.h").bitwiseXOR(F.col("b.h"))
    earlier = F.lit(False)
    for i in range(bands):
        mask = ((1 << width[i]) - 1) << begin[i]
        earlier = earlier | ((F.col("a.band") > i) & (difference.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)) == 0))
    once = met.where(~earlier).select(F.col("a.ids").alias("x"), F.col("b.ids").alias("y"), hamming(F.col("a.h"), F.col("b.h")).alias("distance"))
    across = once.select(F.explode("x").alias("p"), "y", "distance").select("p", F.explode("y").alias("q"), "distance")
    same = distinct.where(F.size("ids") > 1).select(F.explode("ids").alias("p"), "ids").select("p", F.explode("ids").alias("q")).where("p < q").withColumn("distance", F.lit(0))
    return across.unionByName(same)


def _near(x: np.ndarray, y: np.ndarray, most: int, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in x and y, and distances, of the pairs within ``most`` bits, some at a time; own: x is y, each pair once."""
    differ, bits = np.empty((64, 4096), np.uint64), np.empty((64, 4096), np.uint8)
    held, size = [], 0
    for a in range(0, len(x), 64):
        u = x[a : a + 64, None]
        for b in range(a // 4096 * 4096 if own else 0, len(y), 4096):
            v = y[b : b + 4096]
            at = np.s_[: len(u), : len(v)]
            d = np.bitwise_count(np.bitwise_xor(u, v, out=differ[at]), out=bits[at])
            r, c = np.divmod(np.flatnonzero(d <= most), len(v))
            if own:
                once = r + a < c + b
                r, c = r[once], c[once]
            if len(r):
                held.append((r + a, c + b, d[r, c]))
                size += len(r)
            if size >= 1 << 17:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _merged(least: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The least member of each node's component, after links between r and c."""
    while True:
        a, b = least[r], least[c]
        apart = a != b
        if not apart.any():
            return least
        r, c, a, b = r[apart], c[apart], a[apart], b[apart]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (up := least[least]).tobytes() != least.tobytes():
            least = up


def _tiles(hashes: DataFrame, most: int, key: str, value: str, links: bool) -> DataFrame:
    """(p, q, distance) of all pairs within ``most`` bits; links: of a spanning forest of each pair of blocks.

    Rows are dealt to blocks, which are one array each; a task compares two of them. The block count
    follows the rows, so what a task holds does not.
    """
    rows = hashes.count()
    n = max(min(LEAST_BLOCKS, -(-rows // FEW_HASHES)), -(-rows // HASHES), 1)
    dealt = hashes.select(F.col(key).alias("id"), F.col(value).alias("h"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block"))
    blocks = dealt.groupBy("block").agg(F.collect_list(F.struct("id", "h")).alias("rows"))
    sides = blocks.select("block", "rows", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")).select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rows")
    pairs = sides.repartition(min(n * (n + 1) // 2, 10_000), "i", "j").groupBy("i", "j").agg(F.collect_list("rows").alias("sides"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sides in zip(*batch.columns, strict=True):
                parts = [side.values.flatten() for side in sides.values]
                own = i.as_py() == j.as_py()
                if len(parts) == 1 and not own:
                    continue  # the other block has no rows
                (p, x), (q, y) = parts[0], parts[-1]
                near = _near(x.to_numpy().view(np.uint64), y.to_numpy().view(np.uint64), most, own)
                if links:
                    nodes, shift = (p, 0) if own else (pa.concat_arrays([p, q]), len(p))
                    least = np.arange(len(nodes))
                    for r, c, _ in near:
                        least = _merged(least, r, c + shift)
                    moved = np.flatnonzero(least != np.arange(len(nodes)))
                    near, p, q = [(moved, least[moved], np.zeros(len(moved), np.uint8))], nodes, nodes
                for r, c, d in near:
                    yield pa.RecordBatch.from_arrays([p.take(pa.array(r)), q.take(pa.array(c)), pa.array(d.astype(np.int32))], names=["p", "q", "distance"])

    kind = hashes.schema[key].dataType.simpleString()
    ship(hashes.sparkSession)
    return pairs.mapInArrow(run, f"p {kind}, q {kind}, distance int")


def _rows(column: pa.Array) -> np.ndarray:
    """Vectors as rows of one array; shorter ones end in zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    values = column.flatten()
    if len(lengths) and not values.null_count and (lengths == lengths[0]).all():
        return values.to_numpy().reshape(len(lengths), -1) if lengths[0] else np.zeros((len(lengths), 0))
    rows = column.to_pylist()
    return _padded([np.array(r, np.float64)[None] for r in rows])


def _padded(parts: list[np.ndarray]) -> np.ndarray:
    """Arrays below each other, as wide as the widest."""
    width = max((p.shape[1] for p in parts), default=0)
    return np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts]) if parts else np.zeros((0, 0))


def _unit(rows: np.ndarray) -> np.ndarray:
    """Vectors of length one; those without a finite direction become zeros."""
    x = rows.astype(np.float64)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(1))
        x = np.where(norm[:, None] > 0, x / norm[:, None], 0.0)
    return np.where(np.isfinite(x).all(1)[:, None], x, 0.0)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = np.split(_padded([x, y]), [len(x)])
    return np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T))


def _pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Rows of the sample, each the one furthest from those before it."""
    if not len(sample):
        return sample
    at, far = [0], _apart(sample, sample[:1])[:, 0]
    while len(at) < min(n, len(sample)) and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, _apart(sample, sample[at[-1:]])[:, 0])
    return sample[at]


def _number(vectors: DataFrame, value: str) -> str:
    """Type of the numbers of packed vectors: that of the column, if it is single precision."""
    return "float" if vectors.schema[value].dataType.simpleString() == "array<float>" else "double"


def _vector_blocks(vectors: DataFrame, key: str, value: str, rows: int, size: int) -> tuple[DataFrame, np.ndarray]:
    """(block, pivot, lo, hi, stripe, ids binary, x binary): rows near the same pivot and at like distances stand together,
    as they are. A stripe is a run of blocks. The pivots are fitted on at most ``SAMPLE_ROWS`` rows."""
    number = _number(vectors, value)
    kind = np.dtype(np.float32 if number == "float" else np.float64)
    kept = vectors.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(value).cast(f"array<{number}>").alias("v"))
    parts = max(1, -(-rows // size))
    sample = _rows(kept.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toArrow()["v"].combine_chunks())
    pivots = _pivots(_unit(sample), min(PIVOTS, parts))
    stripes = min(parts, max(STRIPES, -(-rows * sample.shape[1] * kind.itemsize // STRIPE_BYTES)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(1)).astype(kind)
            far = _apart(_unit(x), pivots)
            at = far.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(far[np.arange(len(x)), at]), batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["pivot", "far", "id", "x"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(t: pa.Table) -> pa.RecordBatch:
            far, x = t["far"].to_numpy(), t["x"].to_pylist()
            width = max(map(len, x))  # of the widest; zero bytes are zeros
            return pa.RecordBatch.from_pylist([{"pivot": t["pivot"][0].as_py(), "lo": far.min(), "hi": far.max(), "ids": t["id"].to_numpy().tobytes(), "x": b"".join(r.ljust(width, b"\0") for r in x)}], schema)

        schema = pa.schema([("pivot", pa.int32()), ("lo", pa.float64()), ("hi", pa.float64()), ("ids", pa.binary()), ("x", pa.binary())])
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            while held.num_rows:
                own = int(np.searchsorted(held["pivot"].to_numpy(), held["pivot"][0].as_py(), "right"))
                if own == held.num_rows and own < size:
                    break
                yield block(held.slice(0, min(own, size)))
                held = held.slice(min(own, size))
        if held is not None and held.num_rows:
            yield block(held)

    ship(vectors.sparkSession)
    near = kept.mapInArrow(placed, "pivot int, far double, id long, x binary")
    dealt = near.repartitionByRange(parts, "pivot", "far", "id").sortWithinPartitions("pivot", "far", "id")
    blocks = dealt.mapInArrow(packed, "pivot int, lo double, hi double, ids binary, x binary").withColumn("block", F.monotonically_increasing_id())
    return written(blocks.withColumn("stripe", F.least(F.lit(stripes - 1), F.floor(F.shiftright("block", 33) * stripes / parts)).cast("int")), "blocks"), pivots


def _block_pairs(blocks: DataFrame, pivots: np.ndarray, least: float) -> DataFrame:
    """(i, j, stripe_i, stripe_j) of the blocks, i <= j, that may hold a pair: distances to pivots bound those between rows."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6
    apart = _apart(pivots, pivots)
    told = blocks.sparkSession.createDataFrame([(i, j, float(apart[i, j])) for i in range(len(pivots)) for j in range(len(pivots))], "pivot_i int, pivot_j int, apart double")
    i, j = (blocks.select(F.col("block").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("pivot", "lo", "hi", "stripe"))) for k in "ij")
    bound = F.greatest(F.col("apart") - F.col("hi_i") - F.col("hi_j"), F.col("lo_i") - F.col("apart") - F.col("hi_j"), F.col("lo_j") - F.col("apart") - F.col("hi_i"))
    # vectors without a direction are at the origin, not on the sphere; they have no similar ones
    return i.join(F.broadcast(told), "pivot_i").join(j, "pivot_j").where((F.col("i") <= F.col("j")) & (bound <= reach)).select("i", "j", "stripe_i", "stripe_j")


def _similar(x: np.ndarray, y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, row of y, similarity) of unit vectors that reach ``least``. Single precision, whose error is less than
    the slack, finds them; double precision decides."""
    slack = (x.shape[1] + 8) * 2.0**-23
    single, other = x.astype(np.float32), y.astype(np.float32).T
    room = np.empty((min(512, len(x)), len(y)), np.float32)
    for start in range(0, len(x), 512):
        part = x[start : start + 512]
        near = np.matmul(single[start : start + 512], other, out=room[: len(part)])
        r, c = np.divmod(np.flatnonzero(near >= least - slack), len(y))
        if len(r) * 16 > len(part) * len(y):
            s = (part @ y.T)[r, c]
        else:
            s = np.concatenate([np.einsum("ij,ij->i", part[r[k : k + 16_384]], y[c[k : k + 16_384]]) for k in range(0, max(1, len(r)), 16_384)])
        kept = s >= least
        yield r[kept] + start, c[kept], s[kept]


def _sides(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(task, block, others, ids, x): tasks are pairs of stripes. A block goes once to each task that compares it, and so
    to no more than there are stripes; others are the blocks to compare it with there."""
    dealt = pairs.select((F.col("stripe_j") * (F.col("stripe_j") + 1) / 2 + F.col("stripe_i")).cast("int").alias("task"), "i", "j")
    met = dealt.select("task", F.col("j").alias("block"), F.col("i").alias("other")).unionAll(dealt.select("task", "i", F.lit(None).cast("long")).distinct())
    return met.groupBy("task", "block").agg(F.collect_list("other").alias("others")).join(blocks.select("block", "ids", "x"), "block").select("task", "block", "others", "ids", "x")


def _cosine(vectors: DataFrame, least: float, key: str, value: str, size: int, links: bool) -> DataFrame:
    blocks, pivots = _vector_blocks(vectors, key, value, vectors.count(), size)
    if not len(pivots):
        return vectors.sparkSession.createDataFrame([], "a long, b long, similarity double")
    kind = np.float32 if _number(vectors, value) == "float" else np.float64
    stripes = blocks.agg(F.max("stripe")).first()[0] + 1
    sides = _sides(blocks, _block_pairs(blocks, pivots, least))

    def table(a: np.ndarray, b: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    def compared(held: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
        ids = {b: np.frombuffer(i, np.int64) for b, (_, i, _) in held.items()}
        unit = lambda b: _unit(np.frombuffer(held[b][2], kind).reshape(len(ids[b]), -1))
        nodes = np.unique(np.concatenate(list(ids.values()))) if links else np.zeros(0, np.int64)
        at = {b: np.searchsorted(nodes, i) for b, i in ids.items()} if links else {}
        forest, out, n = np.arange(len(nodes)), [], 0
        for j, (others, _, _) in held.items():
            y = unit(j) if others else None
            for i in others:
                if links and (forest[np.concatenate([at[i], at[j]])] == forest[at[j][0]]).all():
                    continue  # linked by other pairs
                x, z = np.split(_padded([unit(i), y]), [len(ids[i])])
                for r, c, s in _similar(x, z, least):
                    if links:
                        forest = _merged(forest, at[i][r], at[j][c])
                        continue
                    p, q = ids[i][r], ids[j][c]
                    once = p < q if i == j else p != q
                    out.append((np.minimum(p, q)[once], np.maximum(p, q)[once], s[once]))
                    n += len(s)
                    if n >= 1 << 17:
                        yield table(*map(np.concatenate, zip(*out, strict=True)))
                        out, n = [], 0
        if links:
            moved = np.flatnonzero(forest != np.arange(len(forest)))
            out = [(nodes[forest[moved]], nodes[moved], np.ones(len(moved)))]
        if out:
            yield table(*map(np.concatenate, zip(*out, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks: dict[int, dict[int, tuple]] = {}
        for batch in batches:
            for task, block, others, ids, x in zip(*batch.columns, strict=True):
                tasks.setdefault(task.as_py(), {})[block.as_py()] = others.as_py(), ids.as_buffer(), x.as_buffer()
        for held in tasks.values():  # one, as each has a partition of its own
            yield from compared(held)

    return sides.repartitionById(stripes * (stripes + 1) // 2, F.col("task")).mapInArrow(run, "a long, b long, similarity double")


def cosine_pairs(vectors: DataFrame, least: float, key: str = "id", value: str = "vector", block: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, similarity) with a < b of vectors with a cosine of ``least`` (above 0) or more; keys are whole numbers.

    Rows are packed once into blocks of neighbours, by nearest pivot and distance to it. Pairs of blocks that the
    triangle inequality puts too far apart are never compared; the others are compared by matrix products. Blocks form
    ``STRIPES`` stripes, and a task holds a pair of stripes, so a row is shuffled once a stripe at most, whatever the number
    of rows; only beyond ``STRIPES`` times ``STRIPE_BYTES`` of vectors there are more. Exact; in data without clusters all
    blocks are compared.
    """
    return _cosine(vectors, least, key, value, block, False)


def cosine_links(vectors: DataFrame, least: float, key: str = "id", value: str = "vector", block: int = BLOCK_ROWS) -> DataFrame:
    """(a, b): fewer links with the same components as the pairs; a pair of stripes gives a row of it at most one."""
    return _cosine(vectors, least, key, value, block, True).select("a", "b")


def groups_of(edges: DataFrame) -> DataFrame:
    """(component, members) of the groups of linked rows; the component is the least member."""
    return components(edges).groupBy("component").agg(F.sort_array(F.collect_set("node")).alias("members"))
