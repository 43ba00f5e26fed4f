"""Arrays of numbers as column expressions: perceptual hashes, similarities, face geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: single-precision machine epsilon.
EPSILON = 1.1920929e-7
#: Mesh points of the eyes and the mouth (0-based).
LEFT_EYE = (33, 160, 158, 133, 153, 144)
RIGHT_EYE = (362, 385, 387, 263, 373, 380)
MOUTH = (61, 291, 13, 14)


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def phash_bits(block: Column) -> Column:
    """64 bits of an 8 by 8 block of frequencies (row-major, the first the mean): bit i is set where the
    value is at least the upper median of the 63 others; 0 where that is no more than rounding."""

    def bits(v: Column) -> Column:
        median = F.get(F.sort_array(F.slice(v, 2, 63)), F.lit(31))
        return let(median, lambda m: F.when(F.abs(m) < EPSILON, F.lit(0).cast("bigint")).otherwise(F.aggregate(F.transform(v, lambda x, i: F.when(x >= m, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))))

    return let(F.transform(block, lambda x: x.cast("float")), bits)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a zero norm or anything not finite."""
    value = dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))
    return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def l2_normalized(v: Column) -> Column:
    """Unit length, where the norm is more than rounding."""
    return let(F.sqrt(dot(v, v)), lambda n: F.when(n > EPSILON, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double"))))


def clamped(value: Column, limit: int) -> Column:
    """A float as a whole number from 0 to the limit; NaN gives 0."""
    return F.when(value.isNull() | F.isnan(value) | (value <= 0), 0).when(value >= limit, limit).otherwise(F.floor(value)).cast("bigint")


def share_above(values: Column, cut: float) -> Column:
    """Share of the values above the cut."""
    return F.size(F.filter(values, lambda x: x > cut)) / F.nullif(F.size(values), F.lit(0))


def distance(mesh: Column, a: int, b: int) -> Column:
    p, q = F.get(mesh, F.lit(a)), F.get(mesh, F.lit(b))
    return F.hypot(F.get(p, F.lit(0)).cast("double") - F.get(q, F.lit(0)), F.get(p, F.lit(1)).cast("double") - F.get(q, F.lit(1)))


def eye_aspect(mesh: Column, points: tuple[int, ...]) -> Column:
    """Height by width of one eye; null for a narrow one."""
    p1, p2, p3, p4, p5, p6 = points
    width = distance(mesh, p1, p4)
    return F.when(width >= EPSILON, (distance(mesh, p2, p6) + distance(mesh, p3, p5)) / (2 * width))


def eye_aspect_ratio(mesh: Column, left: tuple[int, ...] = LEFT_EYE, right: tuple[int, ...] = RIGHT_EYE, points: int = 468) -> Column:
    """Mean of both eyes; null for a mesh that lacks points."""
    return F.when(F.size(mesh) >= points, (eye_aspect(mesh, left) + eye_aspect(mesh, right)) / 2)


def smile(mesh: Column, mouth: tuple[int, ...] = MOUTH, points: int = 468) -> Column:
    """How far the corners of the mouth stand above its middle, by its width; 0 at least."""
    left, right, upper, lower = mouth
    y = lambda i: F.get(F.get(mesh, F.lit(i)), F.lit(1)).cast("double")
    width = distance(mesh, left, right)
    curl = (y(left) + y(right)) / 2 - (y(upper) + y(lower)) / 2
    return F.when(F.size(mesh) >= points, F.when(width >= EPSILON, F.greatest(F.lit(0.0), -curl / width)).otherwise(0.0))
