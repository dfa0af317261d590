"""Row-wise operators: transforms, predicates, crops, colours, and grid re-indexing.

All of them are projections and filters inside code generation; box tests reach
the scan as pushed filters where x, y and z are stored columns.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cloud import dot, is_finite, require

Matrix = Sequence[Sequence[float]]


def rotation(axis: Sequence[float], angle: float) -> list[list[float]]:
    """The matrix that turns by an angle around an axis."""
    n = math.sqrt(sum(a * a for a in axis))
    x, y, z = (a / n for a in axis)
    c, s = math.cos(angle), math.sin(angle)
    t = 1 - c
    return [[t * x * x + c, t * x * y - s * z, t * x * z + s * y], [t * x * y + s * z, t * y * y + c, t * y * z - s * x], [t * x * z - s * y, t * y * z + s * x, t * z * z + c]]


def map_points(df: DataFrame, **columns: Column) -> DataFrame:
    """Row-wise transform: the given columns replace or join the others."""
    return df.withColumns(columns)


def zip_map(a: DataFrame, b: DataFrame, **columns: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]) -> DataFrame:
    """idx and what the functions make of the rows with the same idx; both sides have to have the same ids.

    A function gets two lookups of columns by name: of a's and of b's.
    """

    def of(side: str) -> Callable[[str], Column]:
        return lambda name: F.col(f"{side}.{name}")

    return a.alias("a").join(b.alias("b"), F.col("a.idx") == F.col("b.idx")).select("a.idx", *(f(of("a"), of("b")).alias(name) for name, f in columns.items()))


def split(df: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) rows; a null predicate removes."""
    keep = F.coalesce(keep, F.lit(False))
    return df.where(keep), df.where(~keep)


def take(df: DataFrame, order: DataFrame) -> DataFrame:
    """Rows at given ids; order has pos and idx, and repeated ids repeat rows.  The result has pos."""
    return order.select("pos", "idx").join(df, "idx")


def select_ids(df: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The rows with the given ids, each once; without ids all rows."""
    return df if ids is None else df.join(ids.select("idx"), "idx", "left_semi")


def transform(df: DataFrame, matrix: Matrix) -> DataFrame:
    """A 3 x 4 or 4 x 4 affine matrix on x, y, z; missing points and other columns stay."""
    new = {c: F.when(is_finite(), dot(tuple(m[:3]), ("x", "y", "z")) + F.lit(float(m[3]))).otherwise(F.col(c)) for c, m in zip("xyz", matrix, strict=False)}
    return df.withColumns(new)


def transform_normals(df: DataFrame, matrix: Matrix) -> DataFrame:
    """Only the linear part of the matrix, on nx, ny, nz."""
    require(df, "nx", "ny", "nz")
    return df.withColumns({c: dot(tuple(m[:3]), ("nx", "ny", "nz")) for c, m in zip(("nx", "ny", "nz"), matrix, strict=False)})


def demean(df: DataFrame, centroid: DataFrame) -> DataFrame:
    """Coordinates minus those of the one-row DataFrame centroid (x, y, z)."""
    c = F.broadcast(centroid.select(*(F.col(k).alias(f"__{k}") for k in "xyz")))  # one row
    return df.crossJoin(c).withColumns({k: F.col(k) - F.col(f"__{k}") for k in "xyz"}).drop("__x", "__y", "__z")


def in_box(low: Sequence[float], high: Sequence[float]) -> Column:
    """Inclusive; a missing point is in no box."""
    out = is_finite()
    for c, a, b in zip("xyz", low, high, strict=True):
        out = F.col(c).between(float(a), float(b)) & out
    return out


def box_select(df: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    return df.where(in_box(low, high))


def in_crop_box(low: Sequence[float], high: Sequence[float], turned: Matrix | None = None, negative: bool = False) -> Column:
    """The box test after turning points back around the box's centre by the inverse (the transpose) of a rotation."""
    if turned is None:
        inside = F.lit(True)
        for c, a, b in zip("xyz", low, high, strict=True):
            inside = inside & F.col(c).between(float(a), float(b))
    else:
        centre = [(a + b) / 2 for a, b in zip(low, high, strict=True)]
        d = tuple(F.col(c) - m for c, m in zip("xyz", centre, strict=True))
        inside = F.lit(True)
        for k in range(3):
            back = dot(d, tuple(row[k] for row in turned)) + F.lit(centre[k])
            inside = inside & back.between(float(low[k]), float(high[k]))
    return ~inside if negative else inside


def crop_box(df: DataFrame, low, high, turned: Matrix | None = None, negative: bool = False) -> DataFrame:
    return df.where(in_crop_box(low, high, turned, negative))


def crop_plane(df: DataFrame, centre: Sequence[float], normal: Sequence[float]) -> DataFrame:
    """Points on the side that the normal points to, the plane included."""
    return df.where(dot(tuple(F.col(c) - float(m) for c, m in zip("xyz", centre, strict=True)), tuple(map(float, normal))) >= 0)


def frustum_planes(near: float, far: float, horizontal_fov: float, vertical_fov: float, roi: Sequence[float] = (-1, 1, -1, 1), pose: Matrix | None = None) -> list[tuple[list[float], list[float]]]:
    """(point, inward normal) of the six planes.

    The camera looks along x with y to the left and z up.  Half the extent at a
    distance is distance * tan(fov); roi narrows it: y from roi[0] to roi[1] and
    z from roi[2] to roi[3] of it.
    """
    if not (0 < near < far and 0 < horizontal_fov < math.pi / 2 and 0 < vertical_fov < math.pi / 2 and -1 <= roi[0] < roi[1] <= 1 and -1 <= roi[2] < roi[3] <= 1):
        raise ValueError("not a frustum")
    w, h = math.tan(horizontal_fov), math.tan(vertical_fov)
    planes = [([near, 0, 0], [1, 0, 0]), ([far, 0, 0], [-1, 0, 0]), ([0, 0, 0], [w * roi[1], -1, 0]), ([0, 0, 0], [-w * roi[0], 1, 0]), ([0, 0, 0], [h * roi[3], 0, -1]), ([0, 0, 0], [-h * roi[2], 0, 1])]
    if pose is None:
        return planes

    def moved(v, t):
        return [sum(m[k] * v[k] for k in range(3)) + t * m[3] for m in pose[:3]]

    return [(moved(p, 1), moved(n, 0)) for p, n in planes]


def frustum_culling(df: DataFrame, near: float, far: float, horizontal_fov: float, vertical_fov: float, roi: Sequence[float] = (-1, 1, -1, 1), pose: Matrix | None = None) -> DataFrame:
    """Points inside all six planes, faces included."""
    inside = F.lit(True)
    for p, n in frustum_planes(near, far, horizontal_fov, vertical_fov, roi, pose):
        inside = inside & (dot(tuple(F.col(c) - float(m) for c, m in zip("xyz", p, strict=True)), tuple(map(float, n))) >= 0)
    return df.where(inside)


def shadow_points(df: DataFrame, threshold: float, negative: bool = False) -> DataFrame:
    """Points with abs(p . n) >= threshold, or the others."""
    require(df, "nx", "ny", "nz")
    lit = F.abs(dot(("x", "y", "z"), ("nx", "ny", "nz"))) >= threshold
    return df.where(~lit if negative else lit)


def pack_rgba(b: Column, g: Column, r: Column, a: Column) -> Column:
    return b.cast("bigint") + F.shiftleft(g.cast("bigint"), 8) + F.shiftleft(r.cast("bigint"), 16) + F.shiftleft(a.cast("bigint"), 24)


def unpack_rgba(rgba: Column) -> dict[str, Column]:
    return {name: F.shiftrightunsigned(rgba.cast("bigint"), 8 * k).bitwiseAND(255) for k, name in enumerate("bgra")}


def transpose(df: DataFrame, height: int) -> DataFrame:
    """The grid with rows and columns exchanged; idx follows from the new width, which is the old height."""
    return df.withColumns({"row": F.col("col"), "col": F.col("row"), "idx": F.col("col") * height + F.col("row")})


#: Bits of a hash by which rows are counted before the rest is looked at.
COUNTED_BITS = 16


def random_sample(df: DataFrame, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sample of n rows, the others): the n smallest hashes of idx and the seed; all rows if there are no more than n.

    Rows are counted by the first bits of their hashes, which gives the threshold;
    only the rows of the one count that it falls into, a share of 2 ** -COUNTED_BITS of all, are
    put in order.
    """
    keyed = df.withColumn("__h", F.xxhash64(F.col("idx"), F.lit(seed)))
    part = F.shiftright("__h", 64 - COUNTED_BITS)
    left, at = n, None
    for value, rows in sorted(map(tuple, keyed.groupBy(part.alias("p")).count().collect())):  # at most 2 ** COUNTED_BITS rows
        if rows > left:
            at = value
            break
        left -= rows
    if at is None:
        return df, df.limit(0)
    edge = keyed.where(part == at).orderBy("__h", "idx").limit(left)
    sample = keyed.where(part < at).union(edge)
    last = F.broadcast(edge.agg(F.max(F.struct("__h", "idx")).alias("__e")))  # one row
    rest = keyed.where(part >= at).crossJoin(last).where(F.col("__e").isNull() | (F.struct("__h", "idx") > F.col("__e")))
    return sample.drop("__h"), rest.drop("__h", "__e")
