"""Exact neighbour search by equi-joins on cells.

Points are keyed by cells as wide as the radius; a query looks into its own cell
and the 26 around it.  The join is an equi-join, sorted and merged, whose skewed
cells Spark may split; the distance is a filter on what it yields.  The query side carries
the 27 copies of narrow rows (id, coordinates), not the attributes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cloud import dot, finite, require
from . import pyramid
from .aggregates import finite_bound, projection_matrix
from .store import saved

QUERY = ("qidx", "qx", "qy", "qz")


def as_queries(df: DataFrame) -> DataFrame:
    return finite(df).select(F.col("idx").alias("qidx"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz"))


def around(axes: str, reach: int = 1):
    """An array of the offsets to the cells around one, itself included."""
    cells = [[]]
    for _ in axes:
        cells = [[*c, d] for c in cells for d in range(-reach, reach + 1)]
    return F.array(*(F.struct(*(F.lit(d).cast("bigint").alias(f"d{a}") for a, d in zip(axes, c, strict=True))) for c in cells))


def cell_join(queries: DataFrame, points: DataFrame, radius: float, axes: str = "xyz") -> DataFrame:
    """All pairs of a query and a point in touching cells, with d2, the squared distance along the axes.

    queries: qidx, q<axis>, and what else is to come along; points: idx, x, y, z
    and what else.
    """
    cell = {f"__c{a}": F.floor(F.col(a) / radius) for a in axes}
    near = queries.withColumn("__o", F.explode(around(axes))).withColumns({f"__c{a}": F.floor(F.col(f"q{a}") / radius) + F.col(f"__o.d{a}") for a in axes}).drop("__o")
    d2 = sum(((F.col(a) - F.col(f"q{a}")) * (F.col(a) - F.col(f"q{a}")) for a in axes), F.lit(0.0))
    return near.join(points.withColumns(cell).hint("merge"), list(cell)).drop(*cell).withColumn("d2", d2)


def radius_search(df: DataFrame, radius: float, queries: DataFrame | None = None, strict: bool = False, extra: tuple[str, ...] = ()) -> DataFrame:
    """qidx, idx, distance (and columns `extra` of the points) for each point within the radius of a query, itself included."""
    points = finite(df).select("idx", "x", "y", "z", *extra)
    found = cell_join(as_queries(df) if queries is None else queries, points, radius)
    limit = F.lit(float(radius) * float(radius))
    near = found.where(F.col("d2") < limit if strict else F.col("d2") <= limit)
    return near.select("qidx", "idx", F.sqrt("d2").alias("distance"), *extra)


def knn_search(df: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """qidx, rank (1 to k), idx, distance: the k nearest points of each query, itself included, the smallest idx of equals.

    By descent through an octree, level by level (see pyramid): exact, whatever
    the points' density, and a point far away widens nobody else's search.  Of
    points at one place only the k with the smallest idx can be among the nearest,
    and queries at one place have the same; so a heap of equal points makes no more
    pairs than one point.
    """
    points = finite(df).select("idx", "x", "y", "z")
    asked = as_queries(df) if queries is None else queries.select(*QUERY)
    places = asked.select("qx", "qy", "qz").distinct()
    first = points.withColumn("__r", F.row_number().over(Window.partitionBy("x", "y", "z").orderBy("idx"))).where(F.col("__r") <= k).drop("__r")
    found = pyramid.candidates(first, places, k)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qx", "qy", "qz").orderBy("d2", "idx"))).where(F.col("rank") <= k)
    return asked.join(ranked, ["qx", "qy", "qz"]).select("qidx", "rank", "idx", F.sqrt("d2").alias("distance"))


def grid_window(df: DataFrame, half: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """qidx, qrow, qcol (and q<c> for each c in `carry`) and the pixels (all columns) within `half` rows and columns of each pixel of an organized cloud.

    Merged, never broadcast: either side is as large as the cloud, whatever its files' size makes Spark expect.
    """
    q = df.select(F.col("idx").alias("qidx"), F.col("row").alias("qrow"), F.col("col").alias("qcol"), *(F.col(c).alias(f"q{c}") for c in carry))
    shift = F.array(*(F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(j).cast("bigint").alias("j")) for i in range(-half, half + 1) for j in range(-half, half + 1)))
    near = q.withColumn("o", F.explode(shift)).withColumns({"row": F.col("qrow") + F.col("o.i"), "col": F.col("qcol") + F.col("o.j")}).drop("o")
    return near.join(df.hint("merge"), ["row", "col"])


def organized_radius(df: DataFrame, radius: float, half: int) -> DataFrame:
    """qidx, idx, distance within a radius among the pixels of a window around each pixel; neighbours outside the window don't count (see organized_search)."""
    near = grid_window(finite(df).select("idx", "row", "col", "x", "y", "z"), half, ("x", "y", "z"))
    d2 = sum(((F.col(a) - F.col(f"q{a}")) * (F.col(a) - F.col(f"q{a}")) for a in "xyz"), F.lit(0.0))
    return near.withColumn("d2", d2).where(F.col("d2") <= radius * radius).select("qidx", "idx", F.sqrt("d2").alias("distance"))


# --- organized clouds: the pixels that a sphere can fall on -------------------------


@dataclass(frozen=True)
class Projection:
    """A 3 x 4 camera matrix, how far any point's pixel is from where the matrix puts it, and the image's last row and column."""

    matrix: tuple[tuple[float, ...], ...]
    slack: float
    last_row: int
    last_col: int

    def project(self, p: tuple = ("x", "y", "z")) -> dict[str, Column]:
        """col and row (not rounded) of points; null where they have none."""
        u, v, w = (self._row(k, p) for k in range(3))
        w = F.when(w != 0, w)
        return {"col": u / w, "row": v / w}

    def _row(self, k: int, p: tuple) -> Column:
        m = self.matrix[k]
        return dot(tuple(m[:3]), p) + float(m[3])

    def box(self, radius: float | Column, p: tuple = ("qx", "qy", "qz")) -> dict[str, Column]:
        """first_row, last_row, first_col, last_col: the pixels that the sphere around a point can fall on; the whole image where it reaches the camera's own plane.

        A plane through the camera centre touches the sphere where
        r^2 |k|^2 = (p . m)^2; for planes of a constant row or column that is
        a quadratic equation in it.
        """
        m = np.asarray(self.matrix)
        k = m[:, :3] @ m[:, :3].T
        r2 = F.lit(radius) * F.lit(radius)
        u, v, w = (self._row(i, p) for i in range(3))
        a = r2 * float(k[2, 2]) - w * w
        out = {}
        for name, at, i, last in (("row", v, 1, self.last_row), ("col", u, 0, self.last_col)):
            b = r2 * float(k[i, 2]) - at * w
            root = F.sqrt(F.greatest(F.lit(0.0), b * b - a * (r2 * float(k[i, i]) - at * at)))
            ends = (b - root) / a, (b + root) / a
            lo = F.greatest(F.lit(0), F.floor(F.least(*ends) - self.slack - 1e-6))
            hi = F.least(F.lit(last), F.ceil(F.greatest(*ends) + self.slack + 1e-6))
            out[f"first_{name}"] = F.when(a < 0, lo).otherwise(0).cast("long")
            out[f"last_{name}"] = F.when(a < 0, hi).otherwise(last).cast("long")
        return out


def organized_fit(df: DataFrame, epsilon: float) -> Projection | None:
    """The projection that an organized cloud's pixels follow, if their mean squared residual is no more than epsilon."""
    require(df, "row", "col")
    if finite(df).limit(6).count() < 6:
        return None
    matrix, residual = projection_matrix(df)
    if residual > epsilon:
        return None
    p = Projection(tuple(map(tuple, matrix.tolist())), 0.0, 0, 0)
    at = p.project()
    far = finite(df).agg(F.max(F.greatest(F.abs(at["row"] - F.col("row")), F.abs(at["col"] - F.col("col")))).alias("slack"), F.max("row").alias("r"), F.max("col").alias("c"), F.count_if(at["row"].isNull()).alias("none")).first()
    return None if far.none else Projection(p.matrix, float(far.slack), int(far.r), int(far.c))


#: Pixels a side of the tiles that boxes are looked up in; larger boxes than so many tiles a side are no help.
TILE, TILES = 16, 4


def organized_search(df: DataFrame, radius: float, epsilon: float, queries: DataFrame | None = None) -> DataFrame:
    """qidx, idx, distance of all points within the radius of each query, itself included.

    Where the cloud follows a projection (see organized_fit), a query looks into
    the tiles of the image that its sphere can fall on; queries whose box is
    larger than TILES tiles a side, and clouds without a projection, take the
    search by cells.  The result is the same.
    """
    fit = organized_fit(df, epsilon)
    asked = as_queries(df) if queries is None else queries.select(*QUERY)
    if fit is None:
        return radius_search(df, radius, asked)
    near, others = _boxed(df, fit, asked.withColumn("__r", F.lit(float(radius))))
    found = near.where(F.col("d2") <= float(radius) * float(radius)).select("qidx", "idx", F.sqrt("d2").alias("distance"))
    return found.union(radius_search(df, radius, others.select(*QUERY)))


def _boxed(df: DataFrame, fit: Projection, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries with the pixels that the sphere of radius __r around each can fall on, and d2; queries whose box is too large)."""
    boxed = asked.withColumns(fit.box(F.col("__r")))
    tiles = {f"__{c}": (F.expr(f"first_{c} div {TILE}"), F.expr(f"last_{c} div {TILE}")) for c in ("row", "col")}
    small = F.lit(True)
    for lo, hi in tiles.values():
        small = small & (hi - lo < TILES)
    near = boxed.where(small & (F.col("first_row") <= F.col("last_row")) & (F.col("first_col") <= F.col("last_col")))
    for name, (lo, hi) in tiles.items():
        near = near.withColumn(name, F.explode(F.sequence(lo, hi)))
    points = finite(df).select("idx", "x", "y", "z", "row", "col").withColumns({f"__{c}": F.expr(f"{c} div {TILE}") for c in ("row", "col")})
    d2 = sum(((F.col(a) - F.col(f"q{a}")) * (F.col(a) - F.col(f"q{a}")) for a in "xyz"), F.lit(0.0))
    found = near.join(points, list(tiles)).where(F.col("row").between(F.col("first_row"), F.col("last_row")) & F.col("col").between(F.col("first_col"), F.col("last_col")))
    return found.withColumn("d2", d2), boxed.where(~small)


def organized_knn(df: DataFrame, k: int, epsilon: float, queries: DataFrame | None = None) -> DataFrame:
    """qidx, rank, idx, distance of the k nearest points of each query, as knn_search.

    The pixels around a query's own, twice as many as asked for, give a distance
    within which k points are sure to be; the tiles of the image that a sphere of it can
    fall on are all that is searched.  Queries without k pixels around them, or whose
    sphere is wider than TILES tiles, and clouds without a projection, take
    the descent through the octree.  The result is the same.
    """
    fit = organized_fit(df, epsilon)
    asked = as_queries(df) if queries is None else queries.select(*QUERY)
    if fit is None:
        return knn_search(df, k, asked)
    asked = saved(asked)
    half = math.ceil((math.sqrt(2 * k) - 1) / 2)
    at = fit.project(("qx", "qy", "qz"))
    cell = {c: F.greatest(F.lit(0), F.least(F.round(at[c]).cast("long"), F.lit(last))) for c, last in (("row", fit.last_row), ("col", fit.last_col))}
    around = {c: F.explode(F.sequence(F.col(f"__{c}") - half, F.col(f"__{c}") + half)) for c in cell}
    window = asked.withColumns({f"__{c}": v for c, v in cell.items()})
    for c, each in around.items():
        window = window.withColumn(c, each)
    seen = window.select(*QUERY, "row", "col").join(finite(df).select("x", "y", "z", "row", "col"), ["row", "col"])
    d2 = sum(((F.col(a) - F.col(f"q{a}")) * (F.col(a) - F.col(f"q{a}")) for a in "xyz"), F.lit(0.0))
    reach = seen.groupBy(*QUERY).agg(F.get(F.array_sort(F.collect_list(d2)), F.lit(k - 1)).alias("__d2"))  # of one window
    known = saved(asked.join(reach, list(QUERY), "left").withColumn("__r", F.sqrt("__d2") * (1 + 1e-9)))
    near, others = _boxed(df, fit, known.where("__r is not null"))
    ranked = near.where(F.col("d2") <= F.col("__d2")).withColumn("rank", F.row_number().over(Window.partitionBy("qidx").orderBy("d2", "idx"))).where(F.col("rank") <= k)
    rest = others.select(*QUERY).union(known.where("__r is null").select(*QUERY))
    return ranked.select("qidx", "rank", "idx", F.sqrt("d2").alias("distance")).union(knn_search(df, k, rest))


def search(df: DataFrame, *, radius: float | None = None, k: int | None = None, epsilon: float = 1e-6, queries: DataFrame | None = None) -> DataFrame:
    """Points within a radius, or the k nearest: by the image where the cloud has rows and columns, else by cells or the octree."""
    if (radius is None) == (k is None):
        raise ValueError("a radius or k")
    if {"row", "col"} <= set(df.columns):
        return organized_search(df, radius, epsilon, queries) if k is None else organized_knn(df, k, epsilon, queries)
    return radius_search(df, radius, queries) if k is None else knn_search(df, k, queries)


def insert(df: DataFrame, more: DataFrame) -> DataFrame:
    """The points and more points, numbered on after the largest idx in order of their own; searches take the result as any cloud."""
    last = F.broadcast(df.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("__last")))  # one row
    numbered = more.crossJoin(last).withColumn("idx", F.col("idx") + F.col("__last") + 1).drop("__last")
    return df.unionByName(numbered.select(*more.columns), allowMissingColumns=True)


def voxel_search(df: DataFrame, query: tuple[float, float, float], resolution: float) -> DataFrame:
    """The points in the voxel (of a grid that starts at the smallest coordinates) that the query is in."""
    b = F.broadcast(finite_bound(df))  # one row
    out = finite(df).crossJoin(b)
    for c, q in zip("xyz", query, strict=True):
        out = out.where(F.floor((F.col(c) - F.col(f"min_{c}")) / resolution) == F.floor((F.lit(float(q)) - F.col(f"min_{c}")) / resolution))
    return out.select(*df.columns)
