"""Whole-cloud aggregates: one pass, partial sums on each task, one row out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cloud import finite, require
from .points import pack_rgba, unpack_rgba

PAIRS = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))


def centroid(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """x, y, z and n of the finite points; no row if there is none."""
    out = finite(df).groupBy(*(by or [])).agg(*(F.avg(c).alias(c) for c in "xyz"), F.count("*").alias("n"))
    return out if by else out.where("n > 0")


def attribute_means(columns: list[str]) -> list[Column]:
    """Means of the attributes there are: plain for normals (not made unit again), curvature and intensity; the most
    frequent label, the smallest of equals; colours by channel, cut to integers."""
    out = [F.avg(c).alias(c) for c in ("nx", "ny", "nz", "curvature", "intensity") if c in columns]
    if "label" in columns:
        out.append(F.mode("label", True).alias("label"))
    if "rgba" in columns:
        parts = unpack_rgba(F.col("rgba"))
        out.append(pack_rgba(*(F.floor(F.avg(parts[c])) for c in "bgra")).alias("rgba"))
    return out


def centroid_attributes(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The centroid with all attributes."""
    out = finite(df).groupBy(*(by or [])).agg(*(F.avg(c).alias(c) for c in "xyz"), *attribute_means(df.columns), F.count("*").alias("n"))
    return out if by else out.where("n > 0")


def cov_matrix(df: DataFrame, centre: DataFrame | None = None) -> DataFrame:
    """cxx ... czz: sums of products of offsets from a centre (one row; the mean by default), not divided by n."""
    df = finite(df)
    if centre is None:
        return df.agg(*((F.covar_pop(a, b) * F.count("*")).alias(f"c{a}{b}") for a, b in PAIRS), F.count("*").alias("n"))
    c = F.broadcast(centre.select(*(F.col(k).alias(f"__{k}") for k in "xyz")))  # one row
    d = {k: F.col(k) - F.col(f"__{k}") for k in "xyz"}
    return df.crossJoin(c).agg(*(F.sum(d[a] * d[b]).alias(f"c{a}{b}") for a, b in PAIRS), F.count("*").alias("n"))


def cov_matrix_norm(df: DataFrame, centre: DataFrame | None = None) -> DataFrame:
    """The same, divided by the number of finite points."""
    return cov_matrix(df, centre).withColumns({f"c{a}{b}": F.col(f"c{a}{b}") / F.col("n") for a, b in PAIRS})


def centroid_and_cov(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means and population covariances in one pass; groups of fewer than three points have null covariances."""
    many = F.count("*") >= 3
    return finite(df).groupBy(*(by or [])).agg(*(F.avg(c).alias(c) for c in "xyz"), *(F.when(many, F.covar_pop(a, b)).alias(f"c{a}{b}") for a, b in PAIRS), F.count("*").alias("n"))


def finite_bound(df: DataFrame) -> DataFrame:
    """min_x ... max_z of the finite points; no row if there is none."""
    return finite(df).agg(*(F.min(c).alias(f"min_{c}") for c in "xyz"), *(F.max(c).alias(f"max_{c}") for c in "xyz"), F.count("*").alias("n")).where("n > 0").drop("n")


def max_distance(df: DataFrame, pivot: tuple[float, float, float]) -> DataFrame:
    """The point farthest from the pivot, the smallest idx of equals: idx, x, y, z, distance."""
    d = sum(((F.col(c) - float(p)) * (F.col(c) - float(p)) for c, p in zip("xyz", pivot, strict=True)), F.lit(0.0))
    best = F.max_by(F.struct("idx", "x", "y", "z"), F.struct(d.alias("d"), (-F.col("idx")).alias("i"))).alias("p")
    return finite(df).agg(best, F.sqrt(F.max(d)).alias("distance")).where("p is not null").select("p.*", "distance")


def viewpoint_center(df: DataFrame) -> DataFrame:
    """The mean of vx, vy, vz over rows where they are finite."""
    require(df, "vx", "vy", "vz")
    return finite(df, "vx", "vy", "vz").agg(*(F.avg(c).alias(c) for c in ("vx", "vy", "vz")), F.count("*").alias("n")).where("n > 0")


def projection_matrix(df: DataFrame) -> tuple[np.ndarray, float]:
    """(3 x 4 camera matrix, mean squared residual) fitted to (col, row) of the finite points by least squares.

    The matrix has unit third row norm in its first three entries.  Sums are of
    coordinates less their mean and over their deviation: products of four large
    ones would leave no digits of the smallest eigenvalue.  The matrix of norm 1
    with the least residual is the same; the driver solves systems of 12 x 12.
    """
    require(df, "row", "col")
    axes = ("x", "y", "z", "col", "row")
    ok = finite(df).select(*(F.col(c).cast("double").alias(c) for c in axes))
    at = ok.agg(*(F.avg(c).alias(f"m{c}") for c in axes), *(F.stddev_pop(c).alias(f"s{c}") for c in axes)).first()
    mean, dev = ({c: at[f"{k}{c}"] or least for c in axes} for k, least in (("m", 0.0), ("s", 1.0)))
    unit = {c: (F.col(c) - mean[c]) / dev[c] for c in axes}
    p = [unit["x"], unit["y"], unit["z"], F.lit(1.0)]
    most = max(dev["col"], dev["row"])
    u, v = unit["col"] * (dev["col"] / most), unit["row"] * (dev["row"] / most)
    weights = {"1": F.lit(1.0), "u": u, "v": v, "q": u * u + v * v}
    sums = [F.sum(w * p[i] * p[j]).alias(f"{k}{i}{j}") for k, w in weights.items() for i in range(4) for j in range(i, 4)]
    got = ok.agg(*sums, F.count("*").alias("n")).first()
    block = {k: np.array([[got[f"{k}{min(i, j)}{max(i, j)}"] or 0.0 for j in range(4)] for i in range(4)]) for k in weights}
    zero = np.zeros((4, 4))
    system = np.block([[block["1"], zero, -block["u"]], [zero, block["1"], -block["v"]], [-block["u"], -block["v"], block["q"]]])
    # Back to the coordinates as given: rows 1 and 2 are of pixels less their mean, row 3 times `most`.
    moved = np.diag([1 / dev["x"], 1 / dev["y"], 1 / dev["z"], 1.0])
    moved[:3, 3] = [-mean[c] / dev[c] for c in "xyz"]
    pixels = np.array([[1, 0, mean["col"] / most], [0, 1, mean["row"] / most], [0, 0, 1 / most]])
    values, vectors = np.linalg.eigh(system)
    # The least residual of the matrices of norm 1 is the inverse of the longest axis of those of residual 1.
    axis, length, _ = np.linalg.svd(np.kron(pixels, moved.T) @ vectors / np.sqrt(np.maximum(values, 1e-15 * max(values[-1], 1e-9))))
    matrix = axis[:, 0].reshape(3, 4)
    scale = np.linalg.norm(matrix[2, :3]) or 1.0
    matrix = matrix / (scale if matrix[2, 3] >= 0 else -scale)
    return matrix, float(length[0] ** -2 / max(1, got["n"]))
