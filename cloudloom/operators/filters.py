"""Filters that look at a point's neighbourhood."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cloud import finite, is_finite, require
from . import blocks
from .neighbors import as_queries, cell_join, knn_search, radius_search


def statistical_outlier_removal(df: DataFrame, k: int, factor: float, negative: bool = False) -> DataFrame:
    """Points whose mean distance to their k nearest (themselves included) is at most mean + factor * population deviation."""
    mean = knn_search(df, k).groupBy("qidx").agg(F.avg("distance").alias("d"))
    limit = F.broadcast(mean.agg((F.avg("d") + factor * F.stddev_pop("d")).alias("limit")))  # one row
    kept = mean.crossJoin(limit).where(F.col("d") > F.col("limit") if negative else F.col("d") <= F.col("limit")).select(F.col("qidx").alias("idx"))
    return df.join(kept, "idx", "left_semi")


def radius_outlier_removal(df: DataFrame, radius: float, least: int, negative: bool = False) -> DataFrame:
    """Points with at least so many points, themselves included, within the radius."""
    n = radius_search(df, radius).groupBy(F.col("qidx").alias("idx")).agg(F.count("*").alias("n"))
    return df.join(n.where(F.col("n") < least if negative else F.col("n") >= least).select("idx"), "idx", "left_semi")


def local_maximum_z(df: DataFrame, radius: float, negative: bool = False) -> DataFrame:
    """Drops each point in whose radius in the xy plane no other point is as high; one without others is dropped too."""
    df_ = finite(df)
    q = df_.select(F.col("idx").alias("qidx"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz"))
    near = cell_join(q, df_.select("idx", "x", "y", "z"), radius, "xy").where((F.col("d2") <= radius * radius) & (F.col("idx") != F.col("qidx")))
    below = near.where(F.col("z") >= F.col("qz")).select(F.col("qidx").alias("idx")).distinct()
    return df_.join(below, "idx", "left_anti" if negative else "left_semi")


def gauss(d: Column, sigma: float) -> Column:
    return F.exp(-(d * d) / (2.0 * sigma * sigma))


def bilateral(df: DataFrame, sigma_d: float, sigma_r: float) -> DataFrame:
    """intensity becomes the mean over 2 * sigma_d, weighted by distance and by difference of intensity; coordinates stay."""
    require(df, "intensity")
    own = df.select(F.col("idx").alias("qidx"), F.col("intensity").alias("qi"))
    near = radius_search(df, 2 * sigma_d, extra=("intensity",)).join(own, "qidx")
    w = gauss(F.col("distance"), sigma_d) * gauss(F.col("intensity") - F.col("qi"), sigma_r)
    new = near.groupBy(F.col("qidx").alias("idx")).agg((F.sum(w * F.col("intensity")) / F.sum(w)).alias("intensity"))
    return df.drop("intensity").join(new, "idx")


def median(df: DataFrame, window: int, most: float) -> DataFrame:
    """z becomes the upper median of the pixel's window, if z is not more than `most` above it; else median + most.

    Windows are cut at the borders.  Missing points neither count nor change.
    """
    require(df, "row", "col")
    half = window // 2

    def around(c: str) -> Column:
        return F.explode(F.sequence(F.col(c) - half, F.col(c) + half)).alias(c)

    # First along rows, then along columns: 2 * window rows are shuffled for a pixel, not window ** 2.
    across = finite(df).select("row", around("col"), "z").groupBy("row", "col").agg(F.collect_list("z").alias("zs"))  # of one window
    down = across.select(around("row"), "col", "zs").groupBy("row", "col").agg(F.array_sort(F.flatten(F.collect_list("zs"))).alias("zs"))  # of one window
    m = down.select("row", "col", F.element_at("zs", F.expr("cast(size(zs) div 2 + 1 as int)")).alias("__m"))
    new = F.when(F.col("__m").isNull() | ~is_finite(), F.col("z")).when(F.col("z") - F.col("__m") <= most, F.col("__m")).otherwise(F.col("__m") + most)
    return df.join(m, ["row", "col"], "left").withColumn("z", new).select(*df.columns)


# --- convolution ----------------------------------------------------------------


def convolve(df: DataFrame, kernel: list[float], along: str = "row", border: str = "default", values: tuple[str, ...] = ("x", "y", "z"), size: int | None = None, fill: float | None = 0.0) -> DataFrame:
    """A flipped kernel of odd length along rows or columns, divided by its sum.

    Outputs whose window leaves the line are borders: `fill` by default; with
    `mirrored` or `repeated` they take the reflected or the nearest inner output,
    for which `size`, the length of a line, is needed where it isn't the same as
    the longest line's.
    """
    require(df, "row", "col")
    half, total = len(kernel) // 2, sum(kernel)
    if len(kernel) % 2 == 0 or total == 0:
        raise ValueError("the kernel needs an odd length and a sum other than 0")
    line, at = ("row", "col") if along == "row" else ("col", "row")
    w = Window.partitionBy(line).orderBy(at)

    def sum_of(c: str) -> Column:
        terms = [F.lag(c, -d).over(w) * float(kernel[half - d]) for d in range(-half, half + 1)]
        out = sum(terms[1:], terms[0]) / float(total)
        return F.coalesce(out, F.lit(fill)) if border == "default" and fill is not None else out

    out = df.select("idx", "row", "col", *(sum_of(c).alias(c) for c in values))
    if border == "default":
        return out
    n = F.count("*").over(Window.partitionBy(line)) if size is None else F.lit(size)
    p = F.col(at)
    if border == "mirrored":
        source = F.when(p < half, 2 * half - 1 - p).when(p >= n - half, 2 * (n - half) - 1 - p).otherwise(p)
    elif border == "repeated":
        source = F.greatest(F.lit(half), F.least(p, n - half - 1))
    else:
        raise ValueError("border is default, mirrored or repeated")
    # The source is at most half + 1 away in the same line: a lookup among the neighbours instead of a join.
    lined = out.withColumn("__s", source - p)
    reach = 2 * half

    def pick(c: str) -> Column:
        column = F.when(F.col("__s") == 0, F.col(c))
        for d in range(-reach, reach + 1):
            if d:
                column = column.when(F.col("__s") == d, F.lag(c, -d).over(w))
        return column

    return lined.select("idx", "row", "col", *(pick(c).alias(c) for c in values))


def convolve_columns(df: DataFrame, kernel: list[float], **more) -> DataFrame:
    return convolve(df, kernel, "col", **more)


def convolve_both(df: DataFrame, rows: list[float], columns: list[float], border: str = "default", values: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Along rows, then along columns."""
    return convolve(convolve(df, rows, "row", border, values), columns, "col", border, values)


def dynamic_convolution(df: DataFrame, radius: float, weight: Column, values: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Weighted means of values over the points within a radius; weight is a column over `distance` and the values."""
    more = tuple(v for v in values if v not in ("x", "y", "z"))
    near = radius_search(df, radius, extra=("x", "y", "z", *more))
    total = F.sum(weight)
    return near.groupBy(F.col("qidx").alias("idx")).agg(*(F.when(total != 0, F.sum(weight * F.col(v)) / total).otherwise(0.0).alias(v) for v in values))


class Accumulator(Protocol):
    """What dynamic_kernel gathers over a neighbourhood; all methods take and give arrays, for many neighbourhoods at once.

    state and result are DDL of named columns.  `group` says which of the `n`
    neighbourhoods each row is of; rows come in no given order.
    """

    state: str
    result: str

    def partial(self, group: np.ndarray, n: int, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The states of n neighbourhoods, each with a row or more: from distance and the values of neighbours."""

    def merge(self, group: np.ndarray, n: int, states: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """One state for each neighbourhood from one or more."""

    def finish(self, states: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The results."""


def dynamic_kernel(df: DataFrame, radius: float, kernel: Accumulator, values: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """idx and the kernel's results over the points within the radius of each, itself included.

    Neighbours are reduced to states where they are found (see blocks), and a
    point's states are merged in its task, so that no step holds a neighbourhood
    and no pair leaves its task.
    """
    more = tuple(v for v in values if v not in ("x", "y", "z"))
    names = T.StructType.fromDDL(kernel.state).names

    def work(q, batches):
        t = blocks.Tiled(q, "qx qy qz", blocks.TILE)
        parts, held = [], 0

        def merged() -> list:
            group = np.concatenate([g for g, _ in parts])
            ids, group = np.unique(group, return_inverse=True)
            return [(ids, kernel.merge(group, len(ids), {k: np.concatenate([s[k] for _, s in parts]) for k in names}))]

        for batch in batches:
            p = blocks.Tiled(batch, "x y z", blocks.POINTS)
            for some, rows, hit, d in blocks.pairs(t, p, radius, float(radius) * float(radius)):
                at = np.flatnonzero(hit)
                if not len(at):
                    continue
                full = np.flatnonzero(hit.any(1))
                group, near = np.searchsorted(full, at // len(rows)), rows[at % len(rows)]
                d = [c.ravel()[at] for c in d]
                seen = {"distance": np.sqrt(blocks.dot(d, d))} | {v: p.columns[v][near] for v in values}
                parts.append((some.start + full, kernel.partial(group, len(full), seen)))
                held += len(full)
            if held > len(t.order) + (1 << 18):
                parts = merged()
                held = len(parts[0][0])
        if parts:
            ids, states = merged()[0]
            yield {"idx": t.columns["qidx"][ids]} | kernel.finish(states)

    return blocks.by_leaf(as_queries(df), finite(df).select("idx", "x", "y", "z", *more), radius, work, f"idx bigint, {kernel.result}")


@dataclass(frozen=True)
class TrimmedMean:
    """The mean of a value without one smallest and one largest; the median of one or two is their mean."""

    value: str
    state: str = "n bigint, total double, low double, high double"
    result: str = "mean double, n bigint"

    def partial(self, group: np.ndarray, n: int, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        v = rows[self.value]
        return self.merge(group, n, {"n": np.ones(len(v), np.int64), "total": v, "low": v, "high": v})

    def merge(self, group: np.ndarray, n: int, states: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        low, high = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(low, group, states["low"])
        np.maximum.at(high, group, states["high"])
        return {"n": np.bincount(group, states["n"], n).astype(np.int64), "total": np.bincount(group, states["total"], n), "low": low, "high": high}

    def finish(self, states: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n, inner = states["n"], states["total"] - states["low"] - states["high"]
        return {"mean": np.where(n > 2, inner / np.maximum(n - 2, 1), states["total"] / n), "n": n}


def gauss_kernel(df: DataFrame, sigma: float, reach: float, squared: bool = False, values: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Means weighted by exp(-d / (2 sigma^2)), or by the square of d, over the radius sigma * reach."""
    d = F.col("distance")
    return dynamic_convolution(df, sigma * reach, F.exp(-(d * d if squared else d) / (2.0 * sigma * sigma)), values)


def gauss_kernel_rgba(df: DataFrame, sigma: float, reach: float, squared: bool = False) -> DataFrame:
    """The same with the weighted mean of each colour channel, cut to integers (a billionth keeps equal values what they are): x, y, z, rgba."""
    from .points import pack_rgba, unpack_rgba

    require(df, "rgba")
    split = df.withColumns({f"__{c}": part.cast("double") for c, part in unpack_rgba(F.col("rgba")).items()})
    out = gauss_kernel(split, sigma, reach, squared, ("x", "y", "z", *(f"__{c}" for c in "bgra")))
    return out.select("idx", "x", "y", "z", pack_rgba(*(F.floor(F.col(f"__{c}") + 1e-9) for c in "bgra")).alias("rgba"))
