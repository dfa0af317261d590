"""Nearest neighbours by descent through an octree, as joins.

Cells that hold more than a few points are split in eight.  All occupied cells
are rows, with their number of points and the box that the points fill.  The descent
starts with the root against itself; each step takes a pair (cell of queries,
cell of points) to the pairs of their children, and drops those that are farther
apart than the query cell's bound: the distance within which, whatever the
points' places in their boxes, k points are sure to lie.  The last step does
the same for single queries, and only then are queries and points paired.

Boxes give distances that rounding cannot turn round: each is made by the same
operations, in the same order, as the distance of two points in them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import finite_bound
from .store import saved

#: Halvings of the cube around all points; doubles have no more to give.
DEEPEST = 48
#: Levels that are counted in one pass over the points.
STEP = 6
#: Cells of the uppermost levels that the driver may see.
TOP = 8_192
ENDS = tuple(f"{e}{a}" for a in "xyz" for e in ("lo_", "hi_"))


def key(level: str) -> Column:
    """A cell's key: its level and the first bits of the coordinates in it."""
    return F.expr(f"named_struct('l', cast({level} as int), {', '.join(f"'{a}', shiftright(__{a}, {DEEPEST} - cast({level} as int))" for a in 'xyz')})")


#: The key of the cell that a cell is part of; the root's is its own.
PARENT = "named_struct('l', greatest(cell.l - 1, 0), " + ", ".join(f"'{a}', shiftright(cell.{a}, if(cell.l = 0, 0, 1))" for a in "xyz") + ")"


def tree(points: DataFrame, places: DataFrame, leaf: int) -> tuple[DataFrame, DataFrame, int]:
    """(cells, members, depth) of one octree over points (idx, x, y, z) and places (qx, qy, qz).

    cells: up, the parent's key, cell, n (points), nq (places), the points' box lo_x
    to hi_z and the places' box qlo_x to qhi_z, closed, whether it isn't split.
    members: the points and places with the cell that they end in, asked (whether it
    is a place), idx, x, y, z.  A cell is split while it has more than `leaf` of
    either, so a level's cells are made from those of its parents' points only.
    """
    every = points.select("idx", "x", "y", "z", F.lit(False).alias("asked")).union(places.select(F.lit(None).cast("bigint"), "qx", "qy", "qz", F.lit(True)))
    b = finite_bound(every).withColumn("side", F.greatest(*(F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz")))
    # One row.
    grid = every.crossJoin(F.broadcast(b)).withColumns({f"__{a}": F.when(F.col("side") > 0, F.least(F.floor((F.col(a) - F.col(f"min_{a}")) / F.col("side") * 2.0**DEEPEST), F.lit((1 << DEEPEST) - 1))).otherwise(F.lit(0)) for a in "xyz"})
    left = saved(grid.select("idx", "x", "y", "z", "asked", "__x", "__y", "__z"))
    cells, members, level, top = [], [], 0, -1
    while True:
        levels = list(range(top + 1, min(top + STEP, DEEPEST) + 1))
        each = left.withColumn("cell", F.explode(F.array(*(key(str(n)) for n in levels))))
        point, place = ~F.col("asked"), F.col("asked")
        boxes = [f(F.when(who, F.col(a))).alias(f"{name}{e}_{a}") for name, who in (("", point), ("q", place)) for a in "xyz" for e, f in (("lo", F.min), ("hi", F.max))]
        counted = each.groupBy("cell").agg(F.count_if(point).alias("n"), F.count_if(place).alias("nq"), *boxes)
        counted = counted.withColumn("closed", (F.greatest("n", "nq") <= leaf) | (F.col("cell.l") == DEEPEST))
        counted = saved(counted.withColumn("up", F.expr(PARENT)))
        split = counted.where(~F.col("closed")).select(F.col("cell").alias("up"))
        # Below a closed cell there are none; the first of these levels has only children of split ones.
        cells.append(counted.where(F.col("cell.l") == levels[0]).union(counted.where(F.col("cell.l") > levels[0]).join(split, "up", "left_semi").select(*counted.columns)))
        ends = cells[-1].where("closed").select("cell")
        members.append(each.join(ends, "cell", "left_semi").select("cell", "asked", "idx", "x", "y", "z"))
        deepest = split.agg(F.max("up.l")).first()[0]
        if deepest is None or deepest < levels[-1]:
            level = max(level, -1 if deepest is None else deepest)
            break
        level, top = deepest, levels[-1]
        left = saved(left.withColumn("up", key(str(top))).join(split.where(F.col("up.l") == top), "up", "left_semi").drop("up"))
    out, who = cells[0], members[0]
    for c, m in zip(cells[1:], members[1:], strict=True):
        out, who = out.union(c), who.union(m)
    return saved(out), who, level + 1


def between(query: tuple[str, str], points: tuple[str, str]) -> tuple[Column, Column]:
    """(least, largest) squared distance of two boxes, by the prefixes of their lower and upper corners."""
    least, most = F.lit(0.0), F.lit(0.0)
    for a in "xyz":
        (qlo, qhi), (lo, hi) = ((F.col(e + a) for e in box) for box in (query, points))
        near, far = F.greatest(F.lit(0.0), lo - qhi, qlo - hi), F.greatest(F.abs(hi - qlo), F.abs(qhi - lo))
        least, most = least + near * near, most + far * far
    return least, most


def bounded(pairs: DataFrame, by: list[str], k: int) -> DataFrame:
    """The pairs (of `by` and something with n points between `least` and `most` away) that can hold one of the k nearest, with r2, within which k points are sure to be."""
    sure = F.sum("n").over(Window.partitionBy(*by).orderBy("most").rowsBetween(Window.unboundedPreceding, 0))
    r2 = F.min(F.when(F.col("__sure") >= k, F.col("most"))).over(Window.partitionBy(*by))
    return pairs.withColumn("__sure", sure).withColumn("r2", F.coalesce(r2, F.lit(float("inf")))).where(F.col("least") <= F.col("r2"))


def first_pairs(rows: list, k: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The same descent over the rows of the uppermost levels, in arrays: numbers of the rows that are pairs `levels` steps below the root."""
    number = {r.cell: n for n, r in enumerate(rows)}
    box, n = np.array([[r[f"{q}{e}"] for q in ("", "q") for e in ENDS] for r in rows], float), np.array([r.n for r in rows])
    asked = np.array([r.nq for r in rows]) > 0
    parent = np.array([number[r.up] if r.cell.l else -1 for r in rows])
    by = np.argsort(parent, kind="stable")
    first, count = np.searchsorted(parent[by], np.arange(len(rows))), np.bincount(parent[parent >= 0], minlength=len(rows))

    def below(pairs: np.ndarray, other: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each of `pairs` becomes its children, or stays where it has none; `other` is repeated."""
        many = np.maximum(1, count[pairs])
        at = np.repeat(np.arange(len(pairs)), many)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        down = np.where(count[pairs[at]] > 0, by[np.minimum(first[pairs[at]] + nth, len(by) - 1)], pairs[at])
        return down[who[down]], other[at][who[down]]

    root = np.flatnonzero(parent < 0)
    q = c = root[asked[root] & (n[root] > 0)]
    for _ in range(levels if len(q) else 0):
        q, c = below(q, c, asked)
        c, q = below(c, q, n > 0)
        least, most = np.zeros(len(q)), np.zeros(len(q))
        for a in range(3):
            lo, hi, qlo, qhi = box[c, 2 * a], box[c, 2 * a + 1], box[q, 6 + 2 * a], box[q, 7 + 2 * a]
            near, far = np.maximum(0, np.maximum(lo - qhi, qlo - hi)), np.maximum(np.abs(hi - qlo), np.abs(qhi - lo))
            least, most = least + near * near, most + far * far
        order = np.lexsort((most, q))
        total = np.cumsum(n[c[order]])
        start = np.concatenate(([True], q[order][1:] != q[order][:-1]))
        total -= np.repeat((total - n[c[order]])[start], np.diff(np.append(np.flatnonzero(start), len(q))))
        bound = np.full(len(rows), np.inf)
        np.minimum.at(bound, q[order][total >= k], most[order][total >= k])
        near = least <= bound[q]
        q, c = q[near], c[near]
    return q, c


def cell_pairs(cells: DataFrame, depth: int, k: int) -> DataFrame:
    """q, c: the pairs of unsplit cells, one with places and one with points, of which the latter can hold one of the k nearest of the former.

    The uppermost levels, TOP cells at most, go down on the driver.
    """
    sizes, top = dict(cells.groupBy("cell.l").count().collect()), 0
    while top + 1 in sizes and sum(sizes[x] for x in range(top + 2)) <= TOP:
        top += 1
    rows = cells.where(F.col("cell.l") <= top).collect()
    if not rows:
        return cells.select(F.col("cell").alias("q"), F.col("cell").alias("c"))
    steps = top if top + 1 in sizes else depth
    at = np.array([tuple(r.cell) for r in rows], np.int64)
    found = np.column_stack([at[i] for i in first_pairs(rows, k, steps)])
    names = [f"{e}{f}" for e in "qc" for f in "lxyz"]
    flat = cells.sparkSession.createDataFrame(pa.table([pa.array(np.ascontiguousarray(found[:, i])) for i in range(8)], names=names))
    pairs = flat.select(*(F.struct(F.col(f"{e}l").cast("int").alias("l"), *(F.col(f"{e}{a}").alias(a) for a in "xyz")).alias(e) for e in "qc"))

    part = cells.where("cell.l > 0").withColumn("of", F.col("up")).union(cells.where("closed").withColumn("of", F.col("cell")))
    asked = part.where("nq > 0").select(F.col("of").alias("q"), F.col("cell").alias("q2"), *(f"q{e}" for e in ENDS))
    given = part.where("n > 0").select(F.col("of").alias("c"), F.col("cell").alias("c2"), "n", *ENDS)
    least, most = between(("qlo_", "qhi_"), ("lo_", "hi_"))
    for n in range(steps, depth):
        both = pairs.join(asked, "q").join(given, "c").select("q2", "c2", "n", least.alias("least"), most.alias("most"))
        pairs = bounded(both, ["q2"], k).select(F.col("q2").alias("q"), F.col("c2").alias("c"))
        pairs = saved(pairs) if (n - steps) % 2 or n == depth - 1 else pairs
    return pairs


def candidates(points: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """qx, qy, qz, idx, d2: for each place all points that are as near as the k-th nearest, and some more.

    points: idx, x, y, z; places: distinct qx, qy, qz.
    """
    cells, members, depth = tree(points, places, k)
    pairs = cell_pairs(cells, depth, k)
    asked = members.where("asked").select(F.col("cell").alias("q"), *(F.col(a).alias(f"q{a}") for a in "xyz"))
    least, most = between(("q", "q"), ("lo_", "hi_"))
    boxes = cells.where("closed and n > 0").select(F.col("cell").alias("c"), "n", *ENDS)
    near = asked.join(pairs.join(boxes, "c"), "q").select("qx", "qy", "qz", "c", "n", least.alias("least"), most.alias("most"))
    held = members.where("not asked").select(F.col("cell").alias("c"), "idx", "x", "y", "z")
    d2 = sum(((F.col(a) - F.col(f"q{a}")) * (F.col(a) - F.col(f"q{a}")) for a in "xyz"), F.lit(0.0))
    return bounded(near, ["qx", "qy", "qz"], k).join(held, "c").withColumn("d2", d2).where(F.col("d2") <= F.col("r2")).select("qx", "qy", "qz", "idx", "d2")
