"""Neighbourhoods folded where their points meet, so that no pair is shuffled, sorted or stored.

Queries are dealt over the leaves of a split tree, and a leaf's task gets, after
its queries, a copy of each point that its region's cube of the radius reaches.
Points come in batches; both sides are put into small tiles with boxes, and a
tile of queries meets the tiles of points that it may reach in arrays.  A task
holds its queries and their results and one batch of points at a time; a leaf
that has too many queries, as of equal points, is dealt over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..cloud import cross
from .kdtree import LEAF, reached, split_tree, with_leaf

#: Queries in a task at most, about so many tasks at least, and queries in a tile, points in a tile and points in a batch.
QUERIES, TASKS, TILE, POINTS, BATCH = 16_384, 24, 64, 256, 32_768
#: Distances that are compared with the radius are as rounded: tiles count as inside or outside with this margin.
MARGIN = 1e-9


def tiles(at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, edges) of points (n x 3): tile k has order[edges[k]:edges[k + 1]], `most` points or fewer, halved along the widest axis."""
    parts, done = [np.arange(len(at))], []
    while parts:
        some = parts.pop()
        if len(some) <= most:
            done.append(some)
            continue
        p = at[some]
        axis = int((p.max(0) - p.min(0)).argmax())
        half = len(some) // 2
        cut = np.argpartition(p[:, axis], half)
        parts += [some[cut[half:]], some[cut[:half]]]
    return np.concatenate(done), np.concatenate(([0], np.cumsum([len(d) for d in done])))


class Tiled:
    """Columns in order of tiles, which have the boxes lo and hi."""

    def __init__(self, columns: dict[str, np.ndarray], axes: str, most: int):
        at = np.column_stack([columns[a] for a in axes.split()])
        order, self.edges = tiles(at, most)
        self.order, self.columns, self.at = order, {k: v[order] for k, v in columns.items()}, at[order]
        self.lo, self.hi = np.minimum.reduceat(self.at, self.edges[:-1]), np.maximum.reduceat(self.at, self.edges[:-1])

    def __len__(self) -> int:
        return len(self.lo)

    def rows(self, chosen: np.ndarray) -> np.ndarray:
        """The rows of the chosen tiles."""
        sizes = self.edges[chosen + 1] - self.edges[chosen]
        return np.repeat(self.edges[chosen] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())

    def near(self, lo: np.ndarray, hi: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """(tiles that may have a point within the radius of one in the box, tiles that have only such points for all in the box)."""
        gap = np.maximum(0, np.maximum(self.lo - hi, lo - self.hi))
        reach = np.maximum(self.hi - lo, hi - self.lo)
        may = (gap * gap).sum(1) <= (radius * (1 + MARGIN)) ** 2
        return np.flatnonzero(may), np.flatnonzero((reach * reach).sum(1) <= (radius * (1 - MARGIN)) ** 2)


def squares(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(squared distances, offsets p - q by axis) of all queries (rows) and points (columns), summed as in SQL."""
    d = tuple(p[None, :, k] - q[:, k, None] for k in range(3))
    return (d[0] * d[0] + d[1] * d[1]) + d[2] * d[2], d


def dot(a, b) -> np.ndarray:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def across(u) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As linalg's: the cross product with the axis of u's smallest component, the first of equals."""
    least = np.argmin(np.abs(np.stack(u)), axis=0)
    return cross(u, [np.where(least == k, 1.0, 0.0) for k in range(3)])


Work = Callable[[dict[str, np.ndarray], Iterator[dict[str, np.ndarray]]], Iterator[dict[str, np.ndarray]]]


def by_leaf(queries: DataFrame, points: DataFrame, radius: float, work: Work, schema: str, most: int = QUERIES) -> DataFrame:
    """What `work` makes of each leaf's queries (qidx, qx, qy, qz and doubles) and the batches of points (idx, x, y, z and doubles) that may be within the radius of one.

    work gets columns as arrays and yields those of the schema.  Points of a
    batch are more than those within the radius; each comes to a task once.
    """
    from .store import saved

    names = {0: [c for c in queries.columns if c != "qidx"], 1: [c for c in points.columns if c != "idx"]}
    asked = saved(queries.select("qidx", *names[0]))
    at = asked.select(F.col("qidx").alias("idx"), *(F.col(f"q{a}").alias(a) for a in "xyz"))
    n = asked.count()
    tree = split_tree(at, leaf=max(LEAF // 32, min(most // 2, n // TASKS + 1)))
    mine = with_leaf(asked.withColumns({a: F.col(f"q{a}") for a in "xyz"}), tree, "__leaf").drop("x", "y", "z")
    held = np.zeros(tree.leaves, int)
    for leaf, size in mine.groupBy("__leaf").count().collect():  # of 4,096 leaves at most
        held[leaf] = size
    parts = -(-held // most)
    first = np.concatenate(([0], np.cumsum(parts))).astype(int)
    tasks = max(1, int(first[-1]))
    table = F.broadcast(queries.sparkSession.createDataFrame([(first[:-1].tolist(), parts.tolist())], "__first array<int>, __parts array<int>"))  # one row
    width = max(map(len, names.values()))

    def row(df: DataFrame, side: int, task, key: str) -> DataFrame:
        values = [F.col(c).cast("double") for c in names[side]] + [F.lit(0.0)] * (width - len(names[side]))
        return df.select(task.cast("int").alias("__task"), F.lit(side).alias("__side"), F.col(key).cast("long").alias("__id"), *(v.alias(f"__{k}") for k, v in enumerate(values)))

    start, many = F.get("__first", F.col("__leaf")), F.get("__parts", F.col("__leaf"))
    own = row(mine.crossJoin(table), 0, start + F.pmod(F.xxhash64("qidx"), many), "qidx")
    copies = reached(points, tree, radius, "__leaf").crossJoin(table).where(many > 0)
    copies = row(copies.withColumn("__task", F.explode(F.sequence(start, start + many - 1))), 1, F.col("__task"), "idx")
    dealt = own.union(copies).repartitionById(tasks, "__task").sortWithinPartitions("__task", "__side")
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def sides(batches) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for batch in batches:
            key = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else []
            for lo, hi in zip(edges, edges[1:], strict=False):
                yield *divmod(int(key[lo]), 2), batch.slice(lo, hi - lo)

    def arrays(batches: list, side: int) -> dict[str, np.ndarray]:
        table = pa.Table.from_batches(batches)
        key = "idx" if side else "qidx"
        return {key: table.column(2).to_numpy()} | {c: table.column(k + 3).to_numpy() for k, c in enumerate(names[side])}

    def run(batches):
        coming = sides(batches)
        ahead = next(coming, None)
        while ahead is not None:
            task, asked = ahead[0], []
            while ahead is not None and ahead[:2] == (task, 0):
                asked.append(ahead[2])
                ahead = next(coming, None)

            def met():
                nonlocal ahead
                some, size = [], 0
                while ahead is not None and ahead[:2] == (task, 1):  # noqa: B023
                    some.append(ahead[2])
                    size += ahead[2].num_rows
                    ahead = next(coming, None)
                    if size >= BATCH:
                        yield arrays(some, 1)
                        some, size = [], 0
                if some:
                    yield arrays(some, 1)

            points = met()
            for out in work(arrays(asked, 0), points) if asked else ():
                if len(next(iter(out.values()))):
                    yield pa.RecordBatch.from_arrays([as_arrow(out[f.name], f.type) for f in kinds], schema=kinds)
            for _ in points:  # what work had no need of
                pass

    return dealt.mapInArrow(run, schema)


def as_arrow(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An array, or one of lists from two dimensions."""
    if np.ndim(values) < 2:
        return pa.array(values, kind)
    n, m = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m, dtype=np.int32)), pa.array(values.ravel(), kind.value_type)).cast(kind)


def pairs(q: Tiled, p: Tiled, radius: float, square: float, live: np.ndarray | None = None) -> Iterator[tuple[slice, np.ndarray, np.ndarray, tuple]]:
    """(a tile's queries, point rows, whether each is within, offsets) of all tiles of queries (that are live) and the points near them, at most 2,048 at once."""
    for k in range(len(q)):
        some = slice(int(q.edges[k]), int(q.edges[k + 1]))
        if live is not None and not live[some].any():
            continue
        near = p.rows(p.near(q.lo[k], q.hi[k], radius)[0])
        for a in range(0, len(near), 2_048):
            rows = near[a : a + 2_048]
            d2, d = squares(q.at[some], p.at[rows])
            yield some, rows, d2 <= square, d
