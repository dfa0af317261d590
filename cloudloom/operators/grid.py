"""Voxel grids and octrees as grouped keys.

A grid's origin is the smallest finite coordinate: a one-row aggregate, joined
lazily.  Aggregates are partial on each task, so a voxel that holds a third of
all points is one row from each task in the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cloud import finite
from .aggregates import attribute_means, finite_bound
from .store import saved

KEYS = ("kx", "ky", "kz")


def keyed(df: DataFrame, unit: tuple[float, ...], axes: str = "xyz") -> DataFrame:
    """Finite points with k<axis> = floor((p - min) / unit)."""
    bound = F.broadcast(finite_bound(df))  # one row
    key = {f"k{c}": F.floor((F.col(c) - F.col(f"min_{c}")) / float(u)) for c, u in zip(axes, unit, strict=True)}
    return finite(df).crossJoin(bound).withColumns(key)


def voxel_grid(df: DataFrame, unit: tuple[float, float, float]) -> DataFrame:
    """One centroid, with attributes, for each voxel that holds a point: kx, ky, kz, x, y, z, ..., n."""
    return keyed(df, unit).groupBy(*KEYS).agg(*(F.avg(c).alias(c) for c in "xyz"), *attribute_means(df.columns), F.count("*").alias("n"))


def grid_minimum_z(df: DataFrame, unit: tuple[float, float]) -> DataFrame:
    """The lowest point of each cell in the xy plane, the smallest idx of equals; all columns."""
    lowest = F.min_by(F.struct(*df.columns), F.struct("z", "idx")).alias("p")
    return keyed(df, unit, "xy").groupBy("kx", "ky").agg(lowest).select("p.*")


def uniform_sampling(df: DataFrame, unit: tuple[float, float, float]) -> DataFrame:
    """The point of each voxel nearest to the voxel's lower corner, the smallest idx of equals; all columns."""
    away = [F.col(c) - (F.col(f"min_{c}") + F.col(f"k{c}") * float(u)) for c, u in zip("xyz", unit, strict=True)]
    d = sum((a * a for a in away), F.lit(0.0))
    nearest = F.min_by(F.struct(*df.columns), F.struct(d.alias("d"), "idx")).alias("p")
    return keyed(df, unit).groupBy(*KEYS).agg(nearest).select("p.*")


# --- octree -------------------------------------------------------------------


def octree_depth(extent: float, resolution: float) -> int:
    """Levels below the root so that leaves are no larger than the resolution."""
    return max(0, math.ceil(math.log2(extent / resolution))) if extent > 0 else 0


def octree_extent(df: DataFrame) -> DataFrame:
    """One row, to be broadcast: extent, the longest side of the finite points' box."""
    return F.broadcast(finite_bound(df).select(F.greatest(*(F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz")).alias("extent")))


def depth_of(extent: Column, resolution: Column) -> Column:
    """octree_depth() of columns."""
    return F.when(extent > 0, F.greatest(F.lit(0), F.ceil(F.log2(extent / resolution)))).otherwise(0).cast("int")


def octree_side(resolution: float, depth: int, level: int) -> float:
    """The side of a voxel `level` below the root (0: the whole cube) of a tree of some depth."""
    return resolution * 2.0 ** (depth - level)


def octree_diagonal(resolution: float, depth: int, level: int) -> float:
    return octree_side(resolution, depth, level) * math.sqrt(3.0)


def octree_centres(leaves: DataFrame, bound: DataFrame, resolution: float, depth: int) -> DataFrame:
    """level, kx, ky, kz, x, y, z, side, diagonal of each voxel from the root (level 0) down to the leaves; bound has min_x, min_y and min_z.

    A voxel's key is its leaves' key without the lower bits; its centre is half
    a side from its lower corner.
    """
    up = leaves.select(*KEYS, F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    voxels = up.withColumns({k: F.expr(f"shiftright({k}, {depth} - level)") for k in KEYS}).distinct()
    side = F.lit(float(resolution)) * F.pow(F.lit(2.0), F.lit(depth) - F.col("level"))
    centre = {c: F.col(f"min_{c}") + (F.col(f"k{c}") + 0.5) * side for c in "xyz"}
    return voxels.crossJoin(F.broadcast(bound)).select("level", *KEYS, *(v.alias(c) for c, v in centre.items()), side.alias("side"), (side * math.sqrt(3.0)).alias("diagonal"))  # one row


def octree_leaves(df: DataFrame, resolution: float) -> DataFrame:
    """kx, ky, kz and n (points) of each leaf; centre is min + (k + 0.5) * resolution."""
    return keyed(df, (resolution,) * 3).groupBy(*KEYS).agg(F.count("*").alias("n"))


def octree_centroids(df: DataFrame, resolution: float, levels: int) -> DataFrame:
    """level, kx, ky, kz, x, y, z, n for leaves (level 0) and their ancestors up to `levels` above.

    Leaves are aggregated once; upper levels come from the leaves' sums, so the
    points are shuffled no more than once.
    """
    sums = keyed(df, (resolution,) * 3).groupBy(*KEYS).agg(*(F.sum(c).alias(f"s{c}") for c in "xyz"), F.count("*").alias("n"))
    up = sums.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    up = up.withColumns({k: F.expr(f"shiftright({k}, level)") for k in KEYS})
    total = up.groupBy("level", *KEYS).agg(*(F.sum(f"s{c}").alias(f"s{c}") for c in "xyz"), F.sum("n").alias("n"))
    return total.select("level", *KEYS, *((F.col(f"s{c}") / F.col("n")).alias(c) for c in "xyz"), "n")


def octree_adjacency(leaves: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Edges between leaves that touch (26 neighbours): a and b as structs of keys with a < b, and weight, the distance of their centres."""
    v = leaves.select(*KEYS).distinct()
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]
    offset = F.array(*(F.struct(*(F.lit(s).cast("bigint").alias(f"d{c}") for s, c in zip(step, "xyz", strict=True))) for step in steps))
    out = v.select(*(F.col(k).alias(f"a{k}") for k in KEYS), F.explode(offset).alias("o")).select("*", *((F.col(f"a{k}") + F.col(f"o.d{k[1]}")).alias(k) for k in KEYS))
    length = F.sqrt(sum((F.col(f"o.d{c}") * F.col(f"o.d{c}") for c in "xyz"), F.lit(0)).cast("double")) * float(resolution)
    return out.join(v, list(KEYS)).select(*(F.col(f"a{k}").alias(f"a_{k}") for k in KEYS), *(F.col(k).alias(f"b_{k}") for k in KEYS), length.alias("weight"))


def child_bit(level: int = 0) -> Column:
    """Number (0 to 7) of the child, `level` above the leaves, that holds a leaf: x is the highest bit."""
    bit = [F.shiftright(F.col(k), level).bitwiseAND(F.lit(1).cast("bigint")) for k in KEYS]
    return bit[0] * 4 + bit[1] * 2 + bit[2]


def octree_occupancy(leaves: DataFrame, depth: int) -> DataFrame:
    """path, level, occupancy: for each inner node the byte of its children, in depth-first order of (path, level).

    path is the chain of child numbers from the root as a string of digits, so
    ordering by it is the pre-order of the tree.
    """
    leaves = leaves.select(*KEYS).distinct()
    digits = [child_bit(depth - 1 - d).cast("string") for d in range(depth)]
    marked = leaves.select(F.explode(F.array(*(F.struct(F.lit(d).alias("level"), F.concat(F.lit(""), *digits[:d]).alias("path"), digits[d].cast("int").alias("child")) for d in range(depth)))).alias("s"))
    return marked.groupBy("s.path", "s.level").agg(F.bit_or(F.expr("shiftleft(1, s.child)")).alias("occupancy"))


#: Bytes of a block of an encoded octree.
BLOCK = 1 << 16


def _path(depth: int) -> Column:
    return F.concat(F.lit(""), *(child_bit(depth - 1 - d).cast("string") for d in range(depth)))


def _before(nodes: DataFrame, weight: Column) -> DataFrame:
    """path, before: what comes earlier among a node's siblings, by the weights in and below them.

    Each node counts for itself and all above it; the sums are made where the
    nodes are, so a root is one row from each task.
    """
    up = F.explode(F.sequence(F.lit(0), F.length("path")))
    total = nodes.select("path", weight.alias("w"), up.alias("n")).groupBy(F.expr("substring(path, 1, n)").alias("path")).agg(F.sum("w").alias("w"))
    siblings = Window.partitionBy(F.expr("if(path = '', null, substring(path, 1, length(path) - 1))")).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # of 8 rows at most
    return total.select("path", F.coalesce(F.sum("w").over(siblings), F.lit(0)).alias("before"))


def _numbered(nodes: DataFrame, before: DataFrame) -> DataFrame:
    """The nodes with `at`: what comes before them in all of the tree, without the nodes above them."""
    up = nodes.select(F.col("path").alias("node"), F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n")).select("node", F.expr("substring(node, 1, n)").alias("path"))
    return nodes.join(up.join(before, "path").groupBy(F.col("node").alias("path")).agg(F.sum("before").alias("at")), "path")


def octree_encode(leaves: DataFrame, depth: int, value: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks, values) of an octree of a depth of 1 or more, with distinct leaves kx, ky, kz.

    values: position of a leaf in depth-first order, and its value.  blocks: block,
    start (the offset of its first byte), code (the bytes of up to `block` inner nodes
    in that order, see octree_occupancy), and the state in which reading starts
    there: path, the first node's, masks, the bytes of those above it, and leaf,
    the number of leaves before it.  A node's offset is the number of those above it and
    the sizes of all earlier siblings' subtrees, its own and theirs above it; so
    offsets need no order over the whole tree.  Code blocks one after the other are the encoding.
    """
    nodes = saved(octree_occupancy(leaves, depth))
    leaf = leaves.select(_path(depth).alias("path"), F.col(value).alias("value"))
    shape = F.lit(1).cast("bigint")
    at = saved(_numbered(nodes, _before(nodes, shape)).select("path", "level", "occupancy", (F.col("at") + F.col("level")).alias("offset")))
    fruit = saved(_before(leaf.select("path"), shape))
    values = _numbered(leaf, fruit).select(F.col("at").alias("position"), "value")
    of = at.withColumn("block", F.expr(f"offset div {int(block)}"))
    code = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "occupancy"))), lambda s: F.lpad(F.hex(s["occupancy"]), 2, "0")), ""))  # of a block
    blocks = of.groupBy("block").agg(F.min("offset").alias("start"), F.min_by("path", "offset").alias("path"), code.alias("code"))
    first = blocks.select("block", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
    above = first.where("n < length(path)").select("block", F.expr("substring(path, 1, n)").alias("path")).join(at, "path").groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "occupancy"))), lambda s: s["occupancy"]).alias("masks"))  # of the depth
    seen = first.select("block", F.expr("substring(path, 1, n)").alias("path")).join(fruit, "path").groupBy("block").agg(F.sum("before").alias("leaf"))
    return blocks.join(above, "block", "left").join(seen, "block").select("block", "start", "path", F.coalesce("masks", F.expr("cast(array() as array<int>)")).alias("masks"), "leaf", "code"), values


def read_block(code: bytes, path: str, masks: list[int], depth: int) -> Iterator[tuple[int, int, int]]:
    """kx, ky, kz of the leaves below the nodes of a block, in order."""
    x = y = z = 0
    stack = []  # for each node above the current one, which children come after
    for digit, mask in zip(map(int, path), masks, strict=True):
        stack.append(mask >> digit + 1 << digit + 1)
        x, y, z = x * 2 + (digit >> 2), y * 2 + (digit >> 1 & 1), z * 2 + (digit & 1)
    for mask in code:
        if len(stack) == depth - 1:
            for child in range(8):
                if mask >> child & 1:
                    yield x * 2 + (child >> 2), y * 2 + (child >> 1 & 1), z * 2 + (child & 1)
            mask = 0
        stack.append(mask)
        while stack and not stack[-1]:
            stack.pop()
            if stack:
                x, y, z = x >> 1, y >> 1, z >> 1
        if not stack:
            return
        child = (stack[-1] & -stack[-1]).bit_length() - 1
        stack[-1] &= stack[-1] - 1
        x, y, z = x * 2 + (child >> 2), y * 2 + (child >> 1 & 1), z * 2 + (child & 1)


def octree_decode(blocks: DataFrame, values: DataFrame, depth: int) -> DataFrame:
    """kx, ky, kz, value of the leaves; each block is read by itself, from the state that it starts in."""

    def run(batches):
        for batch in batches:
            for path, masks, leaf, code in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                keys = np.array(list(read_block(code, path, masks, depth)), np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(keys[:, k])) for k in range(3)), pa.array(leaf + np.arange(len(keys)))], names=[*KEYS, "position"])

    found = blocks.select("path", "masks", "leaf", "code").mapInArrow(run, "kx bigint, ky bigint, kz bigint, position bigint")
    return found.join(values, "position").select(*KEYS, "value")


class Octree:
    """A map from three integer keys to a value, kept as a DataFrame (kx, ky, kz, value) with one row for each key."""

    def __init__(self, df: DataFrame, depth: int):
        self.df, self.depth = df, depth

    @property
    def max_key(self) -> int:
        return (1 << self.depth) - 1

    def get(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.df, list(KEYS))

    def insert(self, rows: DataFrame) -> Octree:
        """New values replace old ones; of repeated keys in rows the largest value holds."""
        new = rows.groupBy(*KEYS).agg(F.max("value").alias("value"))
        return Octree(self.df.join(new, list(KEYS), "left_anti").select(*KEYS, "value").union(new), self.depth)

    def remove(self, keys: DataFrame) -> Octree:
        return Octree(self.df.join(keys.select(*KEYS), list(KEYS), "left_anti"), self.depth)
