"""Queries: voxel grids and octrees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cloud import embedding_points, line_points
from ..operators import grid as G
from .registry import EMB, LINE, query, r6, r6s, rounded

_B = "b AS (SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z FROM p)"


def _key(unit: float) -> str:
    return ", ".join(f"floor(({c} - min_{c}) / {unit})::BIGINT AS k{c}" for c in "xyz")


@query(
    f"""{EMB}, {_B}, k AS (SELECT *, {_key(0.1)} FROM p, b),
m AS (SELECT kx, ky, kz, label, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY count(*) DESC, label) AS r FROM k GROUP BY kx, ky, kz, label)
SELECT kx, ky, kz, {', '.join(r6(f'avg({c})', c) for c in ('x', 'y', 'z', 'nx', 'ny', 'nz', 'intensity'))}, any_value(m.label) AS label, count(*) AS n
FROM k JOIN (SELECT * FROM m WHERE r = 1) m USING (kx, ky, kz) GROUP BY kx, ky, kz"""
)
def voxel_grid(spark, sf_dir):
    v = G.voxel_grid(embedding_points(spark, sf_dir), (0.1, 0.1, 0.1))
    return v.select(*G.KEYS, *map(rounded, ("x", "y", "z", "nx", "ny", "nz", "intensity")), "label", "n")


# Means of amounts with few digits fall on rounding ties; a billionth puts both sides on the same one.
@query(f"{LINE}, {_B}, k AS (SELECT *, {_key(5.0)} FROM p, b) SELECT kx, ky, kz, {', '.join(r6(f'avg({c}) + 1e-9', c) for c in 'xyz')}, count(*) AS n FROM k GROUP BY kx, ky, kz")
def voxel_grid_line(spark, sf_dir):
    return G.voxel_grid(line_points(spark, sf_dir), (5.0, 5.0, 5.0)).select(*G.KEYS, *(rounded(F.col(c) + 1e-9, c) for c in "xyz"), "n")


@query(
    f"""{EMB}, {_B}, k AS (SELECT *, floor((x - min_x) / 0.1) AS kx, floor((y - min_y) / 0.1) AS ky FROM p, b),
r AS (SELECT *, row_number() OVER (PARTITION BY kx, ky ORDER BY z, idx) AS r FROM k) SELECT idx, {r6s('x', 'y', 'z')} FROM r WHERE r = 1"""
)
def grid_minimum_z(spark, sf_dir):
    return G.grid_minimum_z(embedding_points(spark, sf_dir), (0.1, 0.1)).select("idx", *map(rounded, "xyz"))


@query(
    f"""{EMB}, {_B}, k AS (SELECT *, {_key(0.1)} FROM p, b),
d AS (SELECT *, {' + '.join(f'({c} - (min_{c} + k{c} * 0.1)) * ({c} - (min_{c} + k{c} * 0.1))' for c in 'xyz')} AS d FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY d, idx) AS r FROM d) SELECT idx, {r6s('x', 'y', 'z')} FROM r WHERE r = 1"""
)
def uniform_sampling(spark, sf_dir):
    return G.uniform_sampling(embedding_points(spark, sf_dir), (0.1, 0.1, 0.1)).select("idx", *map(rounded, "xyz"))


@query(f"{EMB}, {_B}, k AS (SELECT {_key(0.05)} FROM p, b) SELECT kx, ky, kz, count(*) AS n FROM k GROUP BY kx, ky, kz")
def octree_count(spark, sf_dir):
    return G.octree_leaves(embedding_points(spark, sf_dir), 0.05)


@query(
    f"""{EMB}, {_B}, k AS (SELECT x, y, z, {_key(0.05)} FROM p, b), u AS (SELECT x, y, z, l::INTEGER AS level, kx >> l AS kx, ky >> l AS ky, kz >> l AS kz FROM k, (SELECT unnest([0, 1, 2, 3]) AS l))
SELECT level, kx, ky, kz, {', '.join(r6(f'avg({c})', c) for c in 'xyz')}, count(*) AS n FROM u GROUP BY level, kx, ky, kz"""
)
def octree_centroid_levels(spark, sf_dir):
    return G.octree_centroids(embedding_points(spark, sf_dir), 0.05, 3).select("level", *G.KEYS, *map(rounded, "xyz"), "n")


@query(
    f"""{EMB}, {_B}, v AS (SELECT DISTINCT {_key(0.1)} FROM p, b)
SELECT a.kx AS a_kx, a.ky AS a_ky, a.kz AS a_kz, b.kx AS b_kx, b.ky AS b_ky, b.kz AS b_kz,
  {r6('0.1 * sqrt(((a.kx - b.kx) * (a.kx - b.kx) + (a.ky - b.ky) * (a.ky - b.ky) + (a.kz - b.kz) * (a.kz - b.kz))::DOUBLE)', 'weight')}
FROM v a, v b WHERE abs(a.kx - b.kx) <= 1 AND abs(a.ky - b.ky) <= 1 AND abs(a.kz - b.kz) <= 1 AND (a.kx, a.ky, a.kz) < (b.kx, b.ky, b.kz)"""
)
def octree_adjacency(spark, sf_dir):
    e = G.octree_adjacency(G.octree_leaves(embedding_points(spark, sf_dir), 0.1), 0.1)
    return e.select(*(c for c in e.columns if c != "weight"), rounded("weight"))


_CHILD = "((kx >> {0}) & 1) * 4 + ((ky >> {0}) & 1) * 2 + ((kz >> {0}) & 1)"


@query(
    f"""{EMB}, {_B}, v AS (SELECT DISTINCT {_key(0.1)} FROM p, b), n AS (SELECT {', '.join(f'{_CHILD.format(3 - d)} AS c{d}' for d in range(4))} FROM v),
s AS (SELECT 0 AS level, '' AS path, c0 AS child FROM n UNION ALL SELECT 1, c0::VARCHAR, c1 FROM n UNION ALL SELECT 2, c0 || '' || c1, c2 FROM n UNION ALL SELECT 3, c0 || '' || c1 || '' || c2, c3 FROM n)
SELECT path, level::INTEGER AS level, bit_or((1 << child)::INTEGER) AS occupancy FROM s GROUP BY path, level"""
)
def octree_occupancy_bytes(spark, sf_dir):
    return G.octree_occupancy(G.octree_leaves(embedding_points(spark, sf_dir), 0.1), 4)


_NODES = f"""{EMB}, {_B}, v AS (SELECT DISTINCT {_key(0.1)} FROM p, b), n AS (SELECT {', '.join(f'{_CHILD.format(3 - d)} AS c{d}' for d in range(4))} FROM v),
s AS (SELECT '' AS path, c0 AS child FROM n UNION ALL SELECT c0::VARCHAR, c1 FROM n UNION ALL SELECT c0 || '' || c1, c2 FROM n UNION ALL SELECT c0 || '' || c1 || '' || c2, c3 FROM n),
o AS (SELECT path, bit_or((1 << child)::INTEGER) AS mask, row_number() OVER (ORDER BY path) - 1 AS pos FROM s GROUP BY path)"""


@query(f"{_NODES} SELECT pos // 16 AS block, min(pos) AS start, string_agg(printf('%02X', mask), '' ORDER BY pos) AS code FROM o GROUP BY ALL")
def octree_bytes(spark, sf_dir):
    """The encoding in blocks of 16 bytes."""
    leaves = G.octree_leaves(embedding_points(spark, sf_dir), 0.1)
    return G.octree_encode(leaves, 4, "n", 16)[0].select("block", "start", F.hex("code").alias("code"))


@query(f"{EMB}, e AS (SELECT greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS extent FROM p) SELECT r AS resolution, greatest(0, ceil(log2(extent / r)))::INTEGER AS depth FROM e, (SELECT unnest([0.01, 0.05, 0.1, 2.0])::DOUBLE AS r)")
def octree_depths(spark, sf_dir):
    """How deep trees of some resolutions are."""
    p = embedding_points(spark, sf_dir)
    sizes = spark.createDataFrame([(0.01,), (0.05,), (0.1,), (2.0,)], "resolution double")
    return sizes.crossJoin(G.octree_extent(p)).select("resolution", G.depth_of(F.col("extent"), F.col("resolution")).alias("depth"))


@query(f"{EMB}, {_B}, k AS (SELECT {_key(0.1)} FROM p, b) SELECT kx, ky, kz, count(*) AS value FROM k GROUP BY ALL")
def octree_decoded(spark, sf_dir):
    """Leaves and their numbers of points, decoded from blocks of 16 bytes."""
    leaves = G.octree_leaves(embedding_points(spark, sf_dir), 0.1)
    return G.octree_decode(*G.octree_encode(leaves, 4, "n", 16), 4)


@query(f"{EMB}, {_B}, k AS (SELECT *, {_key(0.2)} FROM p, b) SELECT idx FROM k WHERE kx = floor((0.05 - min_x) / 0.2) AND ky = floor((0.05 - min_y) / 0.2) AND kz = floor((0.05 - min_z) / 0.2)")
def voxel_search(spark, sf_dir):
    from ..operators.neighbors import voxel_search as search

    return search(embedding_points(spark, sf_dir), (0.05, 0.05, 0.05), 0.2).select(F.col("idx"))


@query(
    f"""{EMB}, {_B}, v AS (SELECT DISTINCT {_key(0.1)} FROM p, b), u AS (SELECT DISTINCT l::INTEGER AS level, kx >> (4 - l) AS kx, ky >> (4 - l) AS ky, kz >> (4 - l) AS kz FROM v, (SELECT unnest([0, 1, 2, 3, 4]) AS l))
SELECT level, kx, ky, kz, {', '.join(r6(f'min_{c} + (k{c} + 0.5) * 0.1 * pow(2.0, 4 - level)', c) for c in 'xyz')}, {r6('0.1 * pow(2.0, 4 - level)', 'side')}, {r6('0.1 * pow(2.0, 4 - level) * sqrt(3.0)', 'diagonal')} FROM u, b"""
)
def octree_geometry(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    v = G.octree_centres(G.octree_leaves(p, 0.1), G.finite_bound(p), 0.1, 4)
    return v.select("level", *G.KEYS, *map(rounded, ("x", "y", "z", "side", "diagonal")))


@query(
    f"""{EMB}, {_B}, k AS (SELECT {_key(0.1)}, min(idx) AS v, max(idx) AS w FROM p, b GROUP BY ALL)
SELECT kx, ky, kz, CASE WHEN (kx + ky) % 2 = 0 THEN w ELSE v END AS value FROM k WHERE (kx + kz) % 3 <> 0"""
)
def octree_map(spark, sf_dir):
    """Smallest ids, of which largest ids replace some and others are removed."""
    key = G.keyed(embedding_points(spark, sf_dir), (0.1, 0.1, 0.1)).groupBy(*G.KEYS).agg(F.min("idx").alias("v"), F.max("idx").alias("w"))
    tree = G.Octree(key.select(*G.KEYS, F.col("v").alias("value")), 4)
    tree = tree.insert(key.where("(kx + ky) % 2 = 0").select(*G.KEYS, F.col("w").alias("value")))
    return tree.remove(key.where("(kx + kz) % 3 = 0")).df
