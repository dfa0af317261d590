"""Queries: transforms, crops, aggregates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..cloud import Cloud, embedding_points, event_grid, with_grid
from ..operators import aggregates as A
from ..operators import points as P
from .registry import EMB, EVT, query, r6, r6s, rounded

LOW, HIGH = (-0.1, -0.12, -0.15), (0.15, 0.1, 0.12)
TURN = P.rotation((0, 0, 1), math.pi / 6)
POSE = [[*TURN[0], 0.1], [*TURN[1], -0.2], [*TURN[2], 0.3]]
XYZ = "x BETWEEN -0.1 AND 0.15 AND y BETWEEN -0.12 AND 0.1 AND z BETWEEN -0.15 AND 0.12"
PTS = "idx, x, y, z"


def _dot(m, v=("x", "y", "z")) -> str:
    return " + ".join(f"{a!r} * {b}" for a, b in zip(m, v, strict=True))


@query(f"{EMB} SELECT {PTS} FROM p WHERE {XYZ}")
def crop_box(spark, sf_dir):
    return P.crop_box(embedding_points(spark, sf_dir), LOW, HIGH).select("idx", "x", "y", "z")


@query(f"{EMB} SELECT {PTS} FROM p WHERE NOT ({XYZ})")
def crop_box_negative(spark, sf_dir):
    return P.crop_box(embedding_points(spark, sf_dir), LOW, HIGH, negative=True).select("idx", "x", "y", "z")


_C = [(a + b) / 2 for a, b in zip(LOW, HIGH, strict=True)]
_BACK = [f"({_dot([row[k] for row in TURN], [f'({c} - {m!r})' for c, m in zip('xyz', _C, strict=True)])} + {_C[k]!r}) BETWEEN {LOW[k]} AND {HIGH[k]}" for k in range(3)]


@query(f"{EMB} SELECT {PTS} FROM p WHERE {' AND '.join(_BACK)}")
def crop_box_rotated(spark, sf_dir):
    return P.crop_box(embedding_points(spark, sf_dir), LOW, HIGH, TURN).select("idx", "x", "y", "z")


@query(f"{EMB} SELECT {PTS} FROM p WHERE (x - 0.02) * 1.0 + (y + 0.01) * -0.5 + (z - 0.03) * 2.0 >= 0")
def crop_plane(spark, sf_dir):
    return P.crop_plane(embedding_points(spark, sf_dir), (0.02, -0.01, 0.03), (1.0, -0.5, 2.0)).select("idx", "x", "y", "z")


_W, _H = math.tan(0.7), math.tan(0.6)


@query(f"{EMB} SELECT {PTS} FROM p WHERE x >= 0.05 AND x <= 0.3 AND y <= {_W!r} * x AND y >= -{_W!r} * x AND z <= {_H!r} * x AND z >= -{_H!r} * x * 0.5")
def frustum_culling(spark, sf_dir):
    return P.frustum_culling(embedding_points(spark, sf_dir), 0.05, 0.3, 0.7, 0.6, (-1, 1, -0.5, 1)).select("idx", "x", "y", "z")


@query(f"{EMB} SELECT {PTS} FROM p WHERE abs(x * nx + y * ny + z * nz) >= 0.08")
def shadow_points(spark, sf_dir):
    return P.shadow_points(embedding_points(spark, sf_dir), 0.08).select("idx", "x", "y", "z")


@query(f"{EMB} SELECT idx, {', '.join(r6(_dot(m[:3]) + f' + {m[3]!r}', c) for m, c in zip(POSE, 'xyz', strict=True))} FROM p")
def transform_se3(spark, sf_dir):
    return P.transform(embedding_points(spark, sf_dir), POSE).select("idx", *map(rounded, "xyz"))


@query(f"{EMB} SELECT idx, {', '.join(r6(_dot(m[:3], ('nx', 'ny', 'nz')), c) for m, c in zip(POSE, ('nx', 'ny', 'nz'), strict=True))} FROM p")
def transform_normal(spark, sf_dir):
    return P.transform_normals(embedding_points(spark, sf_dir), POSE).select("idx", *map(rounded, ("nx", "ny", "nz")))


@query(f"{EMB} SELECT idx, {', '.join(r6(f'{c} - (SELECT avg({c}) FROM p)', c) for c in 'xyz')} FROM p")
def demean(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    return P.demean(p, A.centroid(p)).select("idx", *map(rounded, "xyz"))


@query(f"{EMB} SELECT idx FROM p WHERE {XYZ}")
def box_select(spark, sf_dir):
    return P.box_select(embedding_points(spark, sf_dir), LOW, HIGH).select("idx")


@query(f"{EMB} SELECT {r6s('min_x', 'min_y', 'min_z', 'max_x', 'max_y', 'max_z')} FROM (SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM p)")
def finite_bound(spark, sf_dir):
    b = A.finite_bound(embedding_points(spark, sf_dir))
    return b.select(*map(rounded, b.columns))


@query(f"{EMB}, d AS (SELECT *, (x - 0.1) * (x - 0.1) + (y + 0.05) * (y + 0.05) + z * z AS d FROM p) SELECT idx, {r6s('x', 'y', 'z')}, {r6('sqrt(d)', 'distance')} FROM d ORDER BY d.d DESC, idx LIMIT 1")
def max_distance(spark, sf_dir):
    return A.max_distance(embedding_points(spark, sf_dir), (0.1, -0.05, 0.0)).select("idx", *map(rounded, ("x", "y", "z", "distance")))


@query(f"{EMB} SELECT {', '.join(r6(f'avg({c})', c) for c in 'xyz')}, count(*) AS n FROM p")
def centroid_coords(spark, sf_dir):
    return A.centroid(embedding_points(spark, sf_dir)).select(*map(rounded, "xyz"), "n")


RGBA = "((idx * 37) % 256) + ((idx * 91) % 256) * 256 + ((idx * 53) % 256) * 65536 + 255 * 16777216::BIGINT"


def _coloured(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    i = F.col("idx")
    return p.withColumn("rgba", P.pack_rgba((i * 37) % 256, (i * 91) % 256, (i * 53) % 256, F.lit(255)))


@query(
    f"""{EMB}, m AS (SELECT label FROM p GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
SELECT {', '.join(r6(f'avg({c})', c) for c in ('x', 'y', 'z', 'nx', 'ny', 'nz', 'intensity'))}, (SELECT label FROM m) AS label,
  floor(avg((idx * 37) % 256))::BIGINT + floor(avg((idx * 91) % 256))::BIGINT * 256 + floor(avg((idx * 53) % 256))::BIGINT * 65536 + 255::BIGINT * 16777216 AS rgba, count(*) AS n FROM p"""
)
def centroid_attributes(spark, sf_dir):
    c = A.centroid_attributes(_coloured(spark, sf_dir))
    return c.select(*map(rounded, ("x", "y", "z", "nx", "ny", "nz", "intensity")), "label", "rgba", "n")


_PAIRS = ("xx", "xy", "xz", "yy", "yz", "zz")


@query(f"{EMB}, c AS (SELECT avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM p) SELECT {', '.join(r6(f'sum(({k[0]} - m{k[0]}) * ({k[1]} - m{k[1]}))', f'c{k}') for k in _PAIRS)}, count(*) AS n FROM p, c")
def cov_matrix(spark, sf_dir):
    return A.cov_matrix(embedding_points(spark, sf_dir)).select(*(rounded(f"c{k}") for k in _PAIRS), "n")


@query(f"{EMB} SELECT {', '.join(r6(f'avg(({k[0]} - 0.01) * ({k[1]} - 0.01))', f'c{k}') for k in _PAIRS)}, count(*) AS n FROM p")
def cov_matrix_norm(spark, sf_dir):
    centre = spark.createDataFrame([(0.01, 0.01, 0.01)], "x double, y double, z double")
    return A.cov_matrix_norm(embedding_points(spark, sf_dir), centre).select(*(rounded(f"c{k}") for k in _PAIRS), "n")


@query(f"{EMB} SELECT {', '.join(r6(f'avg({c})', c) for c in 'xyz')}, {', '.join(r6(f'covar_pop({k[0]}, {k[1]})', f'c{k}') for k in _PAIRS)}, count(*) AS n FROM p")
def centroid_and_cov(spark, sf_dir):
    return A.centroid_and_cov(embedding_points(spark, sf_dir)).select(*map(rounded, "xyz"), *(rounded(f"c{k}") for k in _PAIRS), "n")


@query(f"{EMB} SELECT {', '.join(r6(f'avg({c})', v) for c, v in zip(('nx', 'ny', 'nz'), ('vx', 'vy', 'vz'), strict=True))}, count(*) AS n FROM p")
def viewpoint_center(spark, sf_dir):
    p = embedding_points(spark, sf_dir).withColumnsRenamed({"nx": "vx", "ny": "vy", "nz": "vz"})
    return A.viewpoint_center(p).select(*map(rounded, ("vx", "vy", "vz")), "n")


@query(f"""{EVT}, h AS (SELECT max("row") + 1 AS height FROM p) SELECT col * height + "row" AS idx, col AS "row", "row" AS col, z FROM p, h""")
def transpose_grid(spark, sf_dir):
    p = event_grid(spark, sf_dir)
    height = (p.agg(F.max("row")).first()[0] or 0) + 1
    return P.transpose(p, height).select("idx", "row", "col", "z")


@query(f"""{EVT} SELECT idx, idx // 50 AS "row", idx % 50 AS col, z FROM p""")
def reinterpret_grid(spark, sf_dir):
    return with_grid(event_grid(spark, sf_dir), 50).select("idx", "row", "col", "z")


@query(f"{EMB} SELECT idx, {r6('x * nx', 'v')} FROM p")
def zip_map(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    return P.zip_map(p.select("idx", "x"), p.select("idx", "nx"), v=lambda a, b: a("x") * b("nx")).select("idx", rounded("v"))


@query(f"{EMB} SELECT idx, x > 0 AND y > 0 AS kept FROM p")
def predicate_filter(spark, sf_dir):
    kept, removed = P.split(embedding_points(spark, sf_dir), (F.col("x") > 0) & (F.col("y") > 0))
    return kept.select("idx", F.lit(True).alias("kept")).union(removed.select("idx", F.lit(False).alias("kept")))


@query(f"{EMB} SELECT i AS pos, idx, {r6s('x', 'y', 'z')} FROM p JOIN (SELECT i, (i * 7) % 50 AS idx FROM range(100) t(i)) USING (idx)")
def index_filter(spark, sf_dir):
    order = spark.range(100).select(F.col("id").alias("pos"), ((F.col("id") * 7) % 50).alias("idx"))
    return P.take(embedding_points(spark, sf_dir), order).select("pos", "idx", *map(rounded, "xyz"))


@query()
def random_sample(spark, sf_dir):
    return P.random_sample(embedding_points(spark, sf_dir), 100, 42)[0].select("idx", "x", "y", "z")


@query(f"SELECT idx, v & 255 AS b, (v >> 8) & 255 AS g, (v >> 16) & 255 AS r, (v >> 24) & 255 AS a FROM (SELECT vec_id AS idx, {RGBA.replace('idx', 'vec_id')} AS v FROM embeddings)")
def rgba_unpack(spark, sf_dir):
    return _coloured(spark, sf_dir).select("idx", *(c.alias(k) for k, c in P.unpack_rgba(F.col("rgba")).items()))


@query()
def projection_matrix(spark, sf_dir):
    """One row for each entry of the camera matrix of the event grid, whose pixels follow from x, y alone."""
    matrix, residual = A.projection_matrix(event_grid(spark, sf_dir))
    return spark.createDataFrame([(r, c, float(matrix[r, c]), residual) for r in range(3) for c in range(4)], "row int, col int, value double, residual double")


@query(f"{EMB} SELECT idx, {r6('2 * x + 1', 'x')}, {r6('x * y', 'y')} FROM p")
def map_points(spark, sf_dir):
    return P.map_points(embedding_points(spark, sf_dir), x=2 * F.col("x") + 1, y=F.col("x") * F.col("y")).select("idx", *map(rounded, "xy"))


@query(f"{EMB} SELECT idx, {r6s('x', 'y', 'z')} FROM p WHERE label % 3 = 0")
def select_ids(spark, sf_dir):
    """Ids that are given twice select a row once."""
    p = embedding_points(spark, sf_dir)
    ids = p.where("label % 3 = 0").select("idx")
    return P.select_ids(p, ids.union(ids)).select("idx", *map(rounded, "xyz"))


@query(f"""{EVT} SELECT idx, z FROM p WHERE col = 7 AND "row" = 3""")
def grid_at(spark, sf_dir):
    return Cloud(event_grid(spark, sf_dir), 100).at(7, 3).select("idx", "z")
