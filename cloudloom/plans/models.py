"""Queries: geometric models, consensus and range images."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..cloud import embedding_points, event_grid
from ..operators import models as M
from ..operators import range_image as R
from ..operators import sac as S
from ..operators.points import box_select
from ..operators.store import saved
from .registry import EMB, EVT, ORACLE_SQL, least_axis, query, r6, rounded

PLANE = M.Plane((0.02, -0.01, 0.03), (0.0, 3.0, 4.0))
LINE = M.Line((0.05, 0.0, -0.02), (1.0, 2.0, 2.0))
STICK = M.Stick((-0.1, 0.0, 0.02), (0.2, 0.1, 0.0))
CIRCLE = M.Circle((0.02, 0.01, 0.0), (0.0, 0.0, 2.0), 0.1)
SPHERE = M.Sphere((0.01, 0.02, -0.03), 0.15)
CYLINDER = M.Cylinder(CIRCLE, 0.2)
CONE = M.Cone(CIRCLE, 0.2)


def _distances(spark, sf_dir, model):
    return embedding_points(spark, sf_dir).select("idx", rounded(model.distance(M.xyz()), "distance"))


@query(f"{EMB} SELECT idx, {r6('abs((y + 0.01) * 0.6 + (z - 0.03) * 0.8)', 'distance')} FROM p")
def plane_distance(spark, sf_dir):
    return _distances(spark, sf_dir, PLANE)


@query(f"{EMB}, t AS (SELECT idx, x - 0.05 AS a, y AS b, z + 0.02 AS c, ((x - 0.05) + 2 * y + 2 * (z + 0.02)) / 9 AS t FROM p) SELECT idx, {r6('sqrt((a - t) * (a - t) + (b - 2 * t) * (b - 2 * t) + (c - 2 * t) * (c - 2 * t))', 'distance')} FROM t")
def line_distance(spark, sf_dir):
    return _distances(spark, sf_dir, LINE)


@query(f"{EMB}, t AS (SELECT idx, x + 0.1 AS a, y AS b, z - 0.02 AS c, greatest(0, least(1, (0.2 * (x + 0.1) + 0.1 * y) / 0.05)) AS t FROM p) SELECT idx, {r6('sqrt((a - 0.2 * t) * (a - 0.2 * t) + (b - 0.1 * t) * (b - 0.1 * t) + c * c)', 'distance')} FROM t")
def stick_distance(spark, sf_dir):
    return _distances(spark, sf_dir, STICK)


_RHO = f"{EMB}, t AS (SELECT idx, z, sqrt((x - 0.02) * (x - 0.02) + (y - 0.01) * (y - 0.01)) AS rho FROM p)"
_DISC = "CASE WHEN rho <= 0.1 THEN abs({z}) ELSE sqrt((rho - 0.1) * (rho - 0.1) + ({z}) * ({z})) END"


@query(f"{_RHO} SELECT idx, {r6(_DISC.format(z='z'), 'distance')} FROM t")
def circle_distance(spark, sf_dir):
    return _distances(spark, sf_dir, CIRCLE)


@query(f"{EMB} SELECT idx, {r6('abs(sqrt((x - 0.01) * (x - 0.01) + (y - 0.02) * (y - 0.02) + (z + 0.03) * (z + 0.03)) - 0.15)', 'distance')} FROM p")
def sphere_distance(spark, sf_dir):
    return _distances(spark, sf_dir, SPHERE)


@query(f"{_RHO} SELECT idx, {r6('least(' + _DISC.format(z='z') + ', ' + _DISC.format(z='z - 0.2') + ', sqrt((rho - 0.1) * (rho - 0.1) + (z - greatest(0, least(0.2, z))) * (z - greatest(0, least(0.2, z)))))', 'distance')} FROM t")
def cylinder_distance(spark, sf_dir):
    return _distances(spark, sf_dir, CYLINDER)


@query(
    f"""{_RHO}, s AS (SELECT *, greatest(0, least(1, ((rho - 0.1) * -0.1 + z * 0.2) / 0.05)) AS u FROM t)
SELECT idx, {r6('least(' + _DISC.format(z='z') + ', sqrt(rho * rho + (z - 0.2) * (z - 0.2)), sqrt((rho - 0.1 + 0.1 * u) * (rho - 0.1 + 0.1 * u) + (z - 0.2 * u) * (z - 0.2 * u)))', 'distance')} FROM s"""
)
def cone_distance(spark, sf_dir):
    return _distances(spark, sf_dir, CONE)


@query(
    f"""{EMB}, s AS (SELECT *, (y + 0.01) * 0.6 + (z - 0.03) * 0.8 AS s FROM p WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1 AND z BETWEEN -0.1 AND 0.1)
SELECT idx, {r6('x', 'x')}, {r6('y - 0.6 * s', 'y')}, {r6('z - 0.8 * s', 'z')}, {r6('intensity', 'intensity')} FROM s"""
)
def inlier_projection(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    some = box_select(p, (-0.1,) * 3, (0.1,) * 3).select("idx")
    return S.inlier_projection(p, some, PLANE).select("idx", *map(rounded, ("x", "y", "z", "intensity")))


def _projected(spark, sf_dir, model, distance=None):
    """How far the projection moves each point, and how far from the model it leaves it."""
    p = saved(embedding_points(spark, sf_dir).withColumns({f"__{c}": v for c, v in zip("xyz", model.project(M.xyz()), strict=True)}))
    to = tuple(F.col(f"__{c}") for c in "xyz")
    return p.select("idx", rounded(M.length(M.minus(M.xyz(), to)), "moved"), rounded(model.distance(to), "off"))


def _moved(name: str) -> str:
    return ORACLE_SQL[name].replace("AS distance", "AS moved, 0.0::DOUBLE AS off")


@query(_moved("plane_distance"))
def plane_projection(spark, sf_dir):
    return _projected(spark, sf_dir, PLANE)


@query(_moved("line_distance"))
def line_projection(spark, sf_dir):
    return _projected(spark, sf_dir, LINE)


@query(_moved("stick_distance"))
def stick_projection(spark, sf_dir):
    return _projected(spark, sf_dir, STICK)


@query(_moved("circle_distance"))
def circle_projection(spark, sf_dir):
    return _projected(spark, sf_dir, CIRCLE)


@query(_moved("sphere_distance"))
def sphere_projection(spark, sf_dir):
    return _projected(spark, sf_dir, SPHERE)


@query(_moved("cylinder_distance"))
def cylinder_projection(spark, sf_dir):
    return _projected(spark, sf_dir, CYLINDER)


@query(_moved("cone_distance"))
def cone_projection(spark, sf_dir):
    return _projected(spark, sf_dir, CONE)


_FITTED = {k: n for k, n in M.MIN_SAMPLES.items()}


@query(
    "SELECT kind, idx::BIGINT AS idx, 0.0::DOUBLE AS distance FROM (VALUES "
    + ", ".join(f"('{k}', {n})" for k, n in _FITTED.items())
    + ") t(kind, n), range(4) r(idx), (SELECT count(*) AS points FROM embeddings WHERE vec_id < 4) WHERE idx < n AND points = 4"
)
def fitted_models(spark, sf_dir):
    """How far the first points are from the nearest model that is fitted to them: not at all."""
    p = embedding_points(spark, sf_dir).where("idx < 4")
    at = np.array([tuple(r) for r in p.orderBy("idx").select("x", "y", "z").collect()])
    out = None
    for kind, n in _FITTED.items():
        models = M.estimator(kind, (1.0, 2.0, -1.0) if kind in M.CONSTRAINTS else None)(at)
        distances = [m.circumference_distance(M.xyz()) if kind == "circle" else m.distance(M.xyz()) for m in models]
        far = F.least(*distances) if len(distances) > 1 else distances[0]
        part = p.where(F.col("idx") < n).select(F.lit(kind).alias("kind"), "idx", rounded(far, "distance"))
        out = part if out is None else out.union(part)
    return out


def _cross(n: str, a: str, b: str) -> str:
    return f"{a}y * {b}z - {a}z * {b}y AS {n}x, {a}z * {b}x - {a}x * {b}z AS {n}y, {a}x * {b}y - {a}y * {b}x AS {n}z"


def _dot(a: str, b: str) -> str:
    return f"({a}x * {b}x + {a}y * {b}y + {a}z * {b}z)"


def _minus(n: str, a: str, b: str) -> str:
    return ", ".join(f"{a}{c} - {b}{c} AS {n}{c}" for c in "xyz")


_FOURS = f"""{EMB}, four AS (SELECT idx // 4 AS sample, {', '.join(f'max(CASE WHEN idx % 4 = {k} THEN {c} END) AS {n}{c}' for k, n in enumerate('aicd') for c in 'xyz')} FROM p GROUP BY ALL HAVING count(*) = 4),
three AS ({' UNION ALL '.join(f"SELECT sample, {left} AS out, {', '.join(f'{n}{c} AS {m}{c}' for n, m in zip(kept + gone, 'aicd', strict=True) for c in 'xyz')} FROM four" for left, (kept, gone) in enumerate((('icd', 'a'), ('acd', 'i'), ('aid', 'c'), ('aic', 'd'))))}),
sides AS (SELECT *, {_minus('u', 'i', 'a')}, {_minus('v', 'c', 'a')}, {_minus('w', 'd', 'a')} FROM three),
normals AS (SELECT *, {_cross('n', 'u', 'v')}, {_cross('r', 'v', 'w')}, {_cross('s', 'w', 'u')} FROM sides),
turned AS (SELECT *, {_cross('e', 'n', 'u')}, {_cross('f', 'v', 'n')}, {_dot('u', 'u')} AS uu, {_dot('v', 'v')} AS vv, {_dot('w', 'w')} AS ww, {_dot('n', 'n')} AS nn, {_dot('u', 'r')} AS vol FROM normals),
circles AS (SELECT *, {', '.join(f'a{c} + (vv * e{c} + uu * f{c}) / (2 * nn) AS o{c}' for c in 'xyz')} FROM turned),
based AS (SELECT *, {', '.join(f'd{c} - o{c} AS g{c}' for c in 'xyz')}, sqrt((ax - ox) * (ax - ox) + (ay - oy) * (ay - oy) + (az - oz) * (az - oz)) AS radius FROM circles),
above AS (SELECT *, {_dot('g', 'n')} / sqrt(nn) AS up FROM based), flat AS (SELECT *, sqrt(greatest(0, {_dot('g', 'g')} - up * up)) AS side FROM above)"""


def _model(kind: str, k: str, place: str, direction: str, radius: str, height: str, where: str) -> str:
    numbers = [*(f"{place}{c}" for c in "xyz"), *direction.split(", "), radius, height]
    names = ("x", "y", "z", "nx", "ny", "nz", "radius", "height")
    return f"SELECT '{kind}' AS kind, sample, {k} AS k, {', '.join(f'round({v}, 5) + 0 AS {n}' for v, n in zip(numbers, names, strict=True))} FROM flat WHERE {where}"


_NONE, _N = "NULL::DOUBLE", ", ".join(f"n{c} / sqrt(nn)" for c in "xyz")
_UP = ", ".join(f"sign(up) * n{c} / sqrt(nn)" for c in "xyz")
_SPHERE_AT = [f"(a{c} + (uu * r{c} + vv * s{c} + ww * n{c}) / (2 * vol))" for c in "xyz"]


@query(
    _FOURS
    + ", ball AS (SELECT sample, out, ax, ay, az, vol, " + ", ".join(f"{e} AS q{c}" for e, c in zip(_SPHERE_AT, "xyz", strict=True)) + " FROM flat) "
    + " UNION ALL ".join([
        _model("plane", "0", "a", _N, _NONE, _NONE, "out = 3"), _model("line", "0", "a", "ux, uy, uz", _NONE, _NONE, "out = 3"), _model("circle", "0", "o", _N, "radius", _NONE, "out = 3"),
        _model("cylinder", "out", "o", _UP, "radius", "abs(up)", "true"),
        _model("cone", "row_number() OVER (PARTITION BY sample ORDER BY out) - 1", "o", _UP, "radius", "abs(up) * radius / (radius - side)", "side < radius"),
        "SELECT 'sphere', sample, 0, round(qx, 5) + 0, round(qy, 5) + 0, round(qz, 5) + 0, 0.0, 0.0, 0.0, round(sqrt((ax - qx) * (ax - qx) + (ay - qy) * (ay - qy) + (az - qz) * (az - qz)), 5), NULL FROM ball WHERE out = 3",
    ])
)
def fitted_parameters(spark, sf_dir):
    """The planes, lines, circles, spheres, cylinders and cones through each four points."""
    p = embedding_points(spark, sf_dir)
    fours = p.groupBy(F.expr("idx div 4").alias("sample")).agg(F.array_sort(F.collect_list(F.struct("idx", "x", "y", "z"))).alias("points")).where(F.size("points") == 4)  # of four points
    out = None
    for kind in ("plane", "line", "circle", "cylinder", "cone", "sphere"):
        found = M.fit_each(fours, kind).select(F.lit(kind).alias("kind"), "sample", F.col("k").cast("long"), *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("x", "y", "z", "nx", "ny", "nz", "radius", "height")))
        out = found if out is None else out.union(found)
    return out


@query()
def sac_plane(spark, sf_dir):
    return S.consensus(embedding_points(spark, sf_dir), "plane", 0.05)[1]


@query()
def sac_line(spark, sf_dir):
    return S.consensus(embedding_points(spark, sf_dir), "line", 0.1)[1]


@query()
def sac_perpendicular_plane(spark, sf_dir):
    return S.consensus(embedding_points(spark, sf_dir), "perpendicular plane", 0.05, constraint=(0.0, 0.0, 1.0))[1]


@query()
def sac_parallel_plane(spark, sf_dir):
    return S.consensus(embedding_points(spark, sf_dir), "parallel plane", 0.05, constraint=(1.0, 0.0, 0.0))[1]


@query()
def sac_parallel_line(spark, sf_dir):
    return S.consensus(embedding_points(spark, sf_dir), "parallel line", 0.1, constraint=(0.0, 1.0, 0.0))[1]


@query()
def sac_sphere(spark, sf_dir):
    return S.consensus(embedding_points(spark, sf_dir), "sphere", 0.05)[1]


def _planted(spark, sf_dir, kind: str):
    """The points, every second one moved onto a plane or a sphere."""
    p, even = embedding_points(spark, sf_dir), F.col("idx") % 2 == 0
    if kind == "plane":
        return p.withColumn("z", F.when(even, 0.5 * F.col("x") - 0.25 * F.col("y") + 0.1).otherwise(F.col("z")))
    away = F.sqrt((F.col("x") - 0.5) * (F.col("x") - 0.5) + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    on = {"x": 0.5 + (F.col("x") - 0.5) / away, "y": F.col("y") / away, "z": F.col("z") / away}
    return p.withColumns({c: F.when(even, v).otherwise(F.col(c)) for c, v in on.items()})


@query(f"{EMB}, f AS (SELECT idx, x, y, CASE WHEN idx % 2 = 0 THEN 0.5 * x - 0.25 * y + 0.1 ELSE z END AS z FROM p) SELECT idx FROM f WHERE abs(0.5 * x - 0.25 * y + 0.1 - z) / sqrt(1.3125) < 1e-6")
def sac_planted_plane(spark, sf_dir):
    """Consensus finds the plane that half of the points lie on."""
    return S.consensus(_planted(spark, sf_dir, "plane"), "plane", 1e-6)[1].select("idx")


@query(
    f"""{EMB}, r AS (SELECT idx, x, y, z, sqrt((x - 0.5) * (x - 0.5) + y * y + z * z) AS r FROM p),
f AS (SELECT idx, CASE WHEN idx % 2 = 0 THEN 1.0 ELSE r END AS r FROM r) SELECT idx FROM f WHERE abs(r - 1) < 1e-6"""
)
def sac_planted_sphere(spark, sf_dir):
    """And the sphere."""
    return S.consensus(_planted(spark, sf_dir, "sphere"), "sphere", 1e-6)[1].select("idx")


# --- range images -----------------------------------------------------------------

STEP = math.radians(3)
VIEW = R.View((STEP, STEP))
_PIX = f"""{EMB}, r AS (SELECT *, sqrt(x * x + y * y + z * z) AS range FROM p), a AS (SELECT *, asin(greatest(-1, least(1, y / range))) AS up, atan2(x, z) AS turn FROM r WHERE range > 0),
i AS (SELECT idx, x, y, z, nx, ny, nz, range, floor((up + {math.pi / 2!r}) / {STEP!r})::BIGINT AS "row", floor((turn * cos(up) + {math.pi!r}) / {STEP!r})::BIGINT AS col FROM a)"""


@query(
    f"""{_PIX}, m AS (SELECT "row", col, min(range) AS nearest FROM i GROUP BY ALL), s AS (SELECT i.* FROM i JOIN m USING ("row", col) WHERE range <= nearest + 0.05)
SELECT "row", col, {r6('avg(range)', 'range')}, count(*) AS n FROM s GROUP BY "row", col"""
)
def range_image_zbuffer(spark, sf_dir):
    return R.zbuffer(embedding_points(spark, sf_dir), VIEW, 0.05).select("row", "col", rounded("range"), "n")


@query(
    f"""{_PIX}, m AS (SELECT "row", col, min(range) AS range FROM i GROUP BY ALL) SELECT "row" // 4 AS "row", col // 4 AS col, {r6('min(range)', 'range')} FROM m GROUP BY ALL"""
)
def range_image_downsample(spark, sf_dir):
    return R.downsample(R.zbuffer(embedding_points(spark, sf_dir), VIEW), 4).select("row", "col", rounded("range"))


@query(f"""{_PIX}, m AS (SELECT "row", col, min(range) AS range FROM i GROUP BY ALL) SELECT idx, {r6('m.range - i.range', 'diff')} FROM i JOIN m USING ("row", col)""")
def range_difference(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    return R.range_difference(p, R.zbuffer(p, VIEW), VIEW).select("idx", rounded("diff"))


@query(f"""{_PIX}, m AS (SELECT "row", col, min(range) AS range FROM i GROUP BY ALL) SELECT "row" - 20 + 2 AS "row", col - 40 + 2 AS col, {r6('range', 'range')} FROM m WHERE "row" BETWEEN 20 AND 40 AND col BETWEEN 40 AND 80""")
def range_image_crop(spark, sf_dir):
    return R.crop(R.zbuffer(embedding_points(spark, sf_dir), VIEW), (20, 40), (40, 80), 2).select("row", "col", rounded("range"))


@query(
    f"""{EMB}, s AS (SELECT idx, asin(greatest(-1, least(1, (nx * (1 - x) + ny * (2 - y) + nz * (3 - z)) / sqrt((1 - x) * (1 - x) + (2 - y) * (2 - y) + (3 - z) * (3 - z))))) AS a FROM p)
SELECT idx, {r6('a', 'impact_angle')}, {r6(f'1 - a / {math.pi / 2!r}', 'acuteness')} FROM s"""
)
def impact_angle(spark, sf_dir):
    return R.impact_angles(embedding_points(spark, sf_dir), (1.0, 2.0, 3.0)).select("idx", rounded("impact_angle"), rounded("acuteness"))


def event_image(spark, sf_dir):
    """The whole event grid as a range image: its rows share 20 degrees, of one degree each at most; range is 10 + value / 100."""
    p = event_grid(spark, sf_dir).select("idx", "row", "col", (10 + F.col("z") / 100).alias("range"))
    # One row.
    height = F.broadcast(p.agg(F.greatest(F.lit(20), F.max("row") + 1).alias("__rows")))
    view = R.View((math.radians(1), F.lit(math.radians(20)) / F.col("__rows")), (130, 4 * F.col("__rows")))
    return p.crossJoin(height).withColumns(view.point(F.col("row"), F.col("col"), F.col("range"))).drop("__rows")


#: The same in SQL: idx, row, col, range, x, y, z.
_IMAGE = f"""{EVT}, h AS (SELECT greatest(20, max("row") + 1) AS h FROM p),
turned AS (SELECT idx, "row", col, 10 + z / 100 AS range, ("row" + 0.5 + 4 * h) * ({math.radians(20)!r} / h) - {math.pi / 2!r} AS up FROM p, h),
image AS (SELECT idx, "row", col, range, range * sin(((col + 130.5) * {math.radians(1)!r} - {math.pi!r}) / cos(up)) * cos(up) AS x, range * sin(up) AS y, range * cos(((col + 130.5) * {math.radians(1)!r} - {math.pi!r}) / cos(up)) * cos(up) AS z FROM turned)"""
_APART = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def _patch(nearest: int) -> str:
    """CTEs up to `facing`: the least axis of the nearest pixels of each 5 x 5 window, turned to the origin."""
    entries = ("xx", "xy", "xz", "yy", "yz", "zz")
    return f"""{_IMAGE}, w AS (SELECT a.idx, a.x AS qx, a.y AS qy, a.z AS qz, b.x, b.y, b.z, {_APART} AS d2, row_number() OVER (PARTITION BY a.idx ORDER BY {_APART}, b.idx) AS k
  FROM image a JOIN image b ON b."row" BETWEEN a."row" - 2 AND a."row" + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2),
s AS (SELECT idx, qx, qy, qz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, sqrt(max(d2)) AS farthest, {', '.join(f'covar_pop({k[0]}, {k[1]}) AS {k}' for k in entries)} FROM w WHERE k <= {nearest} GROUP BY ALL), {least_axis('s')},
facing AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) * CASE WHEN vx * qx + vy * qy + vz * qz > 0 THEN -1 ELSE 1 END AS size FROM axis)"""


@query(
    f"""{EVT}, i AS (SELECT *, 10 + z / 100 AS range FROM p), s AS (SELECT "row", col, range, lead(range) OVER (PARTITION BY "row" ORDER BY col) AS next FROM i)
SELECT "row", col, next > range AS farther FROM s WHERE next IS NOT NULL AND next <> range"""
)
def pair_impact_side(spark, sf_dir):
    """Whether the next pixel is farther, where the two are not as far: the sign of the angle between them."""
    image = event_image(spark, sf_dir)
    ahead = F.lead("range").over(Window.partitionBy("row").orderBy("col"))
    differ = image.select("row", "col", (ahead != F.col("range")).alias("differ")).where("differ")
    return R.pair_impact_angles(image).join(differ, ["row", "col"]).select("row", "col", (F.col("impact_angle") > 0).alias("farther"))


@query(
    f"""{_IMAGE}, s AS (SELECT a."row", a.col, a.range AS r, b.range AS s, {_APART} AS d2 FROM image a JOIN image b ON b."row" = a."row" AND b.col = a.col + 1),
t AS (SELECT *, least(r, s) AS n, greatest(r, s) AS f FROM s)
SELECT "row", col, {r6('CASE WHEN r > s THEN -1 ELSE 1 END * acos(greatest(0, least(1, (f * f + d2 - n * n) / (2 * sqrt(d2) * f))))', 'impact_angle')} FROM t"""
)
def pair_impact_angles(spark, sf_dir):
    return R.pair_impact_angles(event_image(spark, sf_dir)).select("row", "col", rounded("impact_angle"))


@query(
    f"""{_PIX}, m AS (SELECT "row", col, min(range) AS range, count(*) AS n FROM i GROUP BY ALL),
f AS (SELECT (up + {math.pi / 2!r}) / {STEP!r} - 0.5 AS u, (turn * cos(up) + {math.pi!r}) / {STEP!r} - 0.5 AS v, range FROM a),
s AS (SELECT floor(u)::BIGINT + i AS "row", floor(v)::BIGINT + j AS col, min(range) AS range FROM f, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j) GROUP BY ALL)
SELECT "row", col, {r6('range', 'range')}, n FROM m UNION ALL SELECT "row", col, {r6('range', 'range')}, 0 FROM s ANTI JOIN m USING ("row", col)"""
)
def range_image_splat(spark, sf_dir):
    return R.zbuffer(embedding_points(spark, sf_dir), VIEW, splat=True).select("row", "col", rounded("range"), "n")


@query(
    f"""{_PIX}, m AS (SELECT "row", col, min(range) AS range FROM i GROUP BY ALL), g AS (SELECT r."row", c.col FROM range(60) r("row"), range(120) c(col)),
far AS (SELECT DISTINCT "row", col FROM i WHERE idx % 10 = 0 AND range > 0)
SELECT g."row", g.col, CASE WHEN m.range IS NOT NULL THEN 'seen' WHEN far.col IS NOT NULL THEN 'far' ELSE 'unseen' END AS state
FROM g LEFT JOIN (SELECT * FROM m WHERE col < 60) m ON m."row" = g."row" AND m.col = g.col LEFT JOIN far ON far."row" = g."row" AND far.col = g.col"""
)
def far_ranges(spark, sf_dir):
    """Half of the image is kept; of the other half, pixels of every tenth point are far."""
    p = embedding_points(spark, sf_dir)
    full = R.all_pixels(R.zbuffer(p, VIEW).where("col < 60"), 60, 120)
    out = R.integrate_far_ranges(full, p.where("idx % 10 = 0"), VIEW)
    state = F.when(F.col("range") == float("inf"), "far").when(F.col("range") == float("-inf"), "unseen").otherwise("seen")
    return out.select("row", "col", state.alias("state"))


@query(
    f"""{EVT}, e AS (SELECT a.idx, avg(b.x) AS x, avg(b.y) AS y, avg(b.z) AS z, count(*) AS n FROM p a JOIN p b ON b."row" BETWEEN a."row" AND a."row" + 3 AND b.col - a.col = b."row" - a."row" GROUP BY a.idx)
SELECT idx // 100 AS "row", idx % 100 AS col, {', '.join(r6(f'{c} + 1e-9', c) for c in 'xyz')}, n FROM e"""
)
def centroid_along(spark, sf_dir):
    """Down the diagonal, four pixels at most."""
    found = R.centroid_along(event_grid(spark, sf_dir), (1, 1), 4)
    return found.select("row", "col", *(rounded(F.col(c) + 1e-9, c) for c in "xyz"), "n")


@query(
    f"""{_patch(15)}, u AS (SELECT *, (vx * (mx - qx) + vy * (my - qy) + vz * (mz - qz)) / size / size AS off FROM facing)
SELECT idx, {', '.join(r6(f'v{c} / size', f'n{c}') for c in 'xyz')}, {', '.join(r6(f'q{c} + v{c} * off', f'p{c}') for c in 'xyz')} FROM u"""
)
def normal_within(spark, sf_dir):
    return R.normal_within(event_image(spark, sf_dir), 2, 15).select("idx", *map(rounded, ("nx", "ny", "nz", "px", "py", "pz")))


@query(f"""{EVT}, s AS (SELECT max("row") AS h FROM p) SELECT "row", col, half FROM p, s, (SELECT unnest([0, 1])::INTEGER AS half) WHERE "row" < h AND col < 99""")
def image_triangles(spark, sf_dir):
    return R.triangles(event_image(spark, sf_dir)).select("row", "col", "half")


def _corner(t: str) -> str:
    return f"-0.8 * ({t}.x - k.x) + 0.6 * ({t}.z - k.z) AS {t}0, -({t}.y - k.y) AS {t}1, -(0.6 * ({t}.x - k.x) + 0.8 * ({t}.z - k.z)) AS {t}2"


@query(
    f"""{EVT}, g AS (SELECT idx, "row", col, x, y, z / 100 AS z FROM p),
t AS (SELECT k.idx, {_corner('a')}, {_corner('b')}, {_corner('c')}
  FROM g k JOIN g a ON a."row" BETWEEN k."row" - 2 AND k."row" + 2 AND a.col BETWEEN k.col - 2 AND k.col + 2
  JOIN g b ON b."row" = a."row" + 1 AND b.col = a.col + 1 JOIN g c ON (c."row" = a."row" + 1 AND c.col = a.col) OR (c."row" = a."row" AND c.col = a.col + 1)
  WHERE (a.x - k.x) * (a.x - k.x) + (a.y - k.y) * (a.y - k.y) + (a.z - k.z) * (a.z - k.z) <= 4.5),
s AS (SELECT *, (b0 - a0) * (c1 - a1) - (b1 - a1) * (c0 - a0) AS det FROM t WHERE greatest(abs(a0), abs(b0), abs(c0), abs(a1), abs(b1), abs(c1)) <= 1.5),
m AS (SELECT s.*, i, j, (i + 0.5) / 6 * 3.0 - 1.5 - a0 AS d, (j + 0.5) / 6 * 3.0 - 1.5 - a1 AS w FROM s, range(6) i(i), range(6) j(j) WHERE det <> 0),
o AS (SELECT *, (d * (c1 - a1) - w * (c0 - a0)) / det AS v, ((b0 - a0) * w - (b1 - a1) * d) / det AS r FROM m)
SELECT idx, i, j, {r6('min(a2 + v * (b2 - a2) + r * (c2 - a2))', 'depth')} FROM o WHERE v >= -1e-9 AND r >= -1e-9 AND v + r <= 1 + 1e-9 GROUP BY idx, i, j"""
)
def surface_patches(spark, sf_dir):
    """The surface of the event grid's triangles around each pixel, in cells of half a pixel, seen from the side."""
    p = event_grid(spark, sf_dir).withColumn("z", F.col("z") / 100)
    keys = p.select("idx", "x", "y", "z", F.lit(0.6).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.8).alias("nz"))
    return R.triangle_cells(p, keys, 3.0, 6).select(F.col("qidx").alias("idx"), "i", "j", rounded("depth"))


@query(f"""{_patch(9)} SELECT idx, {', '.join(r6(f'v{c} / size', f'n{c}') for c in 'xyz')}, {r6('greatest(v, 0) / c2', 'curvature')}, {r6('farthest', 'farthest')} FROM facing""")
def surface_info(spark, sf_dir):
    return R.surface_info(event_image(spark, sf_dir), 2, 9).select("idx", *map(rounded, ("nx", "ny", "nz", "curvature", "farthest")))


@query()
def border_traits(spark, sf_dir):
    return R.border(event_image(spark, sf_dir))


@query()
def narf(spark, sf_dir):
    p = embedding_points(spark, sf_dir)
    found = R.narf(p, p, 0.3, 10)
    return found.select("idx", rounded("rotation"), F.transform("descriptor", lambda h: rounded(h)).alias("descriptor"))
