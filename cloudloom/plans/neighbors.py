"""Queries: neighbour search and what builds on it, convolution, features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cloud import embedding_points, event_grid
from ..operators import features as E
from ..operators import filters as L
from ..operators import kdtree as T
from ..operators import neighbors as N
from .points import RGBA
from .registry import EMB, EVT, ORACLE_SQL, least_axis, query, r6, r6s, rounded

_D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


def near(radius: float, columns: str = "") -> str:
    """A CTE n(q, i, d, ...) of all pairs within a radius: a is the query, b the neighbour."""
    return f"n AS (SELECT a.idx AS q, b.idx AS i, sqrt({_D2}) AS d{', ' + columns if columns else ''} FROM p a, p b WHERE {_D2} <= {radius} * {radius})"


@query(f"{EMB}, {near(0.1)} SELECT q AS qidx, i AS idx, {r6('d', 'distance')} FROM n")
def radius_search(spark, sf_dir):
    return N.radius_search(embedding_points(spark, sf_dir), 0.1).select("qidx", "idx", rounded("distance"))


@query(f"{EMB}, r AS (SELECT a.idx AS qidx, b.idx AS idx, {_D2} AS d2, row_number() OVER (PARTITION BY a.idx ORDER BY {_D2}, b.idx) AS rank FROM p a, p b) SELECT qidx, rank::INTEGER AS rank, idx, {r6('sqrt(d2)', 'distance')} FROM r WHERE rank <= 5")
def knn_search(spark, sf_dir):
    return N.knn_search(embedding_points(spark, sf_dir), 5).select("qidx", "rank", "idx", rounded("distance"))


_FAR = ", ".join(f"CASE WHEN idx % 100 = 0 THEN {c} * 1e6 ELSE {c} END AS {c}" for c in "xyz")


@query(
    f"""{EMB}, f AS (SELECT idx, {_FAR} FROM p), c AS (SELECT idx, x + 0.25 AS x, y, z FROM f),
r AS (SELECT a.idx AS qidx, b.idx AS idx, {_D2} AS d2, row_number() OVER (PARTITION BY a.idx ORDER BY {_D2}, b.idx) AS rank FROM c a, f b) SELECT qidx, rank::INTEGER AS rank, idx, {r6('sqrt(d2)', 'distance')} FROM r WHERE rank <= 8"""
)
def octree_knn(spark, sf_dir):
    """The nearest points of places beside them; one point of a hundred is a million times as far away."""
    far = embedding_points(spark, sf_dir).select("idx", *(F.when(F.col("idx") % 100 == 0, F.col(c) * 1e6).otherwise(F.col(c)).alias(c) for c in "xyz"))
    beside = N.as_queries(far).withColumn("qx", F.col("qx") + 0.25)
    return N.knn_search(far, 8, beside).select("qidx", "rank", "idx", rounded("distance"))


@query(f"{EMB} SELECT a.idx AS qidx, b.idx AS idx, {r6(f'sqrt({_D2})', 'distance')} FROM p a, p b WHERE {_D2} <= 0.12 * 0.12")
def kd_radius(spark, sf_dir):
    """A radius search dealt by a split tree with a hundred points in a leaf."""
    p = embedding_points(spark, sf_dir)
    return T.kd_radius(p, 0.12, tree=T.split_tree(p, leaf=100)).select("qidx", "idx", rounded("distance"))


@query(f"""{EVT} SELECT a.idx AS qidx, b.idx AS idx, {r6(f'sqrt({_D2})', 'distance')} FROM p a JOIN p b ON abs(a."row" - b."row") <= 2 AND abs(a.col - b.col) <= 2 WHERE {_D2} <= 400""")
def organized_radius(spark, sf_dir):
    return N.organized_radius(event_grid(spark, sf_dir), 20.0, 2).select("qidx", "idx", rounded("distance"))


@query(f"""{EVT}, g AS (SELECT idx, "row", col, x, y FROM p) SELECT a.idx AS qidx, b.idx AS idx, {r6('sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))', 'distance')} FROM g a JOIN g b ON abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1""")
def radius_search_strict(spark, sf_dir):
    """Pixels nearer than 2, but not those at 2."""
    flat = event_grid(spark, sf_dir).withColumn("z", F.lit(0.0))
    return N.radius_search(flat, 2.0, strict=True).select("qidx", "idx", rounded("distance"))


@query(f"""{EVT} SELECT a.idx AS qidx, b.idx AS idx, {r6(f'sqrt({_D2})', 'distance')} FROM p a JOIN p b ON abs(a."row" - b."row") <= 6 AND abs(a.col - b.col) <= 6 WHERE {_D2} <= 36""")
def organized_search(spark, sf_dir):
    return N.organized_search(event_grid(spark, sf_dir), 6.0, 0.01).select("qidx", "idx", rounded("distance"))


@query(f"""{EVT} SELECT idx, {r6('x', 'col')}, {r6('y', '"row"')} FROM p""")
def organized_projection(spark, sf_dir):
    """Where the fitted projection puts each pixel's point: on the pixel."""
    p = event_grid(spark, sf_dir)
    at = N.organized_fit(p, 0.01).project()
    return p.select("idx", *((F.round(at[c], 2) + F.lit(0.0)).alias(c) for c in ("col", "row")))


@query(f"{EMB}, m AS (SELECT max(idx) + 1 AS n FROM p), u AS (SELECT idx, x, y, z FROM p UNION ALL SELECT idx + n, x + 1, y, z FROM p, m) SELECT a.idx AS qidx, b.idx AS idx, {r6('sqrt(' + _D2 + ')', 'distance')} FROM u a, u b WHERE {_D2} <= 0.08 * 0.08")
def insert_points(spark, sf_dir):
    """A radius search after the same points, moved by 1, were inserted."""
    p = embedding_points(spark, sf_dir).select("idx", "x", "y", "z")
    return N.radius_search(N.insert(p, p.withColumn("x", F.col("x") + 1)), 0.08).select("qidx", "idx", rounded("distance"))


@query(
    f"""{EMB}, r AS (SELECT a.idx AS q, sqrt({_D2}) AS d, row_number() OVER (PARTITION BY a.idx ORDER BY {_D2}, b.idx) AS k FROM p a, p b),
m AS (SELECT q, avg(d) AS d FROM r WHERE k <= 8 GROUP BY q) SELECT q AS idx FROM m WHERE d <= (SELECT avg(d) + 1.0 * stddev_pop(d) FROM m)"""
)
def stat_outlier_removal(spark, sf_dir):
    return L.statistical_outlier_removal(embedding_points(spark, sf_dir), 8, 1.0).select("idx")


@query(f"{EMB}, {near(0.1)} SELECT q AS idx FROM n GROUP BY q HAVING count(*) >= 6")
def radius_outlier_removal(spark, sf_dir):
    return L.radius_outlier_removal(embedding_points(spark, sf_dir), 0.1, 6).select("idx")


@query(
    f"""{EMB} SELECT a.idx FROM p a WHERE EXISTS (SELECT 1 FROM p b WHERE a.idx <> b.idx AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.05 * 0.05 AND b.z >= a.z)"""
)
def local_maximum_z(spark, sf_dir):
    return L.local_maximum_z(embedding_points(spark, sf_dir), 0.05).select("idx")


@query(
    f"""{EMB}, {near(0.1, 'a.intensity AS qi, b.intensity AS bi')}, w AS (SELECT q, bi, exp(-(d * d) / (2.0 * 0.05 * 0.05)) * exp(-((bi - qi) * (bi - qi)) / (2.0 * 0.1 * 0.1)) AS w FROM n)
SELECT q AS idx, {r6('sum(w * bi) / sum(w)', 'intensity')} FROM w GROUP BY q"""
)
def bilateral(spark, sf_dir):
    return L.bilateral(embedding_points(spark, sf_dir), 0.05, 0.1).select("idx", rounded("intensity"))


@query(
    f"""{EVT}, w AS (SELECT a.idx, any_value(a.z) AS z, list_sort(list(b.z)) AS zs FROM p a JOIN p b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.idx),
m AS (SELECT idx, z, zs[len(zs) // 2 + 1] AS m FROM w) SELECT idx, {r6('CASE WHEN z - m <= 100 THEN m ELSE m + 100 END', 'z')} FROM m"""
)
def median_filter(spark, sf_dir):
    return L.median(event_grid(spark, sf_dir), 3, 100.0).select("idx", rounded("z"))


@query(
    f"""{EMB}, {near(0.12, 'b.z AS v')}, g AS (SELECT q, count(*) AS n, sum(v) AS s, min(v) AS low, max(v) AS high FROM n GROUP BY q)
SELECT q AS idx, {r6('CASE WHEN n > 2 THEN (s - low - high) / (n - 2) ELSE s / n END', 'mean')}, n FROM g"""
)
def dynamic_kernel(spark, sf_dir):
    """A kernel that is no weight of its neighbours: their mean without the lowest and the highest."""
    return L.dynamic_kernel(embedding_points(spark, sf_dir), 0.12, L.TrimmedMean("z")).select("idx", rounded("mean"), "n")


@query(f"""{EVT}, r AS (SELECT a.idx AS qidx, b.idx AS idx, {_D2} AS d2, row_number() OVER (PARTITION BY a.idx ORDER BY {_D2}, b.idx) AS rank FROM p a, p b WHERE a.idx % 50 = 0)
SELECT qidx, rank::INTEGER AS rank, idx, {r6('sqrt(d2)', 'distance')} FROM r WHERE rank <= 6""")
def organized_knn(spark, sf_dir):
    """The nearest points of every fiftieth pixel, by the image."""
    p = event_grid(spark, sf_dir)
    return N.organized_knn(p, 6, 0.01, N.as_queries(p.where("idx % 50 = 0"))).select("qidx", "rank", "idx", rounded("distance"))


KERNEL = [1.0, 2.0, 4.0, 2.0, 0.5]


def _lagged(line: str, at: str) -> str:
    terms = " + ".join(f"{KERNEL[2 - d]!r} * lag(z, {-d}) OVER w" for d in range(-2, 3))
    return f"""c AS (SELECT idx, "row", col, ({terms}) / {sum(KERNEL)!r} AS v, count(*) OVER (PARTITION BY {line}) AS size FROM p WINDOW w AS (PARTITION BY {line} ORDER BY {at}))"""


@query(f"""{EVT}, {_lagged('"row"', 'col')} SELECT idx, {r6('coalesce(v, 0.0)', 'z')} FROM c""")
def convolve_rows(spark, sf_dir):
    return L.convolve(event_grid(spark, sf_dir), KERNEL, values=("z",)).select("idx", rounded("z"))


@query(f"""{EVT}, {_lagged('col', '"row"')} SELECT idx, {r6('coalesce(v, 0.0)', 'z')} FROM c""")
def convolve_columns(spark, sf_dir):
    return L.convolve_columns(event_grid(spark, sf_dir), KERNEL, values=("z",)).select("idx", rounded("z"))


_SOURCE = {
    "mirrored": "CASE WHEN a.col < 2 THEN 3 - a.col WHEN a.col >= a.size - 2 THEN 2 * (a.size - 2) - 1 - a.col ELSE a.col END",
    "repeated": "greatest(2, least(a.col, a.size - 3))",
}


@query(f"""{EVT}, {_lagged('"row"', 'col')} SELECT a.idx, {r6('b.v', 'z')} FROM c a JOIN c b ON a."row" = b."row" AND b.col = {_SOURCE['mirrored']}""")
def convolve_mirrored(spark, sf_dir):
    return L.convolve(event_grid(spark, sf_dir), KERNEL, border="mirrored", values=("z",)).select("idx", rounded("z"))


@query(f"""{EVT}, {_lagged('"row"', 'col')} SELECT a.idx, {r6('b.v', 'z')} FROM c a JOIN c b ON a."row" = b."row" AND b.col = {_SOURCE['repeated']}""")
def convolve_repeated(spark, sf_dir):
    return L.convolve(event_grid(spark, sf_dir), KERNEL, border="repeated", values=("z",)).select("idx", rounded("z"))


@query(
    f"""{EVT}, {_lagged('"row"', 'col')}, d AS (SELECT idx, "row", col, coalesce(v, 0.0) AS z FROM c),
e AS (SELECT idx, ({' + '.join(f'{k!r} * lag(z, {1 - d}) OVER w' for d, k in enumerate([3.0, 2.0, 1.0]))}) / 6.0 AS v FROM d WINDOW w AS (PARTITION BY col ORDER BY "row")) SELECT idx, {r6('coalesce(v, 0.0)', 'z')} FROM e"""
)
def convolve_both(spark, sf_dir):
    return L.convolve_both(event_grid(spark, sf_dir), KERNEL, [1.0, 2.0, 3.0], values=("z",)).select("idx", rounded("z"))


@query(f"{EMB}, {near(0.1, 'b.x, b.y, b.z')}, w AS (SELECT *, exp(-d / (2.0 * 0.05 * 0.05)) AS w FROM n) SELECT q AS idx, {', '.join(r6(f'sum(w * {c}) / sum(w)', c) for c in 'xyz')} FROM w GROUP BY q")
def gauss_kernel(spark, sf_dir):
    return L.gauss_kernel(embedding_points(spark, sf_dir), 0.05, 2.0).select("idx", *map(rounded, "xyz"))




@query(
    f"""{EMB}, {near(0.1, 'b.x, b.y, b.z')}, w AS (SELECT *, exp(-(d * d) / (2.0 * 0.05 * 0.05)) AS w FROM n)
SELECT q AS idx, {', '.join(r6(f'sum(w * {c}) / sum(w)', c) for c in 'xyz')} FROM w GROUP BY q"""
)
def gauss_kernel_squared(spark, sf_dir):
    return L.gauss_kernel(embedding_points(spark, sf_dir), 0.05, 2.0, True).select("idx", *map(rounded, "xyz"))


_PARTS = {"b": 0, "g": 8, "r": 16, "a": 24}


@query(
    f"""{EMB}, {near(0.1, 'b.x, b.y, b.z')}, w AS (SELECT n.*, exp(-d / (2.0 * 0.05 * 0.05)) AS w, {{rgba}} AS rgba FROM n),
m AS (SELECT q, {', '.join(f'sum(w * {c}) / sum(w) AS {c}' for c in 'xyz')}, {', '.join(f'floor(sum(w * ((rgba >> {k}) & 255)) / sum(w) + 1e-9)::BIGINT AS {c}' for c, k in _PARTS.items())} FROM w GROUP BY q)
SELECT q AS idx, {r6s('x', 'y', 'z')}, {' + '.join(f'({c} << {k})' for c, k in _PARTS.items())} AS rgba FROM m""".replace("{rgba}", RGBA.replace("idx", "i"))
)
def gauss_kernel_rgba(spark, sf_dir):
    from .points import _coloured

    return L.gauss_kernel_rgba(_coloured(spark, sf_dir), 0.05, 2.0).select("idx", *map(rounded, "xyz"), "rgba")


# --- features -------------------------------------------------------------------

_COV = ("xx", "xy", "xz", "yy", "yz", "zz")


@query(
    f"""{EMB}, {near(0.15, 'b.x, b.y, b.z')} SELECT q AS idx, {', '.join(r6(f'avg({c})', c) for c in 'xyz')},
{', '.join(r6(f'CASE WHEN count(*) >= 3 THEN covar_pop({k[0]}, {k[1]}) END', f'c{k}') for k in _COV)}, count(*) AS n FROM n GROUP BY q"""
)
def neighborhood_cov(spark, sf_dir):
    return E.neighborhood_cov(embedding_points(spark, sf_dir), 0.15).select("idx", *map(rounded, "xyz"), *(rounded(f"c{k}") for k in _COV), "n")


@query(
    f"""{EMB}, {near(0.15, 'b.x, b.y, b.z')}, s AS (SELECT q, count(*) AS k, {', '.join(f'covar_pop({k[0]}, {k[1]}) AS {k}' for k in _COV)} FROM n GROUP BY q), {least_axis('s')},
u AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) * CASE WHEN vz < 0 THEN -1 ELSE 1 END AS size FROM axis)
SELECT q AS idx, {', '.join(r6(f'CASE WHEN k >= 3 THEN v{c} / size ELSE 0.0 END', f'n{c}') for c in 'xyz')}, {r6('CASE WHEN k >= 3 THEN greatest(v, 0) / c2 ELSE 0.0 END', 'curvature')} FROM u"""
)
def normal_estimation(spark, sf_dir):
    return E.normal_estimation(embedding_points(spark, sf_dir), 0.15, (0.0, 0.0, 1.0)).select("idx", *map(rounded, ("nx", "ny", "nz", "curvature")))


_AXIS = "CASE WHEN abs(nx) <= abs(ny) AND abs(nx) <= abs(nz) THEN 0 WHEN abs(ny) <= abs(nz) THEN 1 ELSE 2 END"


@query(
    f"""{EMB}, f AS (SELECT *, {_AXIS} AS k FROM p), g AS (SELECT *, CASE k WHEN 0 THEN 0.0 WHEN 1 THEN -nz ELSE ny END AS ux, CASE k WHEN 0 THEN nz WHEN 1 THEN 0.0 ELSE -nx END AS uy, CASE k WHEN 0 THEN -ny WHEN 1 THEN nx ELSE 0.0 END AS uz FROM f),
h AS (SELECT *, ny * uz - nz * uy AS vx, nz * ux - nx * uz AS vy, nx * uy - ny * ux AS vz FROM g),
t AS (SELECT a.idx, atan2((a.x - b.x) * vx + (a.y - b.y) * vy + (a.z - b.z) * vz, (a.x - b.x) * ux + (a.y - b.y) * uy + (a.z - b.z) * uz) AS t FROM h a, p b WHERE {_D2} <= 0.15 * 0.15 AND {_D2} > 0),
s AS (SELECT idx, t, lead(t) OVER (PARTITION BY idx ORDER BY t) - t AS gap FROM t), w AS (SELECT idx, greatest(coalesce(max(gap), 0), 2 * pi() + min(t) - max(t)) AS widest FROM s GROUP BY idx)
SELECT p.idx, coalesce(widest > 2.0, false) AS is_boundary FROM p LEFT JOIN w ON p.idx = w.idx"""
)
def boundary(spark, sf_dir):
    return E.boundary(embedding_points(spark, sf_dir), 0.15, 2.0)


@query(
    f"""{EMB}, c AS (SELECT avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p), {near(0.15, 'b.x, b.y, b.z')},
m AS (SELECT q, {', '.join(f'sum(({k[0]} - c{k[0]}) * ({k[1]} - c{k[1]})) AS {k}' for k in _COV)} FROM n, c GROUP BY q)
SELECT q AS idx, {r6('xx + yy + zz', 'j1')}, {r6('xx * yy + yy * zz + zz * xx - (yz * xz + xz * xy + xy * yz)', 'j2')},
{r6('xx * yy * zz + 2 * yz * xz * xy - (yz * yz * xx + xz * xz * yy + xy * xy * zz)', 'j3')} FROM m"""
)
def moment_invariants(spark, sf_dir):
    return E.moment_invariants(embedding_points(spark, sf_dir), 0.15).select("idx", *map(rounded, ("j1", "j2", "j3")))


def _det(a: str, b: str, c: str) -> str:
    """Of the matrix with these three columns, each of three names."""
    p, q, r = (v.split() for v in (a, b, c))
    return f"({p[0]} * ({q[1]} * {r[2]} - {q[2]} * {r[1]}) - {q[0]} * ({p[1]} * {r[2]} - {p[2]} * {r[1]}) + {r[0]} * ({p[1]} * {q[2]} - {p[2]} * {q[1]}))"


_CX, _CY, _CZ, _CI = "xx xy xz", "xy yy yz", "xz yz zz", "ix iy iz"


@query(
    f"""{EMB}, {near(0.15, 'b.x, b.y, b.z, b.intensity AS v')}, s AS (SELECT q, count(*) AS k, {', '.join(f'covar_pop({c[0]}, {c[1]}) * count(*) AS {c}' for c in _COV)}, {', '.join(f'covar_pop({c}, v) * count(*) AS i{c}' for c in 'xyz')} FROM n GROUP BY q),
g AS (SELECT *, {_det(_CX, _CY, _CZ)} AS det FROM s), h AS (SELECT q, k, {_det(_CI, _CY, _CZ)} / det AS a, {_det(_CX, _CI, _CZ)} / det AS b, {_det(_CX, _CY, _CI)} / det AS c FROM g WHERE k >= 5),
t AS (SELECT h.*, nx, ny, nz, a * nx + b * ny + c * nz AS along FROM h JOIN p ON p.idx = h.q)
SELECT q AS idx, round(a - nx * along, 4) + 0 AS gx, round(b - ny * along, 4) + 0 AS gy, round(c - nz * along, 4) + 0 AS gz FROM t"""
)
def intensity_gradient_solved(spark, sf_dir):
    """The gradients of the neighbourhoods of five points or more, where the three equations have one solution."""
    return E.intensity_gradient(embedding_points(spark, sf_dir), 0.15, least=5).select("idx", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("gx", "gy", "gz")))


_FILLED = {k: f"{k} + fill * v{k[0]} * v{k[1]} / (vx * vx + vy * vy + vz * vz)" for k in ("xx", "xy", "xz", "yy", "yz", "zz")}


@query(
    f"""{EMB}, {near(0.15, 'b.x, b.y, b.z, b.intensity AS w')}, s AS (SELECT q, count(*) AS k, {', '.join(f'covar_pop({c[0]}, {c[1]}) AS {c}' for c in _COV)}, {', '.join(f'covar_pop({c}, w) AS i{c}' for c in 'xyz')} FROM n GROUP BY q HAVING count(*) >= 3), {least_axis('s')},
f AS (SELECT *, CASE WHEN v <= 1e-9 * c2 THEN c2 ELSE 0.0 END AS fill, (vx * ix + vy * iy + vz * iz) / (vx * vx + vy * vy + vz * vz) AS off FROM axis),
m AS (SELECT q, {', '.join(f'{e} AS {k}' for k, e in _FILLED.items())}, {', '.join(f'i{c} - CASE WHEN fill > 0 THEN off * v{c} ELSE 0 END AS i{c}' for c in 'xyz')} FROM f),
h AS (SELECT q, {_det(_CI, _CY, _CZ)} / {_det(_CX, _CY, _CZ)} AS a, {_det(_CX, _CI, _CZ)} / {_det(_CX, _CY, _CZ)} AS b, {_det(_CX, _CY, _CI)} / {_det(_CX, _CY, _CZ)} AS c FROM m),
t AS (SELECT p.idx, nx, ny, nz, a, b, c, a * nx + b * ny + c * nz AS along FROM p LEFT JOIN h ON p.idx = h.q)
SELECT idx, {', '.join(f'coalesce(round({g} - n{c} * along, 4), 0) + 0 AS g{c}' for g, c in zip('abc', 'xyz', strict=True))} FROM t"""
)
def intensity_gradient(spark, sf_dir):
    """All gradients: of three points, or of points in a plane, the shortest one that fits."""
    return E.intensity_gradient(embedding_points(spark, sf_dir), 0.15).select("idx", *((F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("gx", "gy", "gz")))


def _pair(a: str, b: str) -> str:
    """Columns d, alpha, phi, theta of the pair (a, b), whose columns have these prefixes."""
    ux, uy, uz = (f"(({b}{c} - {a}{c}) / d)" for c in "xyz")
    vx, vy, vz = f"({a}ny * {uz} - {a}nz * {uy})", f"({a}nz * {ux} - {a}nx * {uz})", f"({a}nx * {uy} - {a}ny * {ux})"
    wx, wy, wz = f"({a}ny * {vz} - {a}nz * {vy})", f"({a}nz * {vx} - {a}nx * {vz})", f"({a}nx * {vy} - {a}ny * {vx})"
    n2 = [f"{b}n{c}" for c in "xyz"]
    dot = lambda p, q: " + ".join(f"{i} * {j}" for i, j in zip(p, q, strict=True))
    return f"{dot((vx, vy, vz), n2)} AS alpha, {dot([f'{a}n{c}' for c in 'xyz'], (ux, uy, uz))} AS phi, atan2({dot((wx, wy, wz), n2)}, {dot([f'{a}n{c}' for c in 'xyz'], n2)}) AS theta"


def _bin(value: str, bins: int) -> str:
    return f"greatest(0, least(floor(({value}) * {bins}), {bins - 1}))::INTEGER"


_TH, _AL, _PH = "(theta + pi()) / (2 * pi())", "(alpha + 1) / 2", "(phi + 1) / 2"
_ALL = ", ".join(f"{t}.{c} AS {t}_{c}" for t in "ab" for c in ("x", "y", "z", "nx", "ny", "nz"))


@query(
    f"""{EMB}, {near(0.1)}, s AS (SELECT q, count(*) AS n FROM n GROUP BY q),
j AS (SELECT l.q, {_ALL}, sqrt({_D2}) AS d FROM n l JOIN n r ON l.q = r.q AND l.i < r.i JOIN p a ON a.idx = l.i JOIN p b ON b.idx = r.i),
f AS (SELECT q, {_pair('a_', 'b_')} FROM j WHERE d > 0), h AS (SELECT q, {_bin(_TH, 3)} + {_bin(_AL, 3)} * 3 + {_bin(_PH, 3)} * 9 AS bin, count(*) AS c FROM f GROUP BY ALL)
SELECT q AS idx, bin, {r6('c * 200.0 / (n * (n - 1))', 'v')} FROM h JOIN s USING (q)"""
)
def pfh(spark, sf_dir):
    return E.pfh_counts(embedding_points(spark, sf_dir), 0.1, 3).select("idx", "bin", rounded("v"))


@query(ORACLE_SQL["pfh"].replace("SELECT q AS idx, bin,", "SELECT idx, list_transform(range(27), lambda k: coalesce(list_extract(map_extract(m, k::INTEGER), 1), 0.0)) AS hist FROM (SELECT idx, map_from_entries(list((bin, v))) AS m FROM (SELECT q AS idx, bin,") + ") GROUP BY idx)")
def pfh_dense(spark, sf_dir):
    return E.pfh(embedding_points(spark, sf_dir), 0.1, 3).select("idx", F.transform("hist", lambda h: rounded(h)).alias("hist"))


_SPFH = f"""{near(0.1)}, s AS (SELECT q, count(*) AS n FROM n GROUP BY q),
j AS (SELECT n.q, {_ALL}, n.d FROM n JOIN p a ON a.idx = n.q JOIN p b ON b.idx = n.i WHERE n.d > 0),
f AS (SELECT q, {_pair('a_', 'b_')} FROM j), e AS (SELECT q, unnest([{_bin(_TH, 11)}, {_bin(_AL, 11)} + 11, {_bin(_PH, 11)} + 22]) AS bin FROM f),
h AS (SELECT q, bin, count(*) * 100.0 / (any_value(n) - 1) AS v FROM e JOIN s USING (q) GROUP BY q, bin)"""


@query(f"{EMB}, {_SPFH}, t AS (SELECT n.q, h.bin, sum(h.v / n.d) AS s FROM n JOIN h ON h.q = n.i WHERE n.d > 0 GROUP BY n.q, h.bin) SELECT q AS idx, bin, {r6('s * 100 / sum(s) OVER (PARTITION BY q, bin // 11)', 'v')} FROM t")
def fpfh(spark, sf_dir):
    return E.fpfh_counts(embedding_points(spark, sf_dir), 0.1, (11, 11, 11)).select("idx", "bin", rounded("v"))


@query(
    f"""{EMB}, c AS (SELECT {', '.join(f'avg({k}) AS a_{k}' for k in ('x', 'y', 'z', 'nx', 'ny', 'nz'))}, count(*) AS n FROM p),
j AS (SELECT c.*, {', '.join(f'p.{k} AS b_{k}' for k in ('x', 'y', 'z', 'nx', 'ny', 'nz'))}, sqrt((p.x - a_x) * (p.x - a_x) + (p.y - a_y) * (p.y - a_y) + (p.z - a_z) * (p.z - a_z)) AS d, sqrt((1 - a_x) * (1 - a_x) + (2 - a_y) * (2 - a_y) + (3 - a_z) * (3 - a_z)) AS l FROM p, c),
f AS (SELECT n, d, {_pair('a_', 'b_')}, (b_nx * (1 - a_x) / l + b_ny * (2 - a_y) / l + b_nz * (3 - a_z) / l + 1) / 2 AS t, max(d) OVER () AS far FROM j),
e AS (SELECT n, unnest([{_bin(_TH, 9)}, {_bin(_AL, 9)} + 9, {_bin(_PH, 9)} + 18, {_bin('d / far', 9)} + 27, {_bin('t', 16)} + 36]) AS bin FROM f)
SELECT bin, {r6('count(*) * 100.0 / (any_value(n) - 1)', 'v')} FROM e GROUP BY bin"""
)
def vfh(spark, sf_dir):
    return E.vfh_counts(embedding_points(spark, sf_dir), (9, 9, 9, 9), 16, (1.0, 2.0, 3.0)).select("bin", rounded("v"))


_CENTRE = (0.3, -0.2, 0.5)
_R = E.crh_rotation(_CENTRE)


def _turned(row: int, v: tuple) -> str:
    return "(" + " + ".join(f"{_R[row][k]!r} * {v[k]}" for k in range(3)) + ")"


_N, _P = ("nx", "ny", "nz"), ("x", "y", "z")


@query(
    f"""{EMB}, b AS (SELECT (floor((atan2({_turned(1, _N)}, {_turned(0, _N)}) + pi()) / (2 * pi() / 90))::BIGINT % 90)::INTEGER AS bin, sqrt({_turned(0, _P)} * {_turned(0, _P)} + {_turned(1, _P)} * {_turned(1, _P)}) AS w FROM p),
s AS (SELECT bin, sum(w) AS w FROM b GROUP BY bin) SELECT bin, {r6('w / sum(w) OVER ()', 'v')} FROM s"""
)
def crh_bins(spark, sf_dir):
    return E.crh_bins(embedding_points(spark, sf_dir), _CENTRE).select("bin", rounded("v"))


@query(
    ORACLE_SQL["crh_bins"].replace("SELECT bin, round(w / sum(w) OVER (), 6) + 0 AS v FROM s", "t AS (SELECT bin, w / sum(w) OVER () AS v FROM s), k AS (SELECT unnest(range(45)) AS k)").replace("FROM b GROUP BY bin) t AS", "FROM b GROUP BY bin), t AS")
    + """, c AS (SELECT k, round(sum(v * cos(2 * pi() * k * bin / 90)), 6) + 0 AS re, round(-sum(v * sin(2 * pi() * k * bin / 90)), 6) + 0 AS im FROM k, t GROUP BY k) SELECT flatten(list([re, im] ORDER BY k)) AS hist FROM c"""
)
def crh_fft(spark, sf_dir):
    return E.crh(embedding_points(spark, sf_dir), _CENTRE).select(F.transform("hist", lambda h: rounded(h)).alias("hist"))


@query()
def gasd_shape(spark, sf_dir):
    return E.gasd(embedding_points(spark, sf_dir)).select("gx", "gy", "gz", "bin", rounded("v"))


@query()
def gasd_shape_trilinear(spark, sf_dir):
    return E.gasd(embedding_points(spark, sf_dir), interpolation="trilinear").select("gx", "gy", "gz", "bin", rounded("v"))


@query()
def gasd_color(spark, sf_dir):
    from .points import _coloured

    return E.gasd_color(_coloured(spark, sf_dir)).select("gx", "gy", "gz", "bin", rounded("v"))


