"""Each query against its SQL on the smallest tables, and the others against numpy."""

import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from cloudloom import plans
from cloudloom.cloud import embedding_points, event_grid
from cloudloom.operators.models import MIN_SAMPLES, estimator
from cloudloom.operators.range_image import DIRECTIONS, OBSTACLE, SHADOW, SHIFT, VEIL, star
from cloudloom.operators.sac import consensus, numeric_distance
from cloudloom.plans.models import event_image

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "float": "FLOAT", "array<double>": "DOUBLE[]"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, duck, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    theirs = duck.sql(plans.ORACLE_SQL[name])
    names = list(theirs.columns)
    assert sorted(names) == columns
    rows = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in theirs.fetchall()), key=str)
    assert ours == rows
    kinds = dict(zip(names, map(str, theirs.types), strict=True))
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds


# --- queries without SQL, against numpy -----------------------------------------------


@pytest.fixture(scope="module")
def points(spark, sf_dir):
    """idx to (x, y, z), (nx, ny, nz), intensity."""
    rows = sorted(embedding_points(spark, sf_dir).collect())
    return np.array([(r.x, r.y, r.z) for r in rows]), np.array([(r.nx, r.ny, r.nz) for r in rows]), np.array([r.intensity for r in rows])


@pytest.fixture(scope="module")
def image(spark, sf_dir):
    rows = sorted(event_image(spark, sf_dir).select("idx", "x", "y", "z", "range").collect())
    return np.array([(r.x, r.y, r.z) for r in rows]), np.array([r.range for r in rows])


def run(spark, sf_dir, name):
    return plans.QUERIES[name](spark, sf_dir).collect()


def near_of(at, radius):
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    return [np.flatnonzero(row <= radius) for row in d]


def window_of(idx, n, half):
    r, c = divmod(idx, 100)
    return [i * 100 + j for i in range(r - half, r + half + 1) for j in range(c - half, c + half + 1) if 0 <= j < 100 and 0 <= i and i * 100 + j < n]


def smallest(at):
    """(normal up to its sign, curvature) of points."""
    values, vectors = np.linalg.eigh(np.cov(at.T, bias=True))
    return vectors[:, 0], values[0] / values.sum()


def test_normals(spark, sf_dir, points):
    at = points[0]
    near = near_of(at, 0.15)
    rows = run(spark, sf_dir, "normal_estimation")
    assert len(rows) == len(at)
    for r in rows:
        n = np.array([r.nx, r.ny, r.nz])
        if len(near[r.idx]) < 3:
            assert not n.any() and r.curvature == 0
            continue
        want, curvature = smallest(at[near[r.idx]])
        assert r.curvature == pytest.approx(curvature, abs=2e-6)
        if len(near[r.idx]) > 3:
            assert abs(abs(n @ want) - 1) < 1e-4


def test_gradients(spark, sf_dir, points):
    at, normals, value = points
    near = near_of(at, 0.15)
    for r in run(spark, sf_dir, "intensity_gradient"):
        own = near[r.idx]
        if len(own) < 5:
            continue
        g = np.linalg.lstsq(at[own] - at[own].mean(0), value[own] - value[own].mean(), rcond=None)[0]
        g -= normals[r.idx] * (g @ normals[r.idx])
        assert [r.gx, r.gy, r.gz] == pytest.approx(g.tolist(), abs=1e-3)


def test_gasd(spark, sf_dir, points):
    at = points[0]
    values, vectors = np.linalg.eigh(np.cov(at.T, bias=True))
    z = vectors[:, 0] * -np.sign(vectors[2, 0])
    rows = run(spark, sf_dir, "gasd_shape")
    total = {}
    for r in rows:
        total[r.gz] = total.get(r.gz, 0) + r.v
    # Along the least axis, whose sign is given, cells don't depend on how the other two are turned by half.
    local = (at - at.mean(0)) @ vectors
    most = np.abs(local).max()
    cell = np.clip(np.floor((at - at.mean(0)) @ z / most * 4 + 4), 0, 7).astype(int)
    want = np.bincount(cell, minlength=8) * 100 / (len(at) - 1)
    assert [total.get(k, 0.0) for k in range(8)] == pytest.approx(want.tolist(), abs=1e-4)
    far = np.linalg.norm(at - at.mean(0), axis=1)
    step = far / (far.max() / 4)
    bins = np.bincount(np.clip(np.floor((step - np.floor(step)) * 4), 0, 3).astype(int), minlength=4) * 100 / (len(at) - 1)
    got = [sum(r.v for r in rows if r.bin == k) for k in range(4)]
    assert got == pytest.approx(bins.tolist(), abs=0.5)
    for name in ("gasd_shape_trilinear", "gasd_color"):
        assert sum(r.v for r in run(spark, sf_dir, name)) == pytest.approx(100 * len(at) / (len(at) - 1), abs=1e-2)


def test_samples(spark, sf_dir, points):
    rows = run(spark, sf_dir, "random_sample")
    assert len({r.idx for r in rows}) == 100 and all((r.x, r.y, r.z) == tuple(points[0][r.idx]) for r in rows)

    def hashed(i: int) -> int:
        """Spark's XXH64 of a long and an int: each value is hashed with the hash before it as the seed."""
        for v, size in ((i, 8), (42, 4)):
            h = xxhash64_of(v, size, h if size == 4 else 42)
        return h - (1 << 64) if h >> 63 else h

    assert {r.idx for r in rows} == set(sorted(range(len(points[0])), key=hashed)[:100])


def xxhash64_of(v: int, size: int, seed: int) -> int:
    import xxhash

    return xxhash.xxh64_intdigest((v & (1 << 8 * size) - 1).to_bytes(size, "little"), seed)


@pytest.mark.parametrize(("name", "kind", "threshold", "constraint"), [("sac_plane", "plane", 0.05, None), ("sac_line", "line", 0.1, None), ("sac_sphere", "sphere", 0.05, None), ("sac_perpendicular_plane", "perpendicular plane", 0.05, (0, 0, 1)), ("sac_parallel_plane", "parallel plane", 0.05, (1, 0, 0)), ("sac_parallel_line", "parallel line", 0.1, (0, 1, 0))])
def test_consensus(spark, sf_dir, points, name, kind, threshold, constraint):
    at = points[0]
    found = {r.idx for r in run(spark, sf_dir, name)}
    model, inliers = consensus(embedding_points(spark, sf_dir), kind, threshold, constraint=constraint)
    assert found == {r.idx for r in inliers.collect()} == set(np.flatnonzero(numeric_distance(model, at) < threshold).tolist())
    r = np.random.default_rng(5)
    need, fit = MIN_SAMPLES[kind], estimator(kind, constraint)
    others = [(numeric_distance(m, at) < threshold).sum() for _ in range(300) for m in fit(at[r.choice(len(at), need, replace=False)])]
    assert len(found) >= np.quantile(others, 0.99)


def test_projection_of_the_grid(spark, sf_dir):
    rows = run(spark, sf_dir, "projection_matrix")
    m = np.zeros((3, 4))
    for r in rows:
        m[r.row, r.col] = r.value
    at = np.array([(r.x, r.y, r.z, 1.0) for r in event_grid(spark, sf_dir).orderBy("idx").collect()])
    p = at @ m.T
    assert np.abs(p[:, :2] / p[:, 2:] - at[:, :2]).max() < 0.05 and rows[0].residual < 0.01


def test_surfaces(spark, sf_dir, image):
    at = image[0]
    rows = run(spark, sf_dir, "surface_info")
    pedal = {r.idx: r for r in run(spark, sf_dir, "normal_within")}
    assert len(rows) == len(at)
    for r in rows[::7]:
        near = window_of(r.idx, len(at), 2)
        d = ((at[near] - at[r.idx]) ** 2).sum(1)
        some = [near[k] for k in np.lexsort((near, d))[:9]]
        n, curvature = smallest(at[some])
        assert r.curvature == pytest.approx(curvature, abs=2e-6) and r.farthest == pytest.approx(np.sqrt(np.sort(d)[8]), abs=2e-6)
        assert abs(abs(n @ [r.nx, r.ny, r.nz]) - 1) < 1e-3 and -(at[r.idx] @ [r.nx, r.ny, r.nz]) >= -1e-5
        some = [near[k] for k in np.lexsort((near, d))[:15]]
        n = smallest(at[some])[0]
        foot = at[r.idx] + n * (n @ (at[some].mean(0) - at[r.idx]))
        q = pedal[r.idx]
        assert [q.px, q.py, q.pz] == pytest.approx(foot.tolist(), abs=1e-3)


def test_impact_angles(spark, sf_dir, image):
    at, far = image
    for r in run(spark, sf_dir, "pair_impact_angles"):
        a = r.row * 100 + r.col
        b = a + 1
        first, last = (a, b) if far[a] <= far[b] else (b, a)
        line, sight = at[first] - at[last], -at[last]
        cosine = line @ sight / np.linalg.norm(line) / np.linalg.norm(sight)
        angle = np.arccos(np.clip(cosine, 0, 1)) * (-1 if far[a] > far[b] else 1)
        assert r.impact_angle == pytest.approx(angle, abs=1e-4)


def test_borders(spark, sf_dir, image):
    """Every shadow edge has its obstacle edge on the other side of a veil, in the same line."""
    rows = {r.idx: r for r in run(spark, sf_dir, "border_traits")}
    assert len(rows) == len(image[0])
    edges = 0
    for r in rows.values():
        for name, (di, dj) in DIRECTIONS.items():
            bits = r.border_traits >> SHIFT[name]
            if bits & SHADOW:
                edges += 1
                k = 1
                while k <= 10:
                    i, j = r.row - di * k, r.col - dj * k
                    other = rows[i * 100 + j].border_traits >> SHIFT[name]
                    if other & OBSTACLE:
                        break
                    assert other & VEIL or k == 10
                    k += 1
                assert k <= 10 and image[1][r.idx] >= image[1][(r.row - di * k) * 100 + r.col - dj * k]
    assert edges or not any(r.border_traits for r in rows.values())


def test_narf(spark, sf_dir, points):
    rows = run(spark, sf_dir, "narf")
    at, normals = points[:2]
    assert {r.idx for r in rows} == set(range(len(at)))
    for r in rows[:: max(1, len(rows) // 60)]:
        n = normals[r.idx]
        own = np.eye(3)[np.abs(n).argmin()]
        u = np.cross(n, own)
        v = np.cross(n, u)
        u, v = u / np.linalg.norm(u), v / np.linalg.norm(v)
        d = at - at[r.idx]
        d = d[(d**2).sum(1) <= 0.3**2 / 2]
        patch = np.full((10, 10), np.nan)
        for i, j, depth in zip(np.floor((d @ u / 0.3 + 0.5) * 10).astype(int), np.floor((d @ v / 0.3 + 0.5) * 10).astype(int), -(d @ n), strict=True):
            if 0 <= i < 10 and 0 <= j < 10:
                patch[i, j] = depth if np.isnan(patch[i, j]) else min(patch[i, j], depth)
        while np.isnan(patch).any():
            before = patch.copy()
            for i, j in zip(*np.where(np.isnan(before)), strict=True):
                around = before[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2]
                if not np.isnan(around).all():
                    patch[i, j] = np.nanmean(around)
        wide = np.pad(patch, 1, mode="edge")
        blurred = np.array([[wide[i : i + 3, j : j + 3].mean() for j in range(10)] for i in range(10)])
        assert r.descriptor == pytest.approx(star(blurred, 36, 0.3, 2 * np.pi * round(r.rotation * 18 / np.pi) / 36).tolist(), abs=0.02)


CHECKED = set("gasd_shape gasd_shape_trilinear gasd_color random_sample sac_plane sac_line sac_sphere sac_perpendicular_plane sac_parallel_plane sac_parallel_line projection_matrix border_traits narf".split())


def test_every_query_is_checked():
    assert set(plans.QUERIES) - set(plans.ORACLE_SQL) == CHECKED


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
