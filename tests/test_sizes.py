"""What keeps large clouds within memory and disk: plans, and folds of neighbourhoods against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.cloud import with_grid
from cloudloom.operators import aggregates as A
from cloudloom.operators import blocks as B
from cloudloom.operators import features as E
from cloudloom.operators import neighbors as N
from cloudloom.plans import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def heap(spark, extra=""):
    """300 points, 90 of them at one place and two without coordinates, and their arrays."""
    r = np.random.default_rng(4)
    at = np.round(r.random((300, 3)), 3)
    at[200:290] = at[0]
    n = r.standard_normal((300, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    v = np.round(r.random(300), 3)
    rows = [(i, *map(float, p), *map(float, q), float(w)) for i, (p, q, w) in enumerate(zip(at, n, v, strict=True))]
    rows += [(300, float("nan"), 0.0, 0.0, 1.0, 0.0, 0.0, 0.0), (301, float("inf"), 0.0, 0.0, 1.0, 0.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "idx long, x double, y double, z double, nx double, ny double, nz double, intensity double").repartition(5), at, n, v


def within(at, radius):
    d = at[:, None] - at[None]
    return (d[..., 0] ** 2 + d[..., 1] ** 2) + d[..., 2] ** 2 <= radius * radius


def test_folds_by_leaf(spark):
    df, at, _, _ = heap(spark)

    def count(q, batches):
        t, n = B.Tiled(q, "qx qy qz", 16), np.zeros(len(q["qidx"]), int)
        assert len(n) <= 50
        for batch in batches:
            for some, _, hit, _ in B.pairs(t, B.Tiled(batch, "x y z", 32), 0.25, 0.0625):
                n[some] += hit.sum(1)
        yield {"idx": t.columns["qidx"], "n": n}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for points in (df, df.where("idx < 0")):
            got = sorted(map(tuple, B.by_leaf(N.as_queries(df), points.where("idx < 300").select("idx", "x", "y", "z"), 0.25, count, "idx long, n long", 50).collect()))
            want = within(at, 0.25).sum(1).tolist() if points is df else [0] * 300
            assert got == list(enumerate(want))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("square", [4_096, 50])
def test_pairs_of_neighbourhoods_by_squares(spark, square):
    """Equal points, several squares, and neighbourhoods that follow from the one before."""
    _, at, n, _ = heap(spark)
    near = within(at, 0.35)
    points = {"idx": np.arange(300)} | {c: at[:, k] for k, c in enumerate("xyz")} | {f"n{c}": n[:, k] for k, c in enumerate("xyz")}
    want = np.zeros((300, 28), int)
    whole = E._pair_bins(points, points, 3)
    for k in range(300):
        i = np.flatnonzero(near[k])
        want[k] = np.bincount(whole[np.ix_(i, i)][np.triu_indices(len(i), 1)], minlength=28)
    got = np.zeros((300, 28), int)
    for a in range(0, 300, square):
        for b in range(a, 300, square):
            r, c = slice(a, a + square), slice(b, b + square)
            some = whole[r, c].copy()
            if a == b:
                some[np.tril_indices(len(some))] = 27
            got += E._squares(some, near[:, r], near[:, c], 28)
    assert (got[:, :27] == want[:, :27]).all() and got[:, :27].sum() > 10_000


@pytest.mark.parametrize("name", ["narf", "fpfh", "pfh", "pfh_dense", "boundary", "dynamic_kernel", "intensity_gradient", "intensity_gradient_solved"])
def test_no_pair_of_neighbours_is_joined_or_shuffled(spark, sf_dir, name):
    assert "SortMergeJoin" not in plan(QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", ["organized_radius", "surface_patches"])
def test_no_side_as_large_as_the_cloud_is_broadcast(spark, sf_dir, name):
    assert "BroadcastHashJoin" not in plan(QUERIES[name](spark, sf_dir))


def test_projection_of_a_tall_image(spark):
    """6,000,000 rows of pixels, every 6,000th of them filled."""
    df = spark.range(100_000).select(F.expr("id div 100 * 600000 + id % 100").alias("idx"), (F.col("id") * 7919 % 490).cast("double").alias("z"))
    df = with_grid(df, 100).withColumns({"x": F.col("col").cast("double"), "y": F.col("row").cast("double")})
    fit = N.organized_fit(df, 0.01)
    assert fit is not None and fit.slack < 0.005 and (fit.last_row, fit.last_col) == (5_994_000, 99)


def test_projection_with_noise_is_the_least_one(spark):
    r = np.random.default_rng(2)
    at = r.random((300, 3)) * [2, 3, 1] + [5, -2, 4]
    pixel = np.round(np.column_stack([300 * at[:, 0] / at[:, 2], 200 * at[:, 1] / at[:, 2]]) + r.normal(0, 3, (300, 2)), 3)
    matrix, residual = A.projection_matrix(spark.createDataFrame([(*map(float, p), *map(float, c)) for p, c in zip(at, pixel, strict=True)], "x double, y double, z double, col double, row double"))
    p, none = np.column_stack([at, np.ones(300)]), np.zeros((300, 4))
    rows = np.vstack([np.hstack([p, none, -pixel[:, :1] * p]), np.hstack([none, p, -pixel[:, 1:] * p])])
    values, vectors = np.linalg.eigh(rows.T @ rows)
    want = vectors[:, 0].reshape(3, 4)
    want = want / np.linalg.norm(want[2, :3]) * (1 if want[2, 3] >= 0 else -1)
    assert residual == pytest.approx(values[0] / 300) and matrix.ravel().tolist() == pytest.approx(want.ravel().tolist(), rel=1e-6, abs=1e-6 * abs(want).max())
