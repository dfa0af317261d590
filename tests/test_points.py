"""Closed-form inputs for points, aggregates, grids and neighbours."""

import math

import pytest
from pyspark.sql import functions as F

from cloudloom.cloud import Cloud, require, with_grid
from cloudloom.operators import aggregates as A
from cloudloom.operators import filters as L
from cloudloom.operators import grid as G
from cloudloom.operators import neighbors as N
from cloudloom.operators import kdtree, pyramid
from cloudloom.operators import points as P

XYZ = "idx long, x double, y double, z double"


def cloud(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], XYZ)


def plane(spark):
    return cloud(spark, [(i, j, 0) for i in range(10) for j in range(10)])


def odd(spark):
    return cloud(spark, [(0, 0, 0), (math.nan, 0, 0), (1, 1, 1), (math.inf, 2, 2), (2, 0, 1)])


def test_missing_points_are_ignored(spark):
    df = odd(spark)
    c = A.centroid(df).first()
    assert (c.x, c.n) == (1.0, 3)
    b = A.finite_bound(df).first()
    assert (b.max_x, b.min_x) == (2.0, 0.0)
    assert G.voxel_grid(df, (1, 1, 1)).count() == 3
    assert N.radius_search(df, 10).count() == 9
    assert not Cloud(df).is_bounded()


def test_empty_cloud(spark):
    df = cloud(spark, []).where("idx >= 0")
    assert A.centroid(df).count() == 0
    assert A.finite_bound(df).count() == 0
    assert G.voxel_grid(df, (1, 1, 1)).count() == 0
    assert N.knn_search(df, 3).count() == 0
    assert L.radius_outlier_removal(df, 1.0, 1).count() == 0


def test_frustum_probe(spark):
    df = cloud(spark, [(5, 0, 0), (0.5, 0, 0), (11, 0, 0), (5, 40, 0), (-5, 0, 0)])
    kept = P.frustum_culling(df, 1, 10, math.pi / 4, math.pi / 4)
    assert [r.idx for r in kept.collect()] == [0]


def test_frustum_moves_with_the_camera(spark):
    turned = [[0.0, -1.0, 0.0, 1.0], [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
    df = cloud(spark, [(1, 5, 0), (5, 0, 0)])
    assert [r.idx for r in P.frustum_culling(df, 1, 10, 0.5, 0.5, pose=turned).collect()] == [0]


def test_transpose_twice_is_the_same(spark):
    df = with_grid(cloud(spark, [(i, 0, 0) for i in range(6)]), 3)
    once = P.transpose(df, 2)
    assert {(r.row, r.col): r.x for r in once.collect()}[(2, 1)] == 5.0
    twice = P.transpose(once, 3)
    assert sorted((r.idx, r.x) for r in twice.collect()) == [(i, float(i)) for i in range(6)]


def test_voxels_with_an_empty_corner(spark):
    assert G.voxel_grid(cloud(spark, [(0, 1, 1), (1, 0, 1), (1, 1, 0)]), (1, 1, 1)).count() == 3


def test_ties_go_to_the_smallest_idx(spark):
    df = cloud(spark, [(0, 0, 1), (0, 0, 1), (1, 0, 1), (-1, 0, 1)])
    assert [r.idx for r in G.grid_minimum_z(df, (10, 10)).collect()] == [0]
    near = N.knn_search(df, 3).where("qidx = 0").orderBy("rank").collect()
    assert [r.idx for r in near] == [0, 1, 2]
    assert A.max_distance(df, (0, 0, 1)).first().idx == 2


def test_kept_and_removed_make_the_input(spark):
    df = plane(spark)
    for negative in (False, True):
        parts = [L.radius_outlier_removal(df, 1.1, 5, n).count() for n in (negative, not negative)]
        assert sum(parts) == 100
    kept, removed = P.split(odd(spark), F.col("x") > 1)
    assert kept.count() + removed.count() == 5
    sample, rest = P.random_sample(df, 30, 1)
    assert sample.count() == 30 and rest.count() == 70
    assert P.random_sample(df, 300, 1)[0].count() == 100


def test_knn_is_consistent_with_radius(spark):
    df = plane(spark)
    knn = N.knn_search(df, 4)
    far = {r.qidx: r.d for r in knn.groupBy("qidx").agg(F.max("distance").alias("d")).collect()}
    inside = {r.qidx: r.n for r in N.radius_search(df, 1.5).groupBy("qidx").agg(F.count("*").alias("n")).collect()}
    assert all(inside[q] >= 4 or d >= 1.5 for q, d in far.items())
    assert N.knn_search(cloud(spark, [(0, 0, 0), (1, 0, 0)]), 5).count() == 4
    assert N.radius_search(df, 1.0, strict=True).count() == 100


def test_index_filter_keeps_order_and_repeats(spark):
    order = spark.createDataFrame([(0, 3), (1, 3), (2, 1)], "pos long, idx long")
    assert [(r.pos, r.idx) for r in P.take(plane(spark), order).orderBy("pos").collect()] == [(0, 3), (1, 3), (2, 1)]
    assert P.select_ids(plane(spark), None).count() == 100


def test_octree_map(spark):
    rows = [((3, 2, 3), 234), ((1, 4, 1), 34634), ((6, 2, 5), 23424), ((2, 5, 3), 34323), ((7, 1, 6), 64352)]
    keys = "kx long, ky long, kz long"
    tree = G.Octree(spark.createDataFrame([(3, 2, 3, 123)], f"{keys}, value long"), 3).insert(spark.createDataFrame([(*k, v) for k, v in rows], f"{keys}, value long"))
    assert tree.max_key == 7

    def get(t, k):
        return [r.value for r in t.get(spark.createDataFrame([k], keys)).collect()]

    assert get(tree, (3, 2, 3)) == [234]
    assert get(tree, (2, 5, 3)) == [34323]
    assert get(tree.remove(spark.createDataFrame([(2, 5, 3)], keys)), (2, 5, 3)) == []


def test_octree_codec(spark):
    leaves = spark.createDataFrame([(2, 3, 2, 232), (0, 0, 0, 0)], "kx long, ky long, kz long, v long")
    for block in (1, 2, 99):
        blocks, values = G.octree_encode(leaves, 2, "v", block)
        assert b"".join(r.code for r in blocks.orderBy("block").collect()) == bytes([0b10000001, 0b00000001, 0b00000100])
        assert [tuple(r) for r in values.orderBy("position").collect()] == [(0, 0), (1, 232)]
        assert sorted(map(tuple, G.octree_decode(blocks, values, 2).collect())) == [(0, 0, 0, 0), (2, 3, 2, 232)]
    assert G.octree_decode(*G.octree_encode(leaves.limit(0), 2, "v"), 2).collect() == []
    assert G.octree_depth(8, 1) == 3 and G.octree_depth(0.5, 1) == 0


def test_camera_matrix_of_a_known_camera(spark):
    rows = []
    for i in range(6):
        for j in range(5):
            z = 2 + ((i * 7 + j * 3) % 5) / 3
            x, y = (i - 2) * z / 4, (j - 2) * z / 4
            rows.append((len(rows), x, y, z, 4 * x / z + 2, 4 * y / z + 2))
    df = spark.createDataFrame(rows, "idx long, x double, y double, z double, col double, row double")
    matrix, residual = A.projection_matrix(df)
    assert residual < 1e-9
    want = [[4, 0, 2, 0], [0, 4, 2, 0], [0, 0, 1, 0]]
    sign = 1 if matrix[2, 2] > 0 else -1
    assert abs(sign * matrix - want).max() < 1e-6


def test_colours(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0xFF102030), (1, 0.0, 0.0, 0.0, 0xFF112133)], f"{XYZ}, rgba long")
    assert A.centroid_attributes(df).first().rgba == 0xFF102031
    got = df.select(*(c.alias(k) for k, c in P.unpack_rgba(F.col("rgba")).items())).first()
    assert (got.b, got.g, got.r, got.a) == (0x30, 0x20, 0x10, 0xFF)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="nx"):
        require(plane(spark), "x", "nx")


def test_adjacency_weights(spark):
    leaves = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (1, 1, 1), (5, 5, 5)], "kx long, ky long, kz long")
    assert sorted(r.weight for r in G.octree_adjacency(leaves, 2.0).collect()) == pytest.approx([2.0, 2 * math.sqrt(2), 2 * math.sqrt(3)])


def test_convolution_rejects_bad_kernels(spark):
    df = with_grid(plane(spark), 10)
    for kernel in ([1.0, -1.0], [1.0, -2.0, 1.0]):
        with pytest.raises(ValueError):
            L.convolve(df, kernel)
    assert L.convolve_both(df, [1.0, 1.0, 1.0], [1.0, 1.0, 1.0], "repeated").where("idx = 55").first().x == 5.0


def test_an_outlier_does_not_widen_other_searches(spark):
    import numpy as np

    r = np.random.default_rng(0)
    points = [tuple(map(float, p)) for p in r.random((1500, 3))] + [(1e6, -1e6, 3.0)] + [(0.5, 0.5, 0.5)] * 12
    df = cloud(spark, points)
    at, k, n = np.array(points), 5, len(points)
    d2 = ((at[:, None] - at[None]) ** 2).sum(2)
    got = N.knn_search(df, k).orderBy("qidx", "rank").collect()
    assert [r.idx for r in got] == np.argsort(d2, axis=1, kind="stable")[:, :k].ravel().tolist()
    assert pyramid.candidates(df, N.as_queries(df).select("qx", "qy", "qz").distinct(), k).count() <= 50 * n * k
    kept = {r.idx for r in L.statistical_outlier_removal(df, k, 1.0).select("idx").collect()}
    assert 1500 not in kept and len(kept) == n - 1
    far = df.limit(0).select(F.col("idx").alias("qidx"), *(F.col(c).alias(f"q{c}") for c in "xyz"))
    assert N.knn_search(df, k, far).count() == 0 and N.knn_search(df.limit(0), k).count() == 0
    other = spark.createDataFrame([(7, 0.2, 0.2, 0.2), (8, 1e5, 0.0, 0.0)], "qidx long, qx double, qy double, qz double")
    for q in N.knn_search(df, 3, other).groupBy("qidx").agg(F.collect_list("idx").alias("i")).collect():
        d = ((at - ((0.2,) * 3 if q.qidx == 7 else (1e5, 0, 0))) ** 2).sum(1)
        assert sorted(q.i) == sorted(np.argsort(d, kind="stable")[:3].tolist())


def test_organized_search_finds_what_cells_find(spark):
    import numpy as np

    r = np.random.default_rng(1)
    rows = [(i * 20 + j, i, j, float(d * (j - 9.5) / 15), float(d * (i - 9.5) / 15), float(d)) for i in range(20) for j in range(20) for d in [2 + 3 * r.random()]]
    df = spark.createDataFrame(rows, "idx long, row long, col long, x double, y double, z double")
    fit = N.organized_fit(df, 1e-6)
    assert fit is not None and fit.slack < 1e-3
    for radius in (0.3, 1.0, 9.0):
        ours = {(x.qidx, x.idx) for x in N.organized_search(df, radius, 1e-6).collect()}
        assert ours == {(x.qidx, x.idx) for x in N.radius_search(df, radius).collect()}
    box = df.select("idx", "row", "col", *(F.col(c).alias(f"q{c}") for c in "xyz")).withColumns(fit.box(0.3)).select(F.avg((F.col("last_row") - F.col("first_row") + 1) * (F.col("last_col") - F.col("first_col") + 1))).first()[0]
    assert box < 60  # of 400 pixels
    assert N.organized_fit(df.withColumn("x", F.rand(1)), 1e-6) is None
    assert N.organized_search(df.withColumn("x", F.rand(1)), 0.1, 1e-6).count() > 0


def test_inserted_points_are_found(spark):
    df = N.insert(cloud(spark, [(0, 0, 0), (1, 0, 0)]), cloud(spark, [(0, 0, 0.5)]))
    assert sorted(r.idx for r in df.collect()) == [0, 1, 2]
    assert [r.idx for r in N.knn_search(df, 2).where("qidx = 0").orderBy("rank").collect()] == [0, 2]
    assert N.insert(cloud(spark, [(0, 0, 0)]).limit(0), cloud(spark, [(0, 0, 1)])).first().idx == 0


@pytest.mark.parametrize("window", [1, 3, 5])
def test_median_of_windows_with_missing_points(spark, window):
    import numpy as np

    r = np.random.default_rng(window)
    z = r.random((9, 7)) * 10
    z[r.random(z.shape) < 0.2] = np.nan
    gone = {(2, 3), (8, 6)}  # no row at all
    rows = [(i * 7 + j, i, j, float(j), float(i), float(z[i, j])) for i in range(9) for j in range(7) if (i, j) not in gone]
    df = spark.createDataFrame(rows, "idx long, row long, col long, x double, y double, z double")
    got = {(q.row, q.col): q.z for q in L.median(df, window, 1.5).collect()}
    assert len(got) == len(rows)
    for _, i, j, _, _, own in rows:
        near = [z[a, b] for a in range(max(0, i - window // 2), min(9, i + window // 2 + 1)) for b in range(max(0, j - window // 2), min(7, j + window // 2 + 1)) if (a, b) not in gone and not np.isnan(z[a, b])]
        if np.isnan(own):
            assert np.isnan(got[i, j])
            continue
        m = sorted(near)[len(near) // 2]
        assert got[i, j] == (m if own - m <= 1.5 else m + 1.5)


def nearest(at, asked, k):
    """Numbers of the k nearest points, the smallest number of equals."""
    import numpy as np

    d = (at[None] - asked[:, None]) ** 2
    d = d[..., 0] + d[..., 1] + d[..., 2]
    return [np.lexsort((np.arange(len(at)), row))[:k].tolist() for row in d]


@pytest.mark.parametrize("top", [1, 8_192])
def test_descent_through_the_pyramid(spark, monkeypatch, top):
    """Densities a million apart, one point of a hundred far away, heaps of equal points; levels on the driver or all in joins."""
    import numpy as np

    monkeypatch.setattr(pyramid, "TOP", top)
    r = np.random.default_rng(top)
    far = r.standard_normal((300, 3))
    far[::100] *= 1e6
    clouds = {"dense": np.concatenate([r.random((150, 3)) * 1e-6, r.random((150, 3)) + 2]), "far": far, "heaps": np.concatenate([np.zeros((120, 3)), r.integers(0, 3, (120, 3)).astype(float)])}
    for name, at in clouds.items() if top > 1 else [("far", far[:120])]:
        df, k = cloud(spark, at).repartition(3), 6
        got = {}
        for row in N.knn_search(df, k).orderBy("qidx", "rank").collect():
            got.setdefault(row.qidx, []).append(row.idx)
        assert [got[i] for i in range(len(at))] == nearest(at, at, k), name
        places = N.as_queries(df).select("qx", "qy", "qz").distinct()
        assert pyramid.candidates(df, places, k).count() <= 50 * k * len(at)


def test_split_tree(spark):
    """Leaves of about the same number of points, where cells as wide as the radius are not; the same neighbours as cells find."""
    import numpy as np

    r = np.random.default_rng(4)
    at = np.concatenate([r.standard_normal((1_500, 3)) * 0.02, r.random((500, 3)) * 4, [[9.0, 9.0, 9.0]] * 5])
    df = cloud(spark, at).repartition(3).union(spark.createDataFrame([(10_000, float("nan"), 0.0, 0.0)], XYZ))
    tree = kdtree.split_tree(df, leaf=100)
    sizes = [row.n for row in kdtree.leaf_sizes(df, tree).collect()]
    assert tree.leaves == 32 and sum(sizes) == len(at) and max(sizes) <= 2 * sum(sizes) / tree.leaves
    cells = df.where("idx < 10000").groupBy(*(F.floor(F.col(c) / 0.3) for c in "xyz")).count().agg(F.max("count"), F.avg("count")).first()
    assert cells[0] > 10 * cells[1]
    few = N.as_queries(df).where("qidx % 20 = 0 or qidx >= 2000")
    for radius, strict in ((0.3, False), (0.01, True)):
        want = {tuple(row) for row in N.radius_search(df, radius, few, strict).collect()}
        got = kdtree.kd_radius(df, radius, few, strict, tree).collect()
        assert len(got) == len(want) and {tuple(row) for row in got} == want
    outside = spark.createDataFrame([(1, -50.0, 0.0, 0.0), (2, 9.0, 9.0, 9.1)], "qidx long, qx double, qy double, qz double")
    assert {row.idx for row in kdtree.kd_radius(df, 0.2, outside, tree=tree).collect()} == set(range(2_000, 2_005))
    none = df.where("idx < 0")
    assert kdtree.split_tree(none).leaves == 1 and kdtree.kd_radius(none, 1.0).collect() == []
    with_more = kdtree.kd_radius(df.withColumn("intensity", F.col("idx") * 2.0), 0.001, few, tree=kdtree.grow(at, 0), extra=("intensity",))
    assert all(row.intensity == 2.0 * row.idx for row in with_more.collect())


def test_octree_codec_in_blocks(spark):
    """A random tree against a walk through it."""
    import numpy as np

    depth = 4
    keys = sorted({tuple(map(int, k)) for k in np.random.default_rng(8).integers(0, 1 << depth, (300, 3))})
    code, order = [], []

    def walk(some, level):
        if level < 0:
            order.extend(some)
            return
        parts = [[k for k in some if (k[0] >> level & 1) * 4 + (k[1] >> level & 1) * 2 + (k[2] >> level & 1) == c] for c in range(8)]
        code.append(sum(1 << c for c in range(8) if parts[c]))
        for part in parts:
            if part:
                walk(part, level - 1)

    walk(keys, depth - 1)
    leaves = spark.createDataFrame([(*k, n) for n, k in enumerate(keys)], "kx long, ky long, kz long, v long").repartition(3)
    for block in (7, 1 << 16):
        blocks, values = G.octree_encode(leaves, depth, "v", block)
        assert b"".join(r.code for r in blocks.orderBy("block").collect()) == bytes(code)
        assert [keys[r.value] for r in values.orderBy("position").collect()] == order
        assert sorted(map(tuple, G.octree_decode(blocks, values, depth).collect())) == [(*k, n) for n, k in enumerate(keys)]
