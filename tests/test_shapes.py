"""Features, models, range images, files and streams on shapes whose answers are known."""

import math
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloudloom.operators import features as E
from cloudloom.operators import models as M
from cloudloom.operators import range_image as R
from cloudloom.operators import sac as S
from cloudloom.operators.points import rotation, transform, transform_normals
from cloudloom.plans import QUERIES
from cloudloom.sources import lzf, pcd
from cloudloom.streaming.voxels import voxel_stream

XYZ = "idx long, x double, y double, z double"
LOREM = b"Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. " * 3


def cloud(spark, rows, extra=""):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], XYZ + extra)


def sphere_points(n=200, centre=(1, 2, 3), radius=2):
    k = np.arange(n) + 0.5
    up, turn = np.arccos(1 - 2 * k / n), np.pi * (1 + 5**0.5) * k
    return [(float(centre[0] + radius * np.cos(t) * np.sin(u)), float(centre[1] + radius * np.sin(t) * np.sin(u)), float(centre[2] + radius * np.cos(u))) for u, t in zip(up, turn, strict=True)]


def test_normals_of_a_plane(spark):
    df = cloud(spark, [(float(i), float(j), 0.0) for i in range(10) for j in range(10)])
    for r in E.normal_estimation(df, 1.5, (0, 0, -1)).collect():
        assert (abs(r.nx) + abs(r.ny), r.nz, r.curvature) == pytest.approx((0, -1, 0), abs=1e-9)
    lonely = cloud(spark, [(0.0, 0.0, 0.0), (9.0, 0.0, 0.0)])
    assert {(r.nx, r.nz) for r in E.normal_estimation(lonely, 1.0).collect()} == {(0.0, 0.0)}


def test_boundary_of_a_plane(spark):
    df = cloud(spark, [(float(i), float(j), 0.0, 0.0, 0.0, 1.0) for i in range(6) for j in range(6)], ", nx double, ny double, nz double")
    edge = {r.idx for r in E.boundary(df, 1.1, math.pi * 0.9).where("is_boundary").collect()}
    assert edge == {i * 6 + j for i in range(6) for j in range(6) if {i, j} & {0, 5}}


def test_descriptors_do_not_turn_with_the_cloud(spark):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        n = rng.standard_normal(3)
        rows.append((*map(float, rng.random(3)), *map(float, n / np.linalg.norm(n)), float(rng.random())))
    df = cloud(spark, rows, ", nx double, ny double, nz double, intensity double")
    r = rotation((1, 2, 3), 0.7)
    turned = transform_normals(transform(df, [[*row, 0.5] for row in r]), r)

    def numbers(f, key):
        a, b = ({tuple(x[k] for k in key): x for x in f(d).collect()} for d in (df, turned))
        return a, b

    a, b = numbers(lambda d: E.moment_invariants(d, 0.4, True), ["idx"])
    for k in a:
        assert (a[k].j1, a[k].j2, a[k].j3) == pytest.approx((b[k].j1, b[k].j2, b[k].j3), abs=1e-9)
    a, b = numbers(lambda d: E.pfh_counts(d, 0.4, 3), ["idx", "bin"])
    assert a.keys() == b.keys() and all(abs(a[k].v - b[k].v) < 1e-9 for k in a)
    a, b = numbers(lambda d: E.normal_estimation(d, 0.4), ["idx"])
    assert all(abs(a[k].curvature - b[k].curvature) < 1e-9 for k in a)
    sums = E.fpfh(df, 0.4).select(F.aggregate("hist", F.lit(0.0), lambda s, v: s + v).alias("s")).collect()
    assert all(r.s == pytest.approx(300) for r in sums)


def test_intensity_slope(spark):
    df = cloud(spark, [(float(i), float(j), 0.0, 0.0, 0.0, 1.0, 3.0 * i - 2.0 * j) for i in range(5) for j in range(5)], ", nx double, ny double, nz double, intensity double")
    r = E.intensity_gradient(df, 1.6).where("idx = 12").first()
    assert (r.gx, r.gy, r.gz) == pytest.approx((3, -2, 0), abs=1e-9)


def test_global_descriptors(spark):
    df = cloud(spark, [(*p, *[(a - b) / 2 for a, b in zip(p, (1, 2, 3), strict=True)], 0xFF0000FF) for p in sphere_points()], ", nx double, ny double, nz double, rgba long")
    v = E.vfh(df, (5, 5, 5, 5), 8, (0.0, 0.0, 10.0)).first().hist
    assert len(v) == 28 and sum(v[:5]) == pytest.approx(sum(v[5:10]))
    c = E.crh(df, (1.0, 2.0, 3.0)).first().hist
    assert len(c) == 90 and c[0] == pytest.approx(1.0)
    for kind in ("none", "trilinear", "quadrilinear"):
        total = E.gasd(df, interpolation=kind).agg(F.sum("v")).first()[0]
        assert total == pytest.approx(100 * 200 / 199)
    assert {r.bin for r in E.gasd_color(df).select("bin").distinct().collect()} == {8}


def test_consensus_on_a_line(spark):
    rows = [(0, 0, 0), (1, 1, 1), (2, 2, 3), (-1, 4, -2), (5, 5, 4), (8, 4, 3), (15, 13, 14), (-7, 6, 7)]
    _, inliers = S.consensus(cloud(spark, [tuple(map(float, r)) for r in rows]), "line", 1.0)
    assert sorted(r.idx for r in inliers.collect()) == [0, 1, 2, 4, 6]


def test_consensus_on_a_sphere(spark):
    noise = [(float(i), float(-i), 9.0) for i in range(20)]
    model, inliers = S.consensus(cloud(spark, sphere_points() + noise), "sphere", 0.01)
    assert model.centre == pytest.approx((1, 2, 3), abs=1e-6) and model.radius == pytest.approx(2, abs=1e-6)
    assert inliers.count() == 200
    assert S.consensus(cloud(spark, [(0.0, 0.0, 0.0)]), "plane", 1.0) == (None, None)


def test_projections_lie_on_their_models(spark):
    circle = M.Circle((0.5, 0.0, 0.0), (0.0, 0.0, 1.0), 1.0)
    models = [M.Plane((1.0, 0.0, 0.0), (1.0, 1.0, 0.0)), M.Line((0.0, 0.0, 0.0), (1.0, 0.0, 0.0)), M.Stick((0.0, 0.0, 0.0), (1.0, 0.0, 0.0)), circle, M.Sphere((0.0, 0.0, 0.0), 2.0), M.Cylinder(circle, 2.0), M.Cone(circle, 2.0)]
    df = cloud(spark, [(3.0, 2.0, 0.0), (-1.0, 0.2, 3.0), (0.5, 0.0, 0.7), (0.1, 0.1, -2.0), (2.0, -2.0, 1.0)])
    points = np.array([tuple(r)[1:] for r in df.orderBy("idx").collect()])
    for model in models:
        q = S.inlier_projection(df, None, model)
        assert all(abs(r.d) < 1e-9 for r in q.select(model.distance(M.xyz()).alias("d")).collect()), model
        moved = {r.idx: np.array([r.x, r.y, r.z]) for r in q.collect()}
        d = [r.d for r in df.orderBy("idx").select(model.distance(M.xyz()).alias("d")).collect()]
        assert d == pytest.approx(S.numeric_distance(model, points).tolist(), abs=1e-9)
        assert [np.linalg.norm(moved[i] - p) for i, p in enumerate(points)] == pytest.approx(d, abs=1e-9), model
    foot = S.inlier_projection(df, df.where("idx = 0"), models[1]).first()
    assert (foot.x, foot.y, foot.z) == (3.0, 0.0, 0.0)


def test_fits():
    p = np.array([[1.0, 0, 0], [0, 1, 0], [-1, 0, 0], [0.5, 0, 2]])
    assert M.fit_circle(p[:3])[0].centre == pytest.approx((0, 0, 0))
    s = M.fit_sphere(np.array(sphere_points(8)[:4]))[0]
    assert s.centre == pytest.approx((1, 2, 3)) and s.radius == pytest.approx(2)
    assert any(c.height == pytest.approx(2) and c.circle.radius == pytest.approx(1) for c in M.fit_cylinder(p))
    assert any(c.height == pytest.approx(4) for c in M.fit_cone(p))
    assert M.fit_plane(p[:1], normal=(0, 0, 2))[0].normal == (0, 0, 1)
    assert M.fit_plane(np.zeros((3, 3))) == []
    assert M.fit_line(p[:1], direction=(1, 0, 0))[0].direction == (1, 0, 0)


def test_range_image_of_a_wall(spark):
    view = R.View((math.radians(2), math.radians(2)))
    pixels = spark.range(40, 60).select(F.col("id").alias("row")).crossJoin(spark.range(80, 100).select(F.col("id").alias("col")))
    df = pixels.withColumns(view.point(F.col("row"), F.col("col"), F.lit(5.0))).withColumn("idx", F.col("row") * 1000 + F.col("col"))
    image = R.zbuffer(df, view)
    assert image.count() == 400
    assert image.agg(F.max(F.abs(F.col("range") - 5))).first()[0] < 1e-9
    assert R.downsample(image, 10).count() == 4
    assert R.range_difference(df, image, view).agg(F.max(F.abs("diff"))).first()[0] < 1e-9
    full = R.all_pixels(image, 90, 180)
    assert full.where("range = double('-inf')").count() == 90 * 180 - 400
    far = R.integrate_far_ranges(full, spark.createDataFrame([(0.0, 5.0, -100.0)], "x double, y double, z double"), view)
    assert far.where("range = double('inf')").count() == 1
    assert R.within_sphere(df, view, (0.0, 0.0, 5.0), 0.5).count() < 400
    assert R.centroid_along(image, (0, 1), 3).where("row = 40 and col = 99").first().n == 1


def test_border_of_a_box_before_a_wall(spark):
    view = R.View((math.radians(1), math.radians(1)), (170, 80))
    grid = spark.range(400).select(F.col("id").alias("idx"), F.expr("id div 20").alias("row"), (F.col("id") % 20).alias("col"))
    near = F.col("row").between(6, 13) & F.col("col").between(6, 13)
    df = grid.withColumn("range", F.when(near, 2.0).otherwise(6.0)).withColumn("range", F.col("range").cast("double"))
    df = df.withColumns(view.point(F.col("row"), F.col("col"), F.col("range")))
    got = {(r.row, r.col): r.border_traits for r in R.border(df).collect()}
    assert got[9, 13] >> R.SHIFT["right"] & R.OBSTACLE
    assert got[9, 6] >> R.SHIFT["left"] & R.OBSTACLE
    assert got[9, 14] >> R.SHIFT["right"] & R.SHADOW
    assert got[2, 2] == 0


def test_surface_normals_face_the_sensor(spark):
    view = R.View((math.radians(1), math.radians(1)), (170, 80))
    grid = spark.range(100).select(F.col("id").alias("idx"), F.expr("id div 10").alias("row"), (F.col("id") % 10).alias("col"), F.lit(5.0).alias("range"))
    df = grid.withColumns(view.point(F.col("row"), F.col("col"), F.col("range")))
    r = R.surface_info(df, 1, 9).join(df, "idx").where("idx = 55").first()
    assert -(r.nx * r.x + r.ny * r.y + r.nz * r.z) / 5 > 0.99


def test_event_images_hold_the_whole_grid(spark):
    sf = "/root/testdata/sf0.01"
    assert {r.row for r in QUERIES["pair_impact_angles"](spark, sf).select("row").distinct().collect()} == set(range(100))
    for name in ("surface_info", "border_traits"):
        assert QUERIES[name](spark, sf).select("idx").distinct().count() == 10_000


def test_narf_describes_every_point(spark, sf_dir):
    assert QUERIES["narf"](spark, sf_dir).select("idx").distinct().count() == 500


def test_narf_is_flat_on_a_plane(spark):
    df = cloud(spark, [(i / 10, j / 10, 0.0) for i in range(40) for j in range(40)])
    keys = spark.createDataFrame([(820, 2.0, 2.0, 0.0, 0.0, 0.0, 1.0)], XYZ + ", nx double, ny double, nz double")
    r = R.narf(df, keys, 1.0, 8, rotate=False).first()
    assert len(r.descriptor) == 36 and max(map(abs, r.descriptor)) < 1e-9


def test_triangles_of_a_tilted_plane(spark):
    df = cloud(spark, [(i / 10, j / 10, 0.5 * i / 10) for j in range(40) for i in range(40)]).withColumn("row", F.expr("idx div 40")).withColumn("col", F.col("idx") % 40)
    assert R.triangles(df).count() == 2 * 39 * 39
    keys = spark.createDataFrame([(820, 2.0, 2.0, 1.0, 0.0, 0.0, 1.0)], XYZ + ", nx double, ny double, nz double")
    patch = np.array(R.project_triangles(df, keys, 1.0, 8).first().patch).reshape(8, 8)[1:-1, 1:-1]
    slope = np.abs(np.diff(patch, axis=0)).max(), np.abs(np.diff(patch, axis=1)).max()
    assert sorted(slope) == pytest.approx([0, 0.5 / 8], abs=1e-9)
    flat = R.narf(df.withColumn("z", F.lit(1.0)), keys, 1.0, 8, rotate=False, image=True).first()
    assert len(flat.descriptor) == 36 and max(map(abs, flat.descriptor)) < 1e-9


def test_rotated_patches_have_the_same_descriptor():
    i, j = np.mgrid[:16, :16]
    patch = np.sin(i / 6) * 0.1 + np.cos(j / 9) * 0.07 + i * j / 4000
    turned = np.rot90(patch, -1)
    a, b = R.star(patch, 36, 1.0), R.star(turned, 36, 1.0)
    found = [R.dominant_rotations(x) for x in (a, b)]
    assert len(found[0]) == len(found[1])
    shifts = {round(math.degrees((y - x) % (2 * math.pi))) for x, y in zip(*found, strict=True)}
    assert all(min(abs(s - 90), abs(s - 270)) <= 15 for s in shifts)  # a beam's steps fall on whole pixels
    for x, y in zip(*found, strict=True):
        assert np.abs(R.star(patch, 36, 1.0, x) - R.star(turned, 36, 1.0, y)).mean() < 0.1
    peaks = np.zeros(36)
    peaks[[0, 9, 20]] = [1.0, 0.99, 0.98]
    angles = R.dominant_rotations(peaks)
    assert all(abs((p - q + math.pi) % (2 * math.pi) - math.pi) >= math.radians(70) - 1e-9 for i, p in enumerate(angles) for q in angles[:i])


def test_pedal_points_lie_on_the_plane(spark):
    view = R.View((math.radians(1), math.radians(1)), (170, 80))
    grid = spark.range(100).select(F.col("id").alias("idx"), F.expr("id div 10").alias("row"), (F.col("id") % 10).alias("col"))
    ray = grid.withColumns(view.point(F.col("row"), F.col("col"), F.lit(1.0)))
    df = ray.withColumns({c: F.col(c) * 4 / F.col("z") for c in "xyz"})  # the wall z = 4
    info = R.surface_info(df, 2, 9, all_neighbors=True).collect()
    assert all(abs(abs(r.nz) - 1) < 1e-6 and abs(abs(r.all_nz) - 1) < 1e-6 and r.nz < 0 for r in info)
    for r in R.normal_within(df, 2, 15).join(df, "idx").collect():
        assert (r.px, r.py, r.pz) == pytest.approx((r.x, r.y, 4.0), abs=1e-6)


def test_bounds_of_spheres_hold_their_points(spark):
    view = R.View((math.radians(1), math.radians(1)), (3, 5))
    r = np.random.default_rng(1)
    for centre, radius in (((1.0, 0.5, 4.0), 1.0), ((-3.0, 2.0, 1.0), 0.7), ((0.5, -1.0, -2.0), 1.0)):
        d = r.normal(size=(4000, 3))
        at = np.asarray(centre) + radius * d / np.linalg.norm(d, axis=1, keepdims=True)
        got = cloud(spark, [tuple(map(float, p)) for p in at]).withColumns(view.pixel()).agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
        rows, cols = R.sphere_bounds(view, centre, radius)
        assert rows[0] <= got[0] <= rows[0] + 2 and rows[1] - 2 <= got[1] <= rows[1]
        assert cols[0] <= got[2] and got[3] <= cols[1]


def test_models_with_constraints(spark):
    rows = [(float(i), float(j), 1.0) for i in range(10) for j in range(10)] + [(float(i), 3.0, float(k)) for i in range(3) for k in range(2, 12)]
    df = cloud(spark, rows)
    model, inliers = S.consensus(df, "perpendicular plane", 0.01, constraint=(0, 0, 5))
    assert inliers.count() == 103 - 3 and model.centre[2] == 1.0
    model, inliers = S.consensus(df, "parallel plane", 0.01, constraint=(0, 0, 1))
    assert abs(model.normal[2]) < 1e-12 and inliers.count() == max(30 + 10, 10)
    model, inliers = S.consensus(df, "parallel line", 0.01, constraint=(0, 0, 2))
    assert inliers.count() == 11
    with pytest.raises(ValueError, match="takes a direction"):
        S.consensus(df, "parallel line", 0.01)


def test_ratio_test_drops_bad_hypotheses():
    r = np.random.default_rng(0)
    good, bad = r.random((200, 256)) < 0.7, r.random((200, 256)) < 0.1
    assert S.unlikely(good, 0.7, 0.1, 1e3).mean() < 0.01 and S.unlikely(bad, 0.7, 0.1, 1e3).mean() > 0.99
    slow = []
    for row in np.concatenate([good[:20], bad[:20]]):
        ratio, out = 1.0, False
        for x in row:
            ratio *= 0.1 / 0.7 if x else 0.9 / 0.3
            out |= ratio > 1e3
        slow.append(out)
    assert slow == S.unlikely(np.concatenate([good[:20], bad[:20]]), 0.7, 0.1, 1e3).tolist()


# --- files and streams ---------------------------------------------------------------


def test_lzf_round_trips():
    packed = lzf.compress(LOREM)
    assert len(packed) < len(LOREM) and lzf.decompress(packed, len(LOREM)) == LOREM
    for data in (b"a" * 1000, bytes(range(256)) * 9, b"ab" * 5000 + b"x" * 300):
        assert lzf.decompress(lzf.compress(data), len(data)) == data


def test_lzf_errors():
    with pytest.raises(lzf.NoCompressionPossible):
        lzf.compress(b"foo")
    with pytest.raises(lzf.BufferTooSmall):
        lzf.decompress(lzf.compress(LOREM), 10)
    with pytest.raises(lzf.DataCorrupted):
        lzf.decompress(LOREM, 1000)
    out = lzf.decompress(bytes([1, 97, 97, 224, 187, 0, 1, 97, 97]), 200)
    assert (len(out), out[0], out[-1]) == (200, 97, 97)


@pytest.mark.parametrize("data", pcd.KINDS)
def test_pcd_round_trip(data):
    columns = {"x": [2.0] * 4, "y": [3.0] * 4, "z": [4.0] * 4, "nx": [-1.0] * 4, "ny": [-2.0] * 4, "nz": [-3.0] * 4, "curvature": [0.5] * 4, "label": [0xABCD] * 4}
    blob = pcd.pack({k: np.array(v) for k, v in columns.items()}, 2, data)
    head, got = pcd.decode(blob)
    assert (head.width, head.height) == (2, 2)
    back = pcd.point_columns(head, got, list(columns))
    assert {k: v.tolist() for k, v in back.items()} == columns
    assert pcd.encode(head, got) == blob


def test_pcd_headers():
    head, at = pcd.parse_header(b"# by hand\nVERSION .7\nFIELDS label rgb x\nSIZE 4 4 4\nTYPE U F F\nCOUNT 1 1 1\nWIDTH 1\nHEIGHT 1\nODD thing\nPOINTS 1\nDATA binary\n")
    blob = head.text().encode() + struct.pack("<IIf", 7, 0xFF010203, 1.5)
    _, got = pcd.decode(blob)
    back = pcd.point_columns(head, got, ["x", "y", "rgba", "label"])
    assert [v.tolist() for v in back.values()] == [[1.5], [0.0], [0xFF010203], [7]]
    for bad in (b"FIELDS x\n", b"FIELDS\nDATA ascii\n", b"FIELDS x\nSIZE 4\nWIDTH 2\nHEIGHT 1\nPOINTS 3\nDATA ascii\n"):
        with pytest.raises(pcd.PcdError):
            pcd.parse_header(bad)
    with pytest.raises(pcd.PcdError):
        pcd.point_columns(pcd.Header([pcd.Field("rgb"), pcd.Field("rgba")], 0, 1), {"rgb": np.zeros((0, 1)), "rgba": np.zeros((0, 1))}, ["rgba"])


def test_pcd_as_a_spark_source(spark, tmp_path):
    pcd.register(spark)
    df = cloud(spark, [(float(i), 0.5, -1.0) for i in range(50)])
    pcd.write_pcd(df.repartition(3), str(tmp_path / "cloud"), "binary_compressed", width=10, single=True)
    back = spark.read.format("pcd").option("columns", "x,y,z").load(str(tmp_path / "cloud"))
    assert [r.x for r in back.orderBy("idx").collect()] == [float(i) for i in range(50)]
    assert pcd.read_pcd(spark, str(tmp_path / "cloud")).where("row = 4 and col = 9").first().x == 49.0


def test_voxels_of_a_stream(spark, tmp_path):
    df = cloud(spark, [(i / 10, 0.0, 0.0) for i in range(20)])
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = voxel_stream(stream, (1.0, 1.0, 1.0)).writeStream.outputMode("complete").format("memory").queryName("voxels").start()
    try:
        q.processAllAvailable()
        assert sorted((r.kx, r.n) for r in spark.table("voxels").collect()) == [(0, 10), (1, 10)]
    finally:
        q.stop()


def plane(spark):
    return spark.range(100).select(F.col("id").alias("idx"), (F.col("id") % 10).cast("double").alias("x"), F.floor(F.col("id") / 10).cast("double").alias("y"), F.lit(0.0).alias("z"))


def test_pcd_overwrite_and_append(spark, tmp_path):
    pcd.register(spark)
    path = str(tmp_path / "cloud")
    df = plane(spark)
    pcd.write_pcd(df, path)
    pcd.write_pcd(df.where("idx < 10"), path)
    assert pcd.read_pcd(spark, path).count() == 110
    pcd.write_pcd(df.where("idx < 7"), path, "ascii", mode="overwrite", viewpoint=(1, 2, 3, 0, 0, 0, 1))
    assert pcd.read_pcd(spark, path).count() == 7 and not [f for f in os.listdir(path) if not f.endswith(".pcd") and not f.endswith(".crc")]
    heads = pcd.read_headers(spark, path).collect()
    assert sum(h.points for h in heads) == 7 and all(list(h.viewpoint) == [1, 2, 3, 0, 0, 0, 1] and h.data == "ascii" for h in heads)


def test_pcd_files_of_a_failed_job_are_no_points(spark, tmp_path):
    pcd.register(spark)
    path = str(tmp_path / "cloud")
    df = plane(spark).repartition(4)
    pcd.write_pcd(df, path)

    def fail(batches):
        from pyspark import TaskContext

        for batch in batches:
            if TaskContext.get().partitionId() == 3:
                raise RuntimeError("a lost executor")
            yield batch

    broken = df.select("x", "y", "z").repartition(4).mapInArrow(fail, "x double, y double, z double")
    with pytest.raises(Exception, match="lost executor"):
        broken.write.format("pcd").mode("overwrite").save(path)
    # A task that ends after the abort may leave its folder, which no reader looks into.
    assert pcd.read_pcd(spark, path).count() == 100 == spark.read.format("pcd").load(path).count()


@pytest.mark.parametrize("data", pcd.KINDS)
def test_pcd_types_and_orders_of_fields(data):
    fields = [pcd.Field("label", "U", 1), pcd.Field("z", "F", 8), pcd.Field("normal", "F", 4, 3), pcd.Field("x", "I", 2), pcd.Field("count", "U", 8), pcd.Field("y", "F", 4)]
    columns = {"label": [3, 255], "z": [1.5, -2.25], "normal": [[0, 0, 1], [1, 0, 0]], "x": [-7, 300], "count": [2**63 + 5, 1], "y": [0.25, float("nan")]}
    head = pcd.Header(fields, 2, 1, (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0), data)
    blob = pcd.encode(head, {k: np.array(v) for k, v in columns.items()})
    again, got = pcd.decode(blob)
    assert again.viewpoint == head.viewpoint and [f.name for f in again.fields] == list(columns)
    for k, v in columns.items():
        assert np.array_equal(got[k].reshape(np.array(v).shape), np.array(v).astype(got[k].dtype), equal_nan=k == "y"), k
    points = pcd.point_columns(again, got, ["x", "z", "nz", "label", "intensity"])
    assert points["x"].tolist() == [-7, 300] and points["nz"].tolist() == [1, 0] and points["label"].tolist() == [3, 255] and points["intensity"].tolist() == [0, 0]


def test_least_axis_and_solution_of_all_ranks(spark):
    """Closed forms against numpy: random matrices, and ones with equal or vanishing eigenvalues."""
    from cloudloom.functions.linalg import ENTRIES, least_axis, solution

    r = np.random.default_rng(3)
    spectra = [*(10.0 ** r.uniform(-3, 3, (60, 3))), *([0, 0, 0], [1, 1, 1], [2, 1, 1], [2, 2, 1], [5, 0, 0], [5, 3, 0], [1, 1, 0], [1e-200, 2e-200, 3e-200])]
    matrices = []
    for d in spectra:
        q = np.linalg.qr(r.standard_normal((3, 3)))[0]
        matrices += [np.diag(d).astype(float), (q * np.asarray(d, float)) @ q.T]
    right = r.standard_normal((len(matrices), 3))
    rows = [(i, *(float(m["xyz".index(a), "xyz".index(b)]) for a, b in ENTRIES), *map(float, v)) for i, (m, v) in enumerate(zip(matrices, right, strict=True))]
    df = spark.createDataFrame([*rows, (-1, None, *[1.0] * 8)], "i long, " + ", ".join(f"{n} double" for n in (*ENTRIES, "bx", "by", "bz")))
    found = df.select("i", least_axis(list(ENTRIES)).alias("e"), solution(list(ENTRIES), ["bx", "by", "bz"]).alias("s")).where("i < 0 or e.nx is not null").collect()
    assert len(found) == len(rows) + 1
    for o in found:
        if o.i < 0:
            assert o.e is None and o.s is None
            continue
        m, b = matrices[o.i], right[o.i]
        w, v = np.linalg.eigh(m)
        n, most = np.array([o.e.nx, o.e.ny, o.e.nz]), max(np.abs(w).max(), 1e-300)
        assert n @ n == pytest.approx(1) and np.abs(m @ n - o.e.l3 * n).max() <= 1e-7 * most and n[np.abs(n).argmax()] > 0
        assert np.abs(np.array([o.e.l3, o.e.l2, o.e.l1]) - w).max() <= 1e-7 * most
        kept = np.abs(w) > 1e-9 * most
        want = v @ np.where(kept, (v.T @ b) / np.where(kept, w, 1), 0)
        assert [o.s.x, o.s.y, o.s.z] == pytest.approx(want.tolist(), rel=1e-4, abs=1e-4 * np.abs(want).max())


@pytest.mark.parametrize("data", pcd.KINDS)
def test_pcd_in_splits(spark, tmp_path, data):
    """Splits give what the whole file gives, of the columns asked for."""
    r = np.random.default_rng(6)
    columns = {"x": r.standard_normal(700).astype("f4"), "y": np.zeros(700), "z": np.arange(700.0), "label": r.integers(0, 9, 700), "nx": np.ones(700), "ny": np.zeros(700), "nz": np.arange(700) % 3}
    for k in range(2):
        (tmp_path / f"{k}.pcd").write_bytes(pcd.pack(columns, 100, data))
    for split in (1, 999, 1 << 20):
        if split > 1 or data == "binary":
            back = pcd.read_pcd(spark, str(tmp_path), ["z", "label", "nz", "intensity"], viewpoint=True, split=split)
            assert back.rdd.getNumPartitions() == (2 if data == "ascii" else {1: 1400, 999: 2 * -(-700 // (999 // 28)), 1 << 20: 2}[split])
            rows = sorted(map(tuple, back.collect()))
            assert [r[1:7] + r[7:8] for r in rows] == [(i, i // 100, i % 100, float(i), int(columns["label"][i]), float(i % 3), 0.0) for _ in range(2) for i in range(700)]
            assert rows[0][-1] == [0.0] * 6 + [1.0] and len({r[0] for r in rows}) == 2
    whole = (tmp_path / "0.pcd").read_bytes()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "c.pcd").write_bytes(whole[:-40])
    with pytest.raises(Exception, match="points are missing|end early|cut off"):
        pcd.read_pcd(spark, str(tmp_path / "cut"), ["x", "nz"]).collect()
    assert spark.read.format("pcd").option("columns", "curvature").load(str(tmp_path)).selectExpr("sum(curvature)", "count(idx)").first()[:] == (0.0, 1400)


def test_pcd_bounds_leave_splits_out(spark, tmp_path):
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    (tmp_path / "a.pcd").write_bytes(pcd.pack({"x": np.arange(100.0)}, None, "binary"))
    reader = pcd._BoundedReader(str(tmp_path), ["idx", "x"], 40)
    bounds = [GreaterThanOrEqual(("idx",), 25), LessThan(("idx",), 41)]
    assert list(reader.pushFilters(bounds)) == bounds
    assert [(p.first, p.last) for p in reader.partitions()] == [(20, 30), (30, 40), (40, 50)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = pcd.read_pcd(spark, str(tmp_path), ["x"], split=40).where("idx >= 25 and idx < 41")
        assert some.rdd.getNumPartitions() == 3 and sorted(r.x for r in some.collect()) == [float(k) for k in range(25, 41)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_lzf_in_pieces():
    import io

    r = np.random.default_rng(2)
    for raw in (b"", b"a" * 70_000, bytes(r.integers(0, 4, 60_000, np.uint8)), b"lorem ipsum " * 3_000 + bytes(r.integers(0, 256, 500, np.uint8)) + b"lorem" * 9_000):
        try:
            packed = lzf.compress(raw)
        except lzf.NoCompressionPossible:
            continue
        for chunk in (40, 5_000, 1 << 18):
            assert b"".join(lzf.stream(io.BytesIO(packed).read, len(packed), chunk)) == raw
        with pytest.raises(lzf.DataCorrupted):
            list(lzf.stream(io.BytesIO(packed[:-1]).read, len(packed)))
    with pytest.raises(lzf.DataCorrupted):
        list(lzf.stream(io.BytesIO(b"\xe0\x00\x05").read, 3))


def test_octree_levels_of_a_stream(spark, sf_dir, tmp_path):
    """Micro-batches, late points and a new start from the checkpoint give what the whole cloud gives."""
    from cloudloom.cloud import embedding_points
    from cloudloom.operators.aggregates import finite_bound
    from cloudloom.operators.grid import octree_centroids
    from cloudloom.streaming.voxels import octree_stream

    p = embedding_points(spark, sf_dir).select("idx", "x", "y", "z")
    b = finite_bound(p).first()
    want = {tuple(r[:4]): (r.x, r.y, r.z, r.n) for r in octree_centroids(p, 0.05, 3).collect()}
    got = {}

    def keep(batch, _):
        got.update({tuple(r[:4]): (r.x, r.y, r.z, r.n) for r in batch.collect()})

    for k in range(3):
        p.where(F.col("idx") % 3 == 2 - k).coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        levels = octree_stream(spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 0.05, 3, (b.min_x, b.min_y, b.min_z))
        q = levels.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(240)
    assert got.keys() == want.keys()
    for key, row in want.items():
        assert got[key] == pytest.approx(row, abs=1e-9)


def test_each_pair_of_a_histogram_is_worked_out_once(spark):
    r = np.random.default_rng(7)
    at = r.random((60, 3))
    n = r.standard_normal((60, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    df = spark.createDataFrame([(i, *map(float, (*p, *q))) for i, (p, q) in enumerate(zip(at, n, strict=True))], "idx long, x double, y double, z double, nx double, ny double, nz double").repartition(3)
    found = E.linked_pairs(df, 0.4, 3).collect()
    near = [set(np.flatnonzero(((at - p) ** 2).sum(1) <= 0.16)) for p in at]
    want = {(i, j): near[i] & near[j] for i in range(60) for j in range(i + 1, 60) if near[i] & near[j]}
    assert len(found) == len(want) and {(r.i, r.j): set(r.near) for r in found} == want


def test_user_accumulators(spark, monkeypatch):
    from cloudloom.operators import filters as L

    r = np.random.default_rng(9)
    at = np.round(r.random((200, 3)), 3)
    df = spark.createDataFrame([(i, *map(float, p), float(i % 7)) for i, p in enumerate(at)], "idx long, x double, y double, z double, intensity double").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {r.idx: (r["mean"], r.n) for r in L.dynamic_kernel(df, 0.25, L.TrimmedMean("intensity"), ("intensity",)).collect()}
        assert L.dynamic_kernel(df.where("idx < 0"), 0.25, L.TrimmedMean("z")).collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 200
    for i, p in enumerate(at):
        v = sorted(j % 7 for j in np.flatnonzero(((at - p) ** 2).sum(1) <= 0.0625))
        assert got[i] == (pytest.approx(np.mean(v[1:-1] if len(v) > 2 else v)), len(v))


def test_organized_knn_finds_what_the_octree_finds(spark):
    from cloudloom.operators import neighbors as N

    r = np.random.default_rng(1)
    rows = [(i * 20 + j, i, j, float(d * (j - 9.5) / 15), float(d * (i - 9.5) / 15), float(d)) for i in range(20) for j in range(20) for d in [2 + 3 * r.random()] if (i + j) % 5]
    rows += [(900, 0, 5, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "idx long, row long, col long, x double, y double, z double")
    asked = spark.createDataFrame([(1, 0.0, 0.0, 3.0), (2, 0.0, 0.0, 0.0), (3, 40.0, 1.0, 2.0), (4, -0.5, 0.3, 2.5)], "qidx long, qx double, qy double, qz double").union(N.as_queries(df).where("qidx % 9 = 0"))
    for k in (1, 5):
        want = sorted(map(tuple, N.knn_search(df, k, asked).collect()))
        assert sorted(map(tuple, N.organized_knn(df, k, 1e-6, asked).collect())) == want
    assert N.organized_fit(df, 1e-6) is not None
    assert sorted(map(tuple, N.search(df, k=5, queries=asked).collect())) == want
    loose = df.withColumn("col", F.col("idx") % 7)
    assert sorted(map(tuple, N.search(loose, k=5, queries=asked).collect())) == want
    assert N.search(df.drop("row", "col"), radius=0.3).count() == N.search(df, radius=0.3).count() == N.radius_search(df, 0.3).count()
    with pytest.raises(ValueError):
        N.search(df)


@pytest.mark.parametrize("data", pcd.KINDS)
def test_pcd_files_are_written_in_pieces(spark, tmp_path, data):
    """Many batches of a task make the file that one array makes; nothing else stays."""
    pcd.register(spark)
    r = np.random.default_rng(5)
    columns = {"x": r.standard_normal(300), "z": np.repeat(np.arange(3.0), 100), "label": np.arange(300) % 4, "nx": np.zeros(300), "ny": np.ones(300), "nz": r.random(300)}
    rows = [(i, *(c[i].item() for c in columns.values())) for i in range(300)]
    df = spark.createDataFrame(rows, "idx long, x double, z double, label long, nx double, ny double, nz double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "41")
    try:
        pcd.write_pcd(df.repartition(2), str(tmp_path / "out"), data, width=100, single=True)
        pcd.write_pcd(df.where("idx < 0"), str(tmp_path / "none"), data, single=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    (name,) = [f for f in os.listdir(tmp_path / "out") if not f.endswith(".crc")]
    head, got = pcd.decode((tmp_path / "out" / name).read_bytes())
    want = pcd.decode(pcd.pack(columns, 100, data))
    assert head == want[0] and all(np.array_equal(got[f], v) for f, v in want[1].items())
    assert pcd.read_pcd(spark, str(tmp_path / "none"), ["x"]).collect() == []
    noise = bytes(r.integers(0, 256, 5_000, np.uint8))
    assert lzf.decompress(lzf.shorter(noise) + lzf.shorter(b"a" * 999), 5_999) == noise + b"a" * 999
