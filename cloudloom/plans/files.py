"""Queries: files and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..cloud import embedding_points
from ..operators.store import shared_folder
from ..sources import pcd
from .registry import EMB, query


def _roundtrip(spark, sf_dir, data: str):
    pcd.register(spark)
    path = f"{shared_folder(spark)}/pcd-{uuid.uuid4().hex}"
    p = embedding_points(spark, sf_dir).select("idx", "x", "y", "z", "nx", "ny", "nz", "intensity", F.col("label").cast("long").alias("label"))
    pcd.write_pcd(p.drop("idx").withColumn("idx", F.col("label")).select("x", "y", "z", "nx", "ny", "nz", "intensity", "label", "idx"), path, data)
    return pcd.read_pcd(spark, path, ["x", "y", "z", "nx", "ny", "nz", "intensity", "label"]).select(*(F.col(c).cast("float").alias(c) for c in ("x", "y", "z", "nx", "ny", "nz", "intensity")), "label")


_SQL = f"{EMB} SELECT {', '.join(f'{c}::FLOAT AS {c}' for c in ('x', 'y', 'z', 'nx', 'ny', 'nz', 'intensity'))}, label::BIGINT AS label FROM p"


@query(_SQL)
def pcd_roundtrip(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "binary_compressed")


@query(_SQL)
def pcd_roundtrip_binary(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "binary")


@query(_SQL)
def pcd_roundtrip_ascii(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "ascii")


@query(
    f"""{EMB}, k AS (SELECT *, label % 2 = 0 AS even FROM p)
SELECT idx, {', '.join(f'{c}::FLOAT AS {c}' for c in ('x', 'y', 'z'))}, [1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0]::DOUBLE[] AS viewpoint FROM k WHERE even"""
)
def pcd_overwrite(spark, sf_dir):
    """All points written, then half of them in their place, with a viewpoint; idx goes along as a label."""
    pcd.register(spark)
    path = f"{shared_folder(spark)}/pcd-{uuid.uuid4().hex}"
    p = embedding_points(spark, sf_dir).select("idx", "x", "y", "z", F.col("idx").alias("label"), (F.col("label") % 2 == 0).alias("even"))
    pcd.write_pcd(p.drop("even"), path)
    pcd.write_pcd(p.where("even").drop("even"), path, "ascii", mode="overwrite", viewpoint=(1, 2, 3, 0, 0, 0, 1))
    back = pcd.read_pcd(spark, path, ["x", "y", "z", "label"], viewpoint=True)
    return back.select(F.col("label").alias("idx"), *(F.col(c).cast("float").alias(c) for c in ("x", "y", "z")), "viewpoint")


@query(f"""{EMB}, n AS (SELECT *, row_number() OVER (ORDER BY idx) - 1 AS pos FROM p) SELECT idx, {', '.join(f'{c}::FLOAT AS {c}' for c in 'xyz')}, (pos // 62)::INTEGER AS part FROM n WHERE pos >= 100""")
def pcd_split_read(spark, sf_dir):
    """One file of all points, read by a task for each 62 of them (992 bytes)."""
    pcd.register(spark)
    path = f"{shared_folder(spark)}/pcd-{uuid.uuid4().hex}"
    p = embedding_points(spark, sf_dir).select("idx", "x", "y", "z", F.col("idx").alias("label"))
    pcd.write_pcd(p, path, single=True)
    back = pcd.read_pcd(spark, path, ["x", "y", "z", "label"], split=1_000)
    return back.select(F.col("idx").alias("at"), F.col("label").alias("idx"), *(F.col(c).cast("float").alias(c) for c in "xyz"), F.spark_partition_id().alias("part")).where("at >= 100").drop("at")
