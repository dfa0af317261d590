"""Voxel and octree centroids of a stream of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..cloud import finite


def voxel_stream(points: DataFrame, unit: tuple[float, float, float], origin: tuple[float, float, float] = (0.0, 0.0, 0.0), time: str | None = None, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """kx, ky, kz, x, y, z, n of voxels that start at a fixed origin: a least coordinate is not known while points arrive.

    Without a time column the state has a row for each voxel and the query runs
    in update or complete mode.  With one, voxels are counted in windows of it,
    and state is dropped once the watermark has passed a window.
    """
    keys = [F.floor((F.col(c) - o) / u).alias(f"k{c}") for c, o, u in zip("xyz", origin, unit, strict=True)]
    df = finite(points)
    if time is not None:
        df = df.withWatermark(time, late)
        keys = [F.window(time, window).alias("window"), *keys]
    return df.groupBy(*keys).agg(*(F.avg(c).alias(c) for c in "xyz"), F.count("*").alias("n"))


def octree_stream(points: DataFrame, resolution: float, levels: int, origin: tuple[float, float, float]) -> DataFrame:
    """level, kx, ky, kz, x, y, z, n of the leaves (level 0) that a stream's points are in and of their ancestors up to `levels` above, as octree_centroids.

    A point that comes is added to its cell of each level; a cell's state is its sums
    and number of points, so points may come in any order and however late, and a
    query that starts again goes on with the sums of its checkpoint.  The origin is the tree's lower
    corner, which is not known while points arrive; run it in update or complete mode.
    """
    level = F.explode(F.sequence(F.lit(0), F.lit(levels)))
    keys = {f"k{c}": F.floor((F.col(c) - float(o)) / float(resolution)) for c, o in zip("xyz", origin, strict=True)}
    cells = finite(points).withColumns(keys).withColumn("level", level).withColumns({k: F.expr(f"shiftright({k}, level)") for k in keys})
    return cells.groupBy("level", *keys).agg(*((F.sum(c) / F.count("*")).alias(c) for c in "xyz"), F.count("*").alias("n"))


def start(voxels: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes finished windows to Parquet, once each."""
    return voxels.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
