"""Point sets as DataFrames: named columns, an explicit idx, and views over the sample tables.

A point is a row with x, y, z (doubles).  A missing point has NaN or infinite
coordinates.  An image-like (organized) cloud has row and col; idx is then
row * width + col.  Attributes are nx, ny, nz, curvature, intensity, label,
rgba (b, g, r, a from the low byte), range, and vx, vy, vz.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """The DataFrame itself, if it has the columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def is_finite(*columns: str) -> Column:
    """Whether all columns hold finite numbers; null counts as missing."""
    inf = float("inf")
    out = F.lit(True)
    for c in columns or XYZ:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < inf)
    return out


def finite(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(is_finite(*columns))


def dot(a: tuple, b: tuple) -> Column:
    """Of two triples of columns or numbers."""
    u, v = ([F.lit(k) if isinstance(k, (int, float)) else F.col(k) if isinstance(k, str) else k for k in t] for t in (a, b))
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def cross(a: tuple, b: tuple) -> tuple[Column, Column, Column]:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


@dataclass(frozen=True)
class Cloud:
    """A DataFrame of points and its width; a width of 1 is an unorganized cloud."""

    df: DataFrame
    width: int = 1

    def reshaped(self, width: int) -> Cloud:
        """The same points in order of idx with another width; row and col follow."""
        return Cloud(with_grid(self.df, width), width)

    def at(self, col: int, row: int) -> DataFrame:
        return self.df.where(F.col("idx") == row * self.width + col)

    def is_bounded(self) -> bool:
        """Whether every point is finite."""
        return self.df.where(~is_finite()).isEmpty()


def with_grid(df: DataFrame, width: int) -> DataFrame:
    return df.withColumn("row", F.expr(f"idx div {width}")).withColumn("col", F.col("idx") % width)


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, x, y, z, intensity, nx, ny, nz, label from the first seven dimensions of the embeddings."""
    e = [F.col("embedding")[k].cast("double") for k in range(7)]
    n = F.sqrt(e[4] * e[4] + e[5] * e[5] + e[6] * e[6])
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("idx"), e[0].alias("x"), e[1].alias("y"), e[2].alias("z"), e[3].alias("intensity"), (e[4] / n).alias("nx"), (e[5] / n).alias("ny"), (e[6] / n).alias("nz"), "label"
    )


EVENT_WIDTH = 100


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An organized cloud, 100 wide: idx, row, col, x = col, y = row, z = value."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("idx"), F.col("value").alias("z"))
    return with_grid(df, EVENT_WIDTH).select("idx", "row", "col", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"), "z")


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z of the line items; they have no key."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))
