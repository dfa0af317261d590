"""Intermediate tables that outlive executors, and connected components over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import saved, shared_folder, stored
from .kernel import fresh

__all__ = ["components", "is_small", "partitions", "saved", "shared_folder", "stored", "told_apart", "without"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Tables of no more rows and bytes than these are broadcast.
SMALL_ROWS, SMALL_BYTES = 500_000, 32 << 20
#: Beyond that, rows are told apart by so many bits, in words of 64, before they are shuffled.
FILTER_BITS = 1 << 26


def is_small(df: DataFrame, *sized: str) -> bool:
    """Whether a stored table may be broadcast, by its rows and the bytes of its sized columns."""
    rows, size = df.agg(F.count("*"), sum((F.coalesce(F.sum(F.length(c)), F.lit(0)) for c in sized), F.lit(0))).first()
    return rows <= SMALL_ROWS and size <= SMALL_BYTES


def told_apart(df: DataFrame, key: Column, keys: DataFrame, own: Column) -> tuple[DataFrame, DataFrame]:
    """(rows of df whose key may be among the keys, rows whose key is not): by a bit array of FILTER_BITS bits at most, which is broadcast.

    key and own are hashes of the same kind, of a row of df and of a row of keys.
    """

    def place(h: Column) -> Column:
        return F.pmod(h, F.lit(FILTER_BITS))

    word, bits = fresh("__word", df.columns), fresh("__bits", df.columns)
    at = keys.select(place(own).alias("h")).select(F.expr("h div 64").alias(word), F.expr("shiftleft(1L, cast(h % 64 as int))").alias("b"))
    # At most FILTER_BITS / 64 rows of two numbers.
    known = F.broadcast(at.groupBy(word).agg(F.bit_or("b").alias(bits)))
    slot = fresh("__slot", df.columns)
    found = df.withColumn(slot, place(key)).join(known, F.expr(f"`{slot}` div 64") == F.col(word), "left")
    hit = F.coalesce(F.expr(f"shiftright(`{bits}`, cast(`{slot}` % 64 as int)) & 1"), F.lit(0)) == 1
    return found.where(hit).select(*df.columns), found.where(~hit).select(*df.columns)


def without(documents: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows of documents whose doc_id is not in `dropped` (one column of distinct ids); null ids stay.

    Few ids are broadcast.  Of many, only the rows that a bit array finds move; the others stay where they are.
    """
    name = fresh("__id", documents.columns)
    dropped = saved(dropped.toDF(name))
    match = F.col("doc_id") == F.col(name)
    if is_small(dropped):
        return documents.join(F.broadcast(dropped), match, "left_anti")
    maybe, kept = told_apart(documents, F.xxhash64("doc_id"), dropped, F.xxhash64(name))
    return kept.union(maybe.join(dropped, match, "left_anti"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node that it is connected with.

    Large-star and small-star steps in turn, until nothing changes; each step
    takes one aggregate with map-side combine and one join whose hot side Spark
    can split.  Loops and repeated edges do no harm; no edge, no row.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """Each node's links to larger (or to smaller) nodes go over to the smallest node that it is linked with."""
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        if large:
            moved = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
            least = down.groupBy("a").agg(F.min("b").alias("m"))
            moved = down.join(least, "a").select("b", "m").union(least.select("a", "m")).toDF("a", "b")
        return moved.where(F.col("a") != F.col("b")).distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())

    now = saved(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, after = None, mark(now)
    while before != after:
        now = saved(star(star(now, True), False))
        before, after = after, mark(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
