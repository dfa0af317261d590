"""Bounded, repeatable samples of rows, chosen by a hash of their key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 1 << 30


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(SPAN))


def share(bound: int, of: int) -> int:
    """Rows whose bucket is less than this number are about `bound` of `of` rows, or all of them."""
    return SPAN if of <= bound else max(1, SPAN * bound // of)


def crc_of(doc_id: Column) -> Column:
    """crc32 of the id as text, unsigned; a null id has that of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def labelled(documents: DataFrame, labels: DataFrame, label: str, fold: Column, bound: int, max_chars: int, *more: str) -> list:
    """(text, label, *more) rows to learn from, on the driver: about `bound` at most, each of `max_chars` at most.

    Only rows of `labels` with a label and `fold` true count; where an id has
    several labels, or several texts, the smallest holds, so that no more rows come
    back than ids were chosen.  Ordered by text, so that the same rows give the
    same model however they are stored.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(fold).groupBy("doc_id").agg(F.min(label).alias("label"))
    n = known.count()
    # At most about `bound` rows of two numbers are broadcast.
    chosen = F.broadcast(known.where(bucket(F.col("doc_id")) < share(bound, n)))
    extra = [F.col(c).cast("long").alias(c) if c in documents.columns else F.lit(None).cast("long").alias(c) for c in more]
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *extra).where(F.length("text") <= max_chars).join(chosen, "doc_id")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("text", "label", *more)).alias("r"))
    return sorted(map(tuple, one.select("r.text", "r.label", *(f"r.{c}" for c in more)).collect()), key=str)


def shrinkage(ones: np.ndarray, zeros: np.ndarray, n1: float, n0: float, chance: float) -> np.ndarray:
    """For each feature, of its rows by label: 1 - (chance / z) ** 2, where z is how many standard errors its share of rows differs between the labels by.

    It is 0 where a feature differs no more than by chance; with too few rows to
    tell for any, it is 1 for all that differ.
    """
    rate = (ones + zeros) / (n1 + n0)
    z = np.abs(ones / n1 - zeros / n0) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / n1 + 1 / n0))
    out = np.maximum(0, 1 - (chance / np.maximum(z, 1e-9)) ** 2)
    return (out if out.any() else (z > 0)).astype(np.float32)
