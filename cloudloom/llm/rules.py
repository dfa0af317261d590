"""Quality rules: statistics of each text, and how much likelier its n-grams are in a trusted corpus than in the raw one.

Words and pairs of neighbouring words are hashed into buckets.  Two multinomials
over the buckets, one counted over all documents and one over all trusted ones,
give each bucket a log-likelihood ratio; a document's is the mean over its
n-grams, so that its length doesn't matter.  It is kept where the mean reaches a
threshold: the score that all but a small share of the trusted documents reach
when their own n-grams are left out of the counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .kernel import apart, fresh, with_fields
from .shared import is_small, saved, told_apart

BITS = 16
#: The share of trusted documents that would fail by their own words.
SHARE = 0.005
#: Scores are told apart by so much where the threshold is sought.
STEP = 1e-3
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WHITE = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Model:
    raw: np.ndarray  # how often each bucket is hit, over all documents
    trusted: np.ndarray  # over the trusted ones
    threshold: float

    def ratio(self) -> np.ndarray:
        """The log-likelihood ratio of each bucket; one is added to each count."""
        t, r = self.trusted + 1.0, self.raw + 1.0
        return np.log(t / t.sum()) - np.log(r / r.sum())


@dataclass(frozen=True)
class Words:
    """Words of several texts: their hashes in order, and by text the edges, code points in words, and symbols."""

    rows: np.ndarray
    hashes: np.ndarray
    edges: np.ndarray
    chars: np.ndarray
    symbols: np.ndarray

    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows)), np.diff(self.edges))


def _by_text(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return c[off[1:]] - c[off[:-1]]


def words(column: pa.Array) -> Iterator[Words]:
    """The words of whole texts, slice by slice; of a text in several slices the words come together."""

    def of(raw: np.ndarray, off: np.ndarray, rows: np.ndarray) -> Words:
        white = kernel.WHITE[raw]
        buf, at = kernel.spaced(raw, off)
        inner = ~kernel.WHITE[buf]
        a, b = np.flatnonzero(inner[1:] & ~inner[:-1]) + 1, np.flatnonzero(inner[:-1] & ~inner[1:]) + 1
        h = kernel.span_hash(kernel.prefix_hash(buf), a, b)
        return Words(rows, h, np.append(np.searchsorted(a, at), len(a)), _by_text(~white & ((raw & 0xC0) != 0x80), off), _by_text(_SYMBOL[raw], off))

    held: list[Words] = []

    def whole() -> Words:
        out = held[0] if len(held) == 1 else Words(held[0].rows, np.concatenate([x.hashes for x in held]), np.array([0, sum(len(x.hashes) for x in held)]), sum(x.chars for x in held), sum(x.symbols for x in held))
        held.clear()
        return out

    for part in kernel.slices(column, between=kernel.WHITE):
        if held and not (len(part[2]) == 1 and len(held[0].rows) == 1 and part[2][0] == held[0].rows[0]):
            yield whole()
        held.append(of(*part))
    if held:
        yield whole()


def repeated(found: Words, width: int = WINDOW) -> np.ndarray:
    """By text, the words in windows of `width` words that are found twice or more in the text."""
    h, n, text = found.hashes, len(found.hashes) - width + 1, found.text()
    if n <= 0:
        return np.zeros(len(found.rows), np.int64)
    at = np.flatnonzero(text[:n] == text[width - 1 :])
    key = np.zeros(len(at), np.uint64)
    for k in range(width):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[at + k]
    key = kernel.mix(key) + text[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + width, -1)
    return np.bincount(text[np.cumsum(change[:-1]) > 0], minlength=len(found.rows))


def buckets(found: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the words, then of the pairs of neighbouring words."""
    h, text = found.hashes, found.text()
    pair = np.flatnonzero(text[1:] == text[:-1])
    both = kernel.mix(h[pair] * np.uint64(0x9E3779B97F4A7C15) + h[pair + 1])
    return np.concatenate((text, text[pair])), (np.concatenate((h, both)) >> np.uint64(64 - bits)).astype(np.int64)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(_WHITE):
            seen.add(line)
    return n


def mean_ratio(found: Words, model: Model, ratio: np.ndarray, own: bool | np.ndarray = False) -> np.ndarray:
    """By text, the mean ratio of its n-grams, 0 without any.  own: whether a text is among the trusted ones, and its n-grams are to be left out of both counts."""
    bits = len(ratio).bit_length() - 1
    text, b = buckets(found, bits)
    n = np.bincount(text, minlength=len(found.rows))
    if own is False:
        return np.bincount(text, ratio[b], len(found.rows)) / np.maximum(n, 1)
    key, times = np.unique(text << bits | b, return_counts=True)
    text, b = key >> bits, key & ((1 << bits) - 1)
    t, r = model.trusted[b] - times + 1.0, model.raw[b] - times + 1.0
    total_t, total_r = model.trusted.sum() - n + len(ratio), model.raw.sum() - n + len(ratio)
    total = np.bincount(text, times * np.log(t / r), len(found.rows))
    return total / np.maximum(n, 1) + np.where(n > 0, np.log(total_r / total_t), 0)


def marked(documents: DataFrame, trusted: DataFrame) -> DataFrame:
    """text (null: empty) and trusted, whether doc_id is among those of `trusted`; repeated and null ids of it don't matter."""
    ids = saved(trusted.select(F.col("doc_id").alias("i")).where("i is not null").distinct())
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def known(some: DataFrame, ids: DataFrame) -> DataFrame:
        return some.join(ids, F.col("doc_id") == F.col("i"), "left").select("text", F.col("i").isNotNull().alias("trusted"))

    if is_small(ids):
        return known(texts, F.broadcast(ids))
    maybe, others = told_apart(texts, F.xxhash64("doc_id"), ids, F.xxhash64("i"))
    return known(maybe, ids).union(others.select("text", F.lit(False).alias("trusted")))


def learn(documents: DataFrame, trusted: DataFrame, bits: int = BITS, share: float = SHARE) -> Model:
    """Counts over all documents and over all whose doc_id `trusted` has, and the threshold that all but `share` of the latter reach.

    Only two counts for each bucket, and how many trusted documents have each score
    (to STEP), come to the driver; both are of a size that does not grow with the
    tables.  Null texts are empty; copies count as often as they are there.  Without
    trusted documents, or without any, the threshold is minus infinity.
    """
    rows = marked(documents, trusted)

    def count(batches):
        total = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            good = batch.column(1).to_numpy(zero_copy_only=False)
            for found in words(batch.column(0)):
                text, b = buckets(found, bits)
                ours = good[found.rows][text]
                total[0] += np.bincount(b, minlength=1 << bits)
                total[1] += np.bincount(b[ours], minlength=1 << bits)
        hit = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[0][hit]), pa.array(total[1][hit])], names=["b", "r", "t"])

    counts = rows.mapInArrow(count, "b long, r long, t long").groupBy("b").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    table = np.zeros((2, 1 << bits), np.int64)
    for b, r, t in counts.collect():  # at most 2 ** bits rows
        table[:, b] = r, t
    model = Model(*table, -np.inf)
    ratio = model.ratio()

    def score(batches):
        for batch in batches:
            steps = [np.floor(mean_ratio(found, model, ratio, own=True)[np.diff(found.edges) > 0] / STEP) for found in words(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(steps or [np.zeros(0)]).astype(np.int64))], names=["step"])

    # A mean of logarithms of counts: some ten thousand steps at most.
    steps = sorted(map(tuple, rows.where("trusted").select("text").mapInArrow(score, "step long").groupBy("step").count().collect()))
    below = np.cumsum([n for _, n in steps])
    reached = [s for (s, _), n in zip(steps, below, strict=True) if n > share * below[-1]]
    return Model(*table, reached[0] * STEP if reached else -np.inf)


def statistics(column: pa.Array, model: Model | None, ratio: np.ndarray | None) -> list[np.ndarray]:
    """By text: words, code points in words, symbols, repeated lines, words in repeated windows, and the mean ratio."""
    out = [np.zeros(len(column), np.int64) for _ in range(5)] + [np.zeros(len(column))]
    for found in words(column):
        values = np.diff(found.edges), found.chars, found.symbols, None, repeated(found), None if model is None else mean_ratio(found, model, ratio)
        for kept, value in zip(out, values, strict=True):
            if value is not None:
                kept[found.rows] = value
    raw, off = kernel.string_buffers(column)
    out[3][:] = [repeated_lines(raw[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
    return out


def assess(documents: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (doc_id by default) with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and, by a model, log_ratio and kept.

    base_failed: fewer than MIN_WORDS words, or more than MAX_REPEATED % of them in
    windows of WINDOW words that the text has twice or more.  kept: neither that nor
    a log_ratio below the model's threshold.  A null text is empty; texts are read
    whole, however long; repeated rows are scored alike, an empty table gives an
    empty one, and columns of the outputs' names give way.
    """
    ddl = STATISTICS + ("" if model is None else ", log_ratio double, kept boolean")
    outputs = [x.split()[0] for x in ddl.split(", ")]
    keep = apart(["doc_id"] if keep is None else keep, outputs)
    name = fresh("__text", keep)
    given = documents.select(*keep, F.col("text").alias(name))
    schema = with_fields(given.drop(name).schema, ddl)
    ratio = None if model is None else model.ratio()

    def run(batches):
        for batch in batches:
            *stats, mean = statistics(batch.column(batch.num_columns - 1), model, ratio)
            failed = (stats[0] < MIN_WORDS) | (100 * stats[4] > MAX_REPEATED * stats[0])
            more = [*stats, failed] + ([] if model is None else [np.round(mean, 9), ~failed & (mean >= model.threshold)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, more)], names=[*batch.schema.names[:-1], *outputs])

    return given.mapInArrow(run, schema)
