"""Quality scores by a factorisation machine.

Features of a text: its words, hashed (each occurrence weighs 1 / words), and
one-hot bins of structure statistics and of metadata (n_chars).  All pairs of
features interact through low-rank factors; the sum-of-squares identity gives
their total in time linear in the number of features.  Trained in numpy on the
driver, from a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel, sample

BITS, RANK, BINS = 18, 6, 10
#: Learn from about so many labelled rows at most, of so many characters at most.
BOUND, MAX_CHARS = 4_000, 60_000
#: A word weighs less the less it differs between the labels, in standard errors against so many (see sample.shrinkage).
CHANCE = 2.0
EPOCHS = 20
STATS = ("log bytes", "word length", "upper", "digit", "space", "ascii symbol", "exclamation", "bar", "line", "repeat of the word before", "distinct words", "declared length")
N = (1 << BITS) + len(STATS) * BINS


@dataclass(frozen=True)
class Model:
    bias: float
    weights: np.ndarray  # of N features
    factors: np.ndarray  # N x RANK; a word's weight and factors have its shrinkage in them
    edges: np.ndarray  # of the bins: len(STATS) x (BINS - 1)

    @cached_property
    def table(self) -> np.ndarray:
        """Weight, factors and their sum of squares by feature."""
        return np.column_stack((self.weights, self.factors, (self.factors.astype(float) ** 2).sum(1))).astype(float)


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_SYMBOL = _class("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") & ~_class(".,'-")
_BANG, _BAR, _LINE = _class("!"), _class("|"), _class("\n")


def _sum(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sums of values[edge[k]:edge[k+1]], each made from its own values only."""
    out = np.zeros((len(edge) - 1, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(edge[1:] > edge[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, edge[full], axis=0, dtype=out.dtype)
    return out


def features(column: pa.Array, declared: pa.Array | None, table: np.ndarray | None = None):
    """(statistics by text, words by text, sums of table's rows over words by text or the word buckets and their edges)."""
    n = len(column)
    raw_sums, words = np.zeros((n, 9)), np.zeros(n, np.int64)
    sums = None if table is None else np.zeros((n, table.shape[1]))
    buckets = [[] for _ in range(n)] if table is None else None
    row_before, seen, last = -1, np.zeros(0, bool), np.uint64(0)  # of a text that is in several slices
    for raw, off, rows in kernel.slices(column):
        for k, chars in enumerate((_UPPER, _DIGIT, kernel.WHITE, _SYMBOL, _BANG, _BAR, _LINE)):
            c = np.concatenate(([0], np.cumsum(chars[raw], dtype=np.int32)))
            raw_sums[rows, k] += c[off[1:]] - c[off[:-1]]
        grams = kernel.Grams(*kernel.spaced(raw, off))
        at, h = grams.words()
        b = (h >> np.uint64(64 - BITS)).astype(np.int64)
        edge = np.append(np.searchsorted(at, grams.starts), len(at))
        text = np.repeat(np.arange(len(rows)), np.diff(edge))
        same = np.zeros(len(h), np.int64)
        same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
        if len(rows) > 1:
            raw_sums[rows, 8] += np.bincount(np.unique(text << BITS | b) >> BITS, minlength=len(rows))
        elif len(h):
            if rows[0] == row_before:
                same[0] = h[0] == last
            else:
                seen = np.zeros(1 << BITS, bool)
            raw_sums[rows, 8] -= seen.sum()
            seen[b] = True
            raw_sums[rows, 8] += seen.sum()
            row_before, last = rows[0], h[-1]
        raw_sums[rows, 7] += _sum(same, edge)
        words[rows] += np.diff(edge)
        if table is None:
            for k, row in enumerate(rows):
                buckets[row].append(b[edge[k] : edge[k + 1]])
        else:
            sums[rows] += _sum(table[b], edge)
    _, off = kernel.string_buffers(column)
    size = np.diff(off)
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
    claimed = np.full(n, -1.0) if declared is None else np.nan_to_num(declared.cast(pa.float64()).to_numpy(zero_copy_only=False), nan=-1.0)
    stats = np.column_stack([
        np.log2(1 + size), size * per_word, raw_sums[:, 0] * per_byte, raw_sums[:, 1] * per_byte, raw_sums[:, 2] * per_byte, raw_sums[:, 3] * per_byte, raw_sums[:, 4] * per_word,
        raw_sums[:, 5] * per_word, raw_sums[:, 6] * per_word, raw_sums[:, 7] * per_word, raw_sums[:, 8] * per_word, np.log2(2 + np.maximum(claimed, -1)),
    ])
    return stats, words, sums if buckets is None else [np.concatenate(x) if x else np.zeros(0, np.int64) for x in buckets]


def bins(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Feature numbers of the statistics' bins."""
    return np.column_stack([(1 << BITS) + k * BINS + np.searchsorted(edges[k], stats[:, k], "right") for k in range(len(STATS))])


def train(rows: Iterable[tuple[str, int, int | None]], seed: int = 11) -> Model:
    """A model from (text, label, n_chars) rows.  Without rows of both labels every text scores n1 / (n + 1)."""
    rows = list(rows)
    y = np.array([r[1] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        p = min(max(float(y.sum()) / (len(y) + 1), 1e-6), 1 - 1e-6)
        return Model(float(np.log(p / (1 - p))), np.zeros(N), np.zeros((N, RANK)), np.zeros((len(STATS), BINS - 1)))
    stats, words, buckets = features(pa.array([r[0] for r in rows], pa.large_string()), pa.array([r[2] for r in rows], pa.int64()))
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    ones, zeros = (np.bincount(np.concatenate([np.unique(b) for b, k in zip(buckets, y, strict=True) if k == label]), minlength=1 << BITS) for label in (1, 0))
    shrink = sample.shrinkage(ones, zeros, float(y.sum()), float((1 - y).sum()), CHANCE)
    known = shrink > 0
    fixed = bins(stats, edges)
    ids = [np.concatenate((f, b[known[b]])) for f, b in zip(fixed, buckets, strict=True)]
    val = [np.concatenate((np.ones(len(f)), shrink[i[len(f) :]] / max(1, w))).astype(np.float32) for f, i, w in zip(fixed, ids, words, strict=True)]
    rng = np.random.default_rng(seed)
    w = np.zeros(N, np.float32)
    v = (rng.standard_normal((N, RANK)) * 0.05).astype(np.float32)
    v[: 1 << BITS][~known] = 0
    bias, w_sq, v_sq, b_sq = 0.0, np.full(N, 1e-4, np.float32), np.full((N, RANK), 1e-4, np.float32), 1e-4
    for epoch in range(EPOCHS):
        step = 0.1 * (1 - epoch / EPOCHS)
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 32):
            some = order[lo : lo + 32]
            i, x = np.concatenate([ids[k] for k in some]), np.concatenate([val[k] for k in some])
            row = np.repeat(np.arange(len(some)), [len(ids[k]) for k in some])
            vx = v[i] * x[:, None]
            s = np.column_stack([np.bincount(row, vx[:, f], len(some)) for f in range(RANK)])
            pair = 0.5 * ((s * s).sum(1) - np.bincount(row, (vx * vx).sum(1), len(some)))
            e = (1 / (1 + np.exp(-(bias + np.bincount(row, w[i] * x, len(some)) + pair))) - y[some]) / len(some)
            g = float(e.sum())
            b_sq += g * g
            bias -= step * g / b_sq**0.5
            touched, back = np.unique(i, return_inverse=True)
            ex = e[row] * x
            gw = np.bincount(back, ex, len(touched)) + 1e-4 * w[touched]
            w_sq[touched] += gw * gw
            w[touched] -= step * gw / np.sqrt(w_sq[touched])
            gv = ex[:, None] * (s[row] - vx)
            gv = np.column_stack([np.bincount(back, gv[:, f], len(touched)) for f in range(RANK)]) + 1e-4 * v[touched]
            v_sq[touched] += gv * gv
            v[touched] -= step * gv / np.sqrt(v_sq[touched])
    own = np.ones(N)
    own[: 1 << BITS] = shrink
    return Model(bias, (w * own).astype(np.float32), (v * own[:, None]).astype(np.float32), edges)


def logits(column: pa.Array, declared: pa.Array | None, model: Model) -> np.ndarray:
    table = model.table
    stats, words, sums = features(column, declared, table[: 1 << BITS])
    per = 1 / np.maximum(words, 1)[:, None]
    total = sums * np.concatenate((np.repeat(per, 1 + RANK, 1), per * per), 1) + table[bins(stats, model.edges)].sum(1)
    s = total[:, 1 : 1 + RANK]
    return model.bias + total[:, 0] + 0.5 * ((s * s).sum(1) - total[:, -1])


def score(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of the documents (doc_id by default) with quality_score (0 to 1), which takes the place of a column of that name.

    A null text counts as empty and an unknown n_chars as a bin of its own.  Texts
    are read whole, however long.  Rows are kept as they are, repeated ones and
    null ids too; an empty table gives an empty one.
    """
    keep = kernel.apart(["doc_id"] if keep is None else keep, ["quality_score"])
    declared = F.col("n_chars").cast("long") if "n_chars" in documents.columns else F.lit(None).cast("long")
    text, number = kernel.fresh("__text", keep), kernel.fresh("__n", keep)
    given = documents.select(*keep, F.col("text").alias(text), declared.alias(number))
    schema = given.drop(text, number).schema.add("quality_score", "double")

    def run(batches):
        for batch in batches:
            z = logits(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(np.round(1 / (1 + np.exp(-z)), 9))], names=[*batch.schema.names[:-2], "quality_score"])

    return given.mapInArrow(run, schema)


def learn(documents: DataFrame, labels: DataFrame, fold: Column, bound: int = BOUND, max_chars: int = MAX_CHARS) -> Model:
    """A model from about `bound` labelled rows for which `fold` holds."""
    return train(sample.labelled(documents, labels, "quality", fold, bound, max_chars, "n_chars"))
