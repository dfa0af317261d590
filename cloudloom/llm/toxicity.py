"""Toxicity scores: bags of subword embeddings, averaged into a linear softmax.

The embeddings of character n-grams and whole words and the softmax layer are
trained jointly in numpy on the driver, from a bounded sample of labelled rows.
A misspelling that was never seen shares most n-grams with its word.  Because
the layer is linear, a text's logit is the mean of one number for each gram;
the executors look these numbers up and add them as integers, so a score does
not depend on how rows are batched.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel, sample

SIZES = (3, 4, 5, 6, 7)
BITS = 19
DIM = 8
#: Learn from about so many labelled rows at most, of so many characters at most.
BOUND, MAX_CHARS = 3_000, 60_000
#: Embeddings are shrunk by how far grams differ between the labels, in standard errors against so many (see sample.shrinkage).
CHANCE = 3.0
EPOCHS = 40
ONE = 1 << 20
#: Bytes of text that are scored at once: the arrays over their grams take some hundred times as much, in each task.
SLICE_BYTES = 1 << 16


def gram_buckets(grams: kernel.Grams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    shift = np.uint64(64 - BITS)
    for n in SIZES:
        at, h = grams.of(n)
        yield at, (h >> shift).astype(np.int64)
    at, h = grams.words()
    yield at, (kernel.mix(h + np.uint64(1)) >> shift).astype(np.int64)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text."""
    found = []
    for raw, off, _ in kernel.slices(pa.array([text], pa.large_string())):
        found += [b for _, b in gram_buckets(kernel.Grams(*kernel.spaced(raw, off)))]
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)


def train(rows: Iterable[tuple[str, int]], seed: int = 7) -> tuple[np.ndarray, int]:
    """(a number for each gram, bias), both times ONE.

    Without rows of both labels every text scores n1 / (n + 1).
    """
    rows = list(rows)
    y = np.array([label for _, label in rows], np.int64)
    if len(set(y.tolist())) < 2:
        p = min(max(y.sum() / (len(y) + 1), 1e-6), 1 - 1e-6)
        return np.zeros(1 << BITS, np.int64), int(round(np.log(p / (1 - p)) * ONE))
    held = np.zeros((2, 1 << BITS))  # rows of each label that hold a gram
    for text, label in rows:  # bags are made again below: all at once they are larger than the texts
        held[label, bag(text)[0]] += 1
    shrink = sample.shrinkage(held[1], held[0], y.sum(), (1 - y).sum(), CHANCE)
    known = shrink > 0
    rng = np.random.default_rng(seed)
    size = 1 << BITS
    emb = (rng.random((size, DIM), np.float32) - np.float32(0.5)) / np.float32(DIM)
    emb[~known] = 0
    out = (rng.random((DIM, 2), np.float32) - np.float32(0.5)) / np.float32(DIM)
    bias = np.zeros(2, np.float32)
    emb_sq, out_sq, bias_sq = np.full(size, 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
    kept = []
    for text, _ in rows:
        b, c = bag(text)
        k = known[b]
        kept.append((b[k], (shrink[b[k]] * c[k] / max(1, c.sum())).astype(np.float32)))
    for epoch in range(EPOCHS):
        rate = np.float32(0.4 * (1 - epoch / EPOCHS))
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 16):
            some = order[lo : lo + 16]
            ids = np.concatenate([kept[i][0] for i in some])
            val = np.concatenate([kept[i][1] for i in some])
            row = np.repeat(np.arange(len(some)), [len(kept[i][0]) for i in some])
            hidden = np.zeros((len(some), DIM), np.float32)
            got = emb[ids] * val[:, None]
            for d in range(DIM):
                hidden[:, d] = np.bincount(row, got[:, d], len(some))
            logit = hidden @ out + bias
            logit -= logit.max(1, keepdims=True)
            p = np.exp(logit)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p /= len(some)
            back = p @ out.T
            g = p.sum(0)
            bias_sq += g * g
            bias -= rate * g / np.sqrt(bias_sq)
            g = hidden.T @ p
            out_sq += g * g
            out -= rate * g / np.sqrt(out_sq)
            touched, inverse = np.unique(ids, return_inverse=True)
            grad = np.empty((len(touched), DIM), np.float32)
            part = back[row] * val[:, None]
            for d in range(DIM):
                grad[:, d] = np.bincount(inverse, part[:, d], len(touched))
            emb_sq[touched] += (grad * grad).mean(1)
            emb[touched] -= rate * grad / np.sqrt(emb_sq[touched])[:, None]
    each = shrink * (emb @ (out[:, 1] - out[:, 0]))
    return np.round(each.astype(np.float64) * ONE).astype(np.int64), int(round(float(bias[1] - bias[0]) * ONE))


def logits(column: pa.Array, each: np.ndarray, bias: int) -> np.ndarray:
    total, count = np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
    for raw, off, rows in kernel.slices(column, min(SLICE_BYTES, kernel.SLICE_BYTES)):
        grams = kernel.Grams(*kernel.spaced(raw, off))
        for at, b in gram_buckets(grams):
            if not len(at):
                continue
            sums = np.concatenate(([0], np.cumsum(each[b])))
            edge = np.append(np.searchsorted(at, grams.starts), len(at))
            total[rows] += sums[edge[1:]] - sums[edge[:-1]]
            count[rows] += edge[1:] - edge[:-1]
    return (total / np.maximum(count, 1) + bias) / ONE


def score(documents: DataFrame, model: tuple[np.ndarray, int], keep: list[str] | None = None, name: str = "toxicity_score") -> DataFrame:
    """`keep` columns of the documents (doc_id by default) with the score (0 to 1) as column `name`, which takes the place of one of that name.

    A null text counts as empty; an empty text, or one none of whose grams is
    known, scores as the bias alone.  Texts are read whole, however long.  Rows are
    kept as they are, repeated ones and null ids too; an empty table gives an empty
    one.
    """
    keep = kernel.apart(["doc_id"] if keep is None else keep, [name])
    each, bias = model
    n = len(keep)
    at = keep.index("text") if "text" in keep else n  # a text that is kept goes to the workers once
    given = documents.select(*keep, *([F.col("text").alias(kernel.fresh("__text", keep))] if at == n else []))
    schema = documents.select(*keep).schema.add(name, "double")

    def run(batches):
        for batch in kernel.released(batches):
            p = 1 / (1 + np.exp(-logits(batch.column(at), each, bias)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(np.round(p, 9))], names=[*batch.schema.names[:n], name])

    return given.mapInArrow(run, schema)


def learn(documents: DataFrame, labels: DataFrame, fold: Column, bound: int = BOUND, max_chars: int = MAX_CHARS) -> tuple[np.ndarray, int]:
    """A model from about `bound` labelled rows for which `fold` holds."""
    return train(sample.labelled(documents, labels, "toxic", fold, bound, max_chars))
