"""Language identification by bit-sliced Bloom filters of character n-grams.

One filter holds the n-grams of all languages: a slot has one bit for each
language, in planes of eight, and a lookup ANDs the slots of an n-gram's hashes,
which gives every language that (probably) has the n-gram.  A text's count of
hits for each language is corrected by the filter's rate of false positives.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel, sample

SIZES = (2, 3, 4)
#: Learn from about so many rows of a language at most, of so many characters at most; keep so many n-grams of each.
BOUND, MAX_CHARS, GRAMS = 1_500, 60_000, 5_000
SLOT_BITS, HASHES = 17, 3


@dataclass(frozen=True)
class Model:
    """languages in order; planes: a byte array for each eight of them; wrong: rates of false positives."""

    languages: tuple[str, ...]
    planes: tuple[np.ndarray, ...]
    wrong: np.ndarray


def slots(h: np.ndarray) -> list[np.ndarray]:
    mask = np.uint64((1 << SLOT_BITS) - 1)
    return [((h >> np.uint64(SLOT_BITS * k)) & mask).astype(np.int64) for k in range(HASHES)]


def build(grams: dict[str, np.ndarray]) -> Model:
    """A model from the hashes of each language's n-grams."""
    languages = tuple(sorted(grams))
    planes = tuple(np.zeros(1 << SLOT_BITS, np.uint8) for _ in range(math.ceil(len(languages) / 8)))
    wrong = np.zeros(len(languages))
    for k, language in enumerate(languages):
        plane, bit = planes[k // 8], np.uint8(1 << k % 8)
        for at in slots(grams[language]):
            plane[at] |= bit
        wrong[k] = np.mean((plane & bit) > 0) ** HASHES
    return Model(languages, planes, wrong)


def counts(column: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of each text, hits by text and language)."""
    total, hits = np.zeros(len(column)), np.zeros((len(column), len(model.languages)))
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    for raw, off, rows in kernel.slices(column):
        grams = kernel.Grams(*kernel.spaced(raw, off))
        for n in SIZES:
            at, h = grams.of(n)
            if not len(at):
                continue
            text, where = grams.text_of(at), slots(h)
            total[rows] += np.bincount(text, minlength=len(rows))
            for p, plane in enumerate(model.planes):
                found = plane[where[0]]
                for more in where[1:]:
                    found = found & plane[more]
                table = np.bincount(text * 256 + found, minlength=len(rows) * 256).reshape(-1, 256) @ bits
                width = min(8, len(model.languages) - 8 * p)
                hits[rows, 8 * p : 8 * p + width] += table[:, :width]
    return total, hits


def has_letter(column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column), bool)
    for raw, off, rows in kernel.slices(column):
        ascii_ = np.concatenate(([0], np.cumsum((raw | 32) - np.uint8(97) < 26)))
        out[rows] |= ascii_[off[1:]] > ascii_[off[:-1]]
        for k in np.flatnonzero(~out[rows]):
            out[rows[k]] = any(map(str.isalpha, raw[off[k] : off[k + 1]].tobytes().decode("utf-8", "ignore")))
    return out


def decide(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """(language, its share of the corrected hits); `und` where there is no letter or no language was learned."""
    if not model.languages:
        return ["und"] * len(column), np.zeros(len(column))
    total, hits = counts(column, model)
    fair = np.maximum(0, (hits - total[:, None] * model.wrong) / np.maximum(1 - model.wrong, 1e-9))
    best = fair.argmax(1)
    share = fair[np.arange(len(best)), best] / np.maximum(fair.sum(1), 1e-9)
    letter = has_letter(column)
    return [model.languages[b] if ok else "und" for b, ok in zip(best, letter, strict=True)], np.round(np.where(letter, np.clip(share, 0, 1), 0), 9)


def learn(documents: DataFrame, fold: Column, bound: int = BOUND, max_chars: int = MAX_CHARS, grams: int = GRAMS) -> Model:
    """A model from rows with a lang for which `fold` holds: about `bound` rows of each language at most."""
    usable = documents.where(F.col("lang").isNotNull()).where(fold).where(F.length("text") <= max_chars)
    sizes = {r["lang"]: r["count"] for r in documents.where(F.col("lang").isNotNull()).where(fold).groupBy("lang").count().collect()}
    if not sizes:
        return build({})
    limit = F.create_map(*[F.lit(x) for kind, n in sorted(sizes.items()) for x in (kind, sample.share(bound, n))])
    rows = usable.where(sample.bucket(F.col("doc_id")) < limit[F.col("lang")]).select("lang", "text")

    def run(batches):
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), dtype=object)
            for kind in sorted(set(lang.tolist())):
                found = []
                for raw, off, _ in kernel.slices(batch.column(1).filter(pa.array(lang == kind))):
                    g = kernel.Grams(*kernel.spaced(raw, off))
                    found += [h for n in SIZES for h in [g.of(n)[1]]]
                h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    found = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = found.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= grams)
    learned: dict[str, list[int]] = {}
    for r in top.select("lang", "gram").collect():
        learned.setdefault(r["lang"], []).append(r["gram"])
    return build({k: np.array(v, np.int64).view(np.uint64) for k, v in learned.items()})


def identify(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of the documents (doc_id by default) with lang_pred and lang_score, which take the place of columns of these names.

    A null text, or one without a letter, is `und` with score 0.  Of languages
    that tie the first one in order holds: so does a text of which no n-gram is
    known, with score 0.  Texts are read whole, however long; rows are kept as they
    are, repeated ones and null ids too; an empty table gives an empty one.
    """
    keep = kernel.apart(["doc_id"] if keep is None else keep, ["lang_pred", "lang_score"])
    text = kernel.fresh("__text", keep)
    given = documents.select(*keep, F.col("text").alias(text))
    schema = given.drop(text).schema.add("lang_pred", "string").add("lang_score", "double")

    def run(batches):
        for batch in batches:
            kind, share = decide(batch.column(batch.num_columns - 1), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(kind, pa.string()), pa.array(share)], names=[*batch.schema.names[:-1], "lang_pred", "lang_score"])

    return given.mapInArrow(run, schema)
