"""Fill-in-the-middle: texts cut in two places and put in an order from which the middle is learned.

A batch's texts are one run of UTF-8 bytes.  A table gives each byte's class, a
mask of adjacent classes says where a unit begins, sums of the mask that begin
anew with each text count units, and one search in these sums gives the cuts of all
texts together.  Segments are slices of the same bytes, joined by Arrow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .kernel import apart, fresh, with_fields

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SIGNS = "<[PSM]>"
#: Texts are cut in slices of about so many bytes; a longer text is a slice of its own.
SLICE = 4 << 20
#: The sums over a slice are kept for every byte of a block only, and for each block.
BLOCK = 1 << 16

_TAIL, _WHITE, _LINE, _OTHER = range(4)
CLASS = np.array([_TAIL if b & 0xC0 == 0x80 else _LINE if b == 10 else _WHITE if kernel.WHITE[b] else _OTHER for b in range(256)], np.uint8)


def _begins(rule) -> np.ndarray:
    """For each pair of classes (before, now), whether a unit begins."""
    return np.array([rule(a, b) for a in range(4) for b in range(4)])


#: Where a unit begins, by the classes of a byte and of the byte before it.
UNITS = {
    "characters": _begins(lambda a, b: b != _TAIL),
    "words": _begins(lambda a, b: b == _OTHER and a in (_WHITE, _LINE)),
    "lines": _begins(lambda a, b: b != _TAIL and a == _LINE),
}


def starts(raw: np.ndarray, off: np.ndarray, units: str) -> np.ndarray:
    """Whether a unit begins at each byte; each text's first byte begins one."""
    kind = CLASS[raw]
    pair = kind.copy()
    pair[1:] += kind[:-1] * np.uint8(4)
    mask = UNITS[units][pair]
    mask[off[:-1][off[1:] > off[:-1]]] = True
    return mask


class Sums:
    """How many units begin before each byte, by blocks: sums over blocks, and over the bytes of those blocks that are asked for."""

    def __init__(self, mask: np.ndarray):
        self.mask = mask
        edges = np.arange(0, len(mask), BLOCK)
        self.blocks = np.concatenate(([0], np.cumsum(np.add.reduceat(mask, edges, dtype=np.int64) if len(edges) else edges)))

    def before(self, at: np.ndarray) -> np.ndarray:
        """Units that begin before the bytes `at`."""
        out = self.blocks[at // BLOCK]
        for b in np.unique(at // BLOCK):
            here = at // BLOCK == b
            inside = np.concatenate(([0], np.cumsum(self.mask[b * BLOCK : (b + 1) * BLOCK], dtype=np.int64)))
            out[here] += inside[at[here] - b * BLOCK]
        return out

    def place(self, unit: np.ndarray) -> np.ndarray:
        """The bytes at which the units of these numbers (from 0, over all texts) begin; the length beyond the last one."""
        b = np.searchsorted(self.blocks, unit, "right") - 1
        out = np.full(len(unit), len(self.mask), np.int64)
        for k in np.unique(b[b < len(self.blocks) - 1]):
            here = b == k
            inside = np.cumsum(self.mask[k * BLOCK : (k + 1) * BLOCK], dtype=np.int64)
            out[here] = k * BLOCK + np.searchsorted(inside, unit[here] - self.blocks[k] + 1)
        return out


def cut(raw: np.ndarray, off: np.ndarray, draws: np.ndarray, units: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units of each text, units before its first cut, before its second, byte offsets of all segments: three for each text)."""
    sums = Sums(starts(raw, off, units))
    base = sums.before(off)
    n = np.diff(base)
    where = np.sort(draws % (n[:, None] + 1), axis=1)
    at = sums.place((base[:-1, None] + where).ravel()).reshape(-1, 2)
    at = np.where(where == n[:, None], off[1:, None], at)
    return n, where[:, 0], where[:, 1], np.append(np.column_stack((off[:-1], at)).ravel(), off[-1])


def _strings(raw: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(raw)])


def _segments(raw: np.ndarray, edges: np.ndarray) -> list[pa.Array]:
    """prefixes, middles and suffixes as strings over the same bytes."""
    parts = _strings(raw, edges)
    which = np.arange(0, len(edges) - 1, 3)
    return [parts.take(pa.array(which + k)) for k in range(3)]


def arrange(column: pa.Array, draws: np.ndarray, plain: np.ndarray, spm: np.ndarray, units: str) -> Iterator[pa.RecordBatch]:
    """For slices of the column in turn: fim, form, units, prefix_units, middle_units.

    draws: two numbers for each text, of which the remainders by its units + 1 are
    the cuts; plain: texts to leave as they are; spm: which of the others begin with
    the suffix.
    """
    raw, off = kernel.string_buffers(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE, "right")) - 1)
        part, edge = raw[off[i] : off[j]], off[i : j + 1] - off[i]
        n, first, second, edges = cut(part, edge, draws[i:j], units)
        prefix, middle, suffix = _segments(part, edges)
        text = _strings(part, edge)
        whole = pc.or_(pc.or_(pa.array(plain[i:j]), pa.array(n == 0)), pc.match_substring_regex(text, SIGNS))
        p, s, m, nothing = (pa.scalar(x, pa.large_string()) for x in (PREFIX, SUFFIX, MIDDLE, ""))
        back = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, nothing)
        front = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, nothing)
        turn = pa.array(spm[i:j])
        yield pa.RecordBatch.from_arrays([
            pc.if_else(whole, text, pc.if_else(turn, front, back)), pc.if_else(whole, "plain", pc.if_else(turn, "spm", "psm")),
            pa.array(n), pc.if_else(whole, None, pa.array(first)), pc.if_else(whole, None, pa.array(second - first)),
        ], names=["fim", "form", "units", "prefix_units", "middle_units"])
        i = j


def draws_of(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2**32 from the seed and the id: the first 8-digit groups of their SHA-256 in hex; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transform(documents: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, units: str = "characters", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all but text by default) with fim (the text put in order), form, units, prefix_units and middle_units.

    form is psm (`<P>`prefix`<S>`suffix`<M>`middle), spm (`<S>`suffix`<P>`prefix`<M>`middle) or
    plain: the text as it is, where it is empty or null, holds one of the signs, or
    falls among the `plain_percent` that are left alone; prefix_units and
    middle_units are then null.  The cuts are at units' beginnings (UNITS: characters,
    words with the space after them, or lines), never inside a code point, and depend on
    doc_id and seed only: repeated ids draw the same numbers, equal texts of
    different ids don't.  Texts are read whole, however long.  Columns of the
    outputs' names give way; an empty table gives an empty one.
    """
    outputs = ["fim", "form", "units", "prefix_units", "middle_units"]
    keep = apart([c for c in documents.columns if c.lower() != "text"] if keep is None else keep, outputs)
    names = [fresh(f"__{k}", keep) for k in range(5)]
    drawn = [c.alias(k) for c, k in zip(draws_of(F.col("doc_id"), seed), names, strict=False)]
    given = documents.select(*keep, *drawn, F.col("text").alias(names[4]))
    schema = with_fields(given.drop(*names).schema, "fim string, form string, units long, prefix_units long, middle_units long")

    def run(batches):
        for batch in batches:
            h1, h2, h3, h4 = (batch.column(len(keep) + k).to_numpy(zero_copy_only=False) for k in range(4))
            done = 0
            for found in arrange(batch.column(batch.num_columns - 1), np.column_stack((h1, h2)), h3 % 100 >= 100 - plain_percent, h4 % 100 < spm_percent, units):
                kept = batch.slice(done, found.num_rows)
                done += found.num_rows
                yield pa.RecordBatch.from_arrays([*kept.columns[: len(keep)], found.column(0).cast(pa.string()), *found.columns[1:]], names=[*batch.schema.names[: len(keep)], *outputs])

    return given.mapInArrow(run, schema)


def restored(fim: Column, form: Column) -> Column:
    """The text that transform() was given (null: empty), from its output and form alone.

    No sign is in the text of a form other than plain, nor can one arise where a
    sign and a segment meet, so the three signs are the only places to split at.
    """
    parts = F.split(fim, SIGNS, -1)
    return F.when(form == "plain", fim).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
