"""Array kernels over Arrow string columns.

Texts are handled as UTF-8 bytes in slices of about a megabyte, so that memory
stays bounded however long a batch is, or a text of words.  A text longer than a
slice is cut before a byte that is no part of a word, however far that is, so no
n-gram is lost or made up; what the callers compute adds up over the parts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd 64-bit number, and their inverses modulo 2**64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << 17 if n <= 1 << 17 else max(n, SLICE_BYTES + 65_536)  # they stay as long as the process
        up, down = np.full(size, _ODD, np.uint64), np.full(size, pow(_ODD, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers, _inverses = np.cumprod(up), np.cumprod(down)
    return _powers, _inverses


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hash finds the hash of any span in constant time."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, where, what = column.buffers()
    if where is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.zeros(0, np.uint8) if what is None else np.frombuffer(what, np.uint8)), offsets


def released(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; after the last, what Arrow keeps of memory that nothing uses goes back to the system."""
    yield from batches
    pa.default_memory_pool().release_unused()


def _cuts(raw: np.ndarray, a: int, b: int, limit: int, between: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of about `limit` bytes, longer only where no byte of the table `between` is."""
    while b - a > limit:
        cut = b
        for lo in range(a + limit - limit // 4, b, limit):
            found = np.flatnonzero(between[raw[lo : min(b, lo + limit)]])
            if len(found):
                inside = found[found < a + limit - lo]
                cut = lo + int(inside[-1] if len(inside) else found[0])
                break
        yield a, cut
        a = cut
    if b > a:
        yield a, b


def slices(column: pa.Array, limit: int | None = None, between: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row numbers) of parts of the column of about `limit` bytes (SLICE_BYTES).

    Longer texts are cut before one of the bytes `between` (all that are in no word of letters).
    """
    limit, between = limit or SLICE_BYTES, ~WORDLIKE if between is None else between
    raw, off = string_buffers(column)
    i, n = 0, len(column)
    while i < n:
        if off[i + 1] - off[i] > limit:
            for a, b in _cuts(raw, int(off[i]), int(off[i + 1]), limit, between):
                yield raw[a:b], np.array([0, b - a], np.int64), np.array([i])
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield raw[off[i] : off[j]], off[i : j + 1] - off[i], np.arange(i, j)
        i = j


def spaced(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one space before each and one at the end, and where each text's space is."""
    n = len(off) - 1
    buf = np.full(len(raw) + n + 1, 32, np.uint8)
    starts = off[:-1] + np.arange(n)
    for k in range(n):
        a, b = off[k], off[k + 1]
        buf[a + k + 1 : b + k + 1] = raw[a:b]
    return buf, starts


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()
#: What separates words where only letters, digits and bytes above 127 make them.
WORDLIKE = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
WHITE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def lower(buf: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the capitals U+00C0 to U+00DE."""
    out = LOWER[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3) + 1
    lead = lead[(buf[lead] >= 0x80) & (buf[lead] <= 0x9E) & (buf[lead] != 0x97)]
    out[lead] += 32
    return out


class Grams:
    """Character n-grams of words with a space at either end of a word; offsets are in characters."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, letters_only: bool = True):
        buf = lower(buf)
        if letters_only:
            buf = np.where(WORDLIKE[buf], buf, np.uint8(32))
        else:
            buf = np.where(WHITE[buf], np.uint8(32), buf)
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        _, down = powers(len(buf) + 1)
        sums = prefix_hash(buf)
        self.sums = np.append(sums[at], sums[-1])
        self.down = down[at]
        space = buf[at] == 32
        self.spaces = np.concatenate(([0], np.cumsum(space, dtype=np.int32)))
        self.space = space
        self.starts = np.searchsorted(at, starts)
        self.n = len(at)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of n-grams without a space inside."""
        m = self.n - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        w = self.spaces
        keep = w[n - 1 : n - 1 + m] == w[1 : 1 + m] if n > 2 else w[n : n + m] - w[:m] < n
        at = np.flatnonzero(keep)
        return at, mix((self.sums[at + n] - self.sums[at]) * self.down[at])

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of whole words."""
        a = np.flatnonzero(self.space[:-1] & ~self.space[1:]) + 1
        b = np.flatnonzero(~self.space[:-1] & self.space[1:]) + 1
        return a, mix((self.sums[b] - self.sums[a]) * self.down[a])

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """Which text of the slice each position belongs to."""
        return np.searchsorted(self.starts, at, "right") - 1


def with_fields(schema: StructType, ddl: str) -> StructType:
    """The schema and the fields of a DDL string."""
    return StructType(schema.fields + StructType.fromDDL(ddl).fields)


def apart(keep: list[str], outputs: Iterable[str]) -> list[str]:
    """The columns to keep, but for those that an output of the same name takes the place of."""
    taken = {c.lower() for c in outputs}
    return [c for c in keep if c.lower() not in taken]


def fresh(name: str, columns: list[str]) -> str:
    """A column name that is not taken."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
