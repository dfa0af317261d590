"""Line dedup: lines that many documents share stay in one of them.

Hashes of the lines are range-partitioned with a secondary sort by document
(largest first) and position; each partition is streamed, its first occurrences
stay and later ones are dropped.  The range is over hash, document and position
together, so that a line which a third of all documents have is dealt over many
partitions; what such neighbours have to know of each other is one row for each
key at a partition's edge.  Documents come back as compressed bitmaps of the
lines to keep, which go to the texts where they are small enough to be broadcast;
else the texts that may lose a line go to their bitmaps.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .kernel import apart, fresh, with_fields
from .shared import is_small, partitions, saved, stored, told_apart

MIN_CHARS, MIN_DOCS = 20, 3
#: Stands for a null id: smaller than any other.
NO_ID = -(1 << 63)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def line_key(line: bytes) -> bytes:
    return line.strip(b" \t\n\r\x0b\x0c").translate(_LOWER)


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or sum(b & 0xC0 != 0x80 for b in key) >= min_chars)


def _keyed(documents: DataFrame, names: list[str], *keep) -> DataFrame:
    """keep, and by the three names the id, the hash of the text (repeated ids may have several texts) and the text as bytes."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(*keep, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(names[0]), F.xxhash64(text).alias(names[1]), text.cast("binary").alias(names[2]))


def line_rows(documents: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2 (of the key), d, p (position), t, n (lines of the document), for each line whose key is long enough."""

    def run(batches):
        for batch in batches:
            digests, d, p, t, n = [], [], [], [], []

            def packed():
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), *(pa.array(x, pa.int64()) for x in (d, p, t, n))], names=["h1", "h2", "d", "p", "t", "n"])

            for doc, text_hash, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                lines = x.as_py().split(b"\n")
                for k, line in enumerate(lines):
                    if len(line) >= min_chars and long_enough(key := line_key(line), min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        d.append(doc)
                        p.append(k)
                        t.append(text_hash)
                        n.append(len(lines))
                if len(d) > 50_000:
                    yield packed()
                    for x in (digests, d, p, t, n):
                        x.clear()
            yield packed()

    return _keyed(documents, ["d", "t", "x"]).mapInArrow(run, "h1 long, h2 long, d long, p long, t long, n long")


class _Stream:
    """One partition's rows in order of (h1, h2, d descending, p): what to drop, and what its neighbours decide.

    Rows out: kind 0, a line to drop; kind 1, a line to drop if its key turns
    out to be in enough documents and its document not the largest; kind 2, a key
    at the partition's edge: its number of documents (p), its first (d) and last
    document (t) here.
    """

    def __init__(self, min_docs: int):
        self.min_docs, self.key, self.first_key, self.out = min_docs, None, True, []

    def emit(self, kind: int, rows: np.ndarray) -> None:
        if len(rows):
            self.out.append((kind, rows))

    def begin(self, rows: np.ndarray) -> None:
        self.key, self.docs, self.first, self.last, self.held = (rows[0, 0], rows[0, 1]), 0, rows[0, 2], None, []
        self.extend(rows)

    def extend(self, rows: np.ndarray) -> None:
        d = rows[:, 2]
        self.docs += int((d[1:] != d[:-1]).sum()) + (self.last is None or d[0] != self.last)
        self.last = d[-1]
        if self.first_key:  # documents of the partition before may come first
            self.emit(1, rows)
            return
        later = rows[d != self.first]
        if self.docs >= self.min_docs:
            for x in self.held:
                self.emit(0, x)
            self.held = []
            self.emit(0, later)
        elif len(later):
            self.held.append(later)

    def close(self, edge: bool) -> None:
        if self.key is not None and (edge or self.first_key):
            for x in self.held:
                self.emit(1, x)
            self.emit(2, np.array([[*self.key, self.first, self.docs, self.last, 0]], np.int64))
        self.key, self.first_key = None, False

    def add(self, rows: np.ndarray) -> None:
        change = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
        edge = np.concatenate(([0], change, [len(rows)]))
        if self.key == (rows[0, 0], rows[0, 1]):
            self.extend(rows[: edge[1]])
        else:
            if self.key is not None:
                self.close(False)
            self.begin(rows[: edge[1]])
        if len(edge) == 2:
            return
        self.close(False)
        inner = rows[edge[1] : edge[-2]]
        if len(inner):
            starts = edge[1:-2] - edge[1]
            group = np.zeros(len(inner), np.int64)
            group[starts[1:]] = 1
            group = np.cumsum(group)
            new = np.ones(len(inner), np.int64)
            new[1:] = (inner[1:, 2] != inner[:-1, 2]) | (group[1:] != group[:-1])
            docs = np.add.reduceat(new, starts)
            self.emit(0, inner[(docs[group] >= self.min_docs) & (inner[:, 2] != inner[starts, 2][group])])
        self.begin(rows[edge[-2] :])


def keep_bitmaps(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """d, t, n_lines, keep (deflated bits, one for each line) of the documents that lose lines; the others keep all.

    d is doc_id, or NO_ID where it is null; t is xxhash64 of the text: rows that
    repeat an id count as one document, and equal rows lose the same lines.
    """
    spark = documents.sparkSession
    order = [F.col("h1"), F.col("h2"), F.col("d").desc(), F.col("p"), F.col("t")]
    # Stored, as the ranges are found in a pass of their own.
    lines = stored(line_rows(documents, min_chars), "lines")
    dealt = lines.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def stream(batches):
        def packed(found):
            kinds = np.concatenate([np.full(len(rows), kind, np.int32) for kind, rows in found])
            rows = np.concatenate([rows for _, rows in found])
            return pa.RecordBatch.from_arrays([pa.array(kinds), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(6))], names=["kind", "h1", "h2", "d", "p", "t", "n"])

        state = _Stream(min_docs)
        for batch in batches:
            if batch.num_rows:
                state.add(np.column_stack([batch.column(k).to_numpy() for k in range(6)]))
            if state.out:
                yield packed(state.out)
                state.out = []
        state.close(True)
        if state.out:
            yield packed(state.out)

    found = dealt.mapInArrow(stream, "kind int, h1 long, h2 long, d long, p long, t long, n long")
    # By document before they are checkpointed: the ranges are many small files else, and each new file is a process on a local file system.
    waits = F.col("kind") != 0
    known = saved(found.groupBy("kind", F.when(waits, F.col("h1")).alias("h1"), F.when(waits, F.col("h2")).alias("h2"), "d", "t", "n").agg(F.collect_set("p").alias("p")))
    # At most two rows of kind 2 come from a partition.
    edges: dict = {}
    for r in known.where("kind = 2").select("h1", "h2", "d", F.explode("p").alias("p"), "t").collect():
        edges.setdefault((r.h1, r.h2), []).append((r.d, r.t, r.p))
    shared = []
    for key, parts in edges.items():
        parts.sort(key=lambda x: (-x[0], -x[1]))
        docs = sum(n for _, _, n in parts) - sum(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
        if docs >= min_docs:
            shared.append((*key, parts[0][0]))
    lost = known.where("kind = 0").select("d", "t", "n", "p")  # of one document
    if shared:
        decided = spark.createDataFrame(shared, "h1 long, h2 long, largest long")
        late = known.where("kind = 1").join(F.broadcast(decided), ["h1", "h2"]).where("d != largest").select("d", "t", "n", "p")
        lost = lost.union(late).groupBy("d", "t", "n").agg(F.flatten(F.collect_set("p")).alias("p"))

    def bitmap(batches):
        for batch in batches:
            maps = []
            for n, p in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
                bits = np.ones(n, np.uint8)
                bits[p.values.to_numpy()] = 0
                maps.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(maps, pa.binary())], names=["d", "t", "n_lines", "keep"])

    return lost.mapInArrow(bitmap, "d long, t long, n_lines long, keep binary")


def apply_bitmap(text: bytes, keep: bytes | None) -> tuple[bytes, int, int]:
    """(text that stays, lines, lines dropped)."""
    if keep is None:
        return text, text.count(b"\n") + 1, 0
    lines = text.split(b"\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return b"\n".join(lines[k] for k in np.flatnonzero(bits)), len(lines), int(len(lines) - bits.sum())


def dedup_lines(documents: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, row=None, schema: str = "", keep: list[str] | None = None, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """The documents without the lines they lose: all columns, text replaced, with the numbers of lines and of dropped ones as `counts`.

    Each text is split at line ends; a null or empty text is one empty line (and
    stays null or becomes empty as it was).  A line's key is the line without
    white space at either end, A-Z lower-cased; keys of `min_chars` characters
    that at least `min_docs` documents have lose all their lines but those of
    the largest doc_id (a null id is smallest).  Rows that repeat an id count as
    one document; an empty table gives an empty one.  With `row` a function of (text left, lines, dropped) and its
    schema, the columns `keep` and what it returns come back instead.  Columns
    named as an output give way to it.
    """
    ddl = f"text string, `{counts[0]}` long, `{counts[1]}` long" if row is None else schema
    keep = apart(documents.columns if keep is None else keep, counts if row is None else StructType.fromDDL(ddl).names)
    d, t, x, null, bits = (fresh(f"__{c}", keep) for c in ("d", "t", "x", "null", "bits"))
    maps = saved(keep_bitmaps(documents, min_chars, min_docs).select(F.col("d").alias(d), F.col("t").alias(t), F.col("keep").alias(bits)))
    names = [c for c in keep if c != "text" or row]
    given = _keyed(documents, [d, t, x], *names, F.col("text").isNull().alias(null))
    if is_small(maps, bits):
        met = given.join(F.broadcast(maps), [d, t], "left")
    else:  # texts that lose nothing stay where they are
        maybe, same = told_apart(given, F.xxhash64(d, t), maps, F.xxhash64(d, t))
        met = maybe.join(maps, [d, t], "left").unionByName(same, allowMissingColumns=True)
    plain = met.select(*names, null, x, bits)
    out = with_fields(plain.select(*names).schema, ddl)
    types = [pa.string(), pa.int64(), pa.int64()] if row is None else None

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                k = part.num_columns
                rows = []
                for no, text, kept in zip(part.column(k - 3).to_pylist(), part.column(k - 2), part.column(k - 1).to_pylist(), strict=True):
                    left = apply_bitmap(text.as_py(), kept)
                    rows.append(row(*left) if row else (None if no else left[0].decode("utf-8", "replace"), *left[1:]))
                more = [pa.array(list(c), *([types[i]] if types else [])) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-3], *more], names=[f.name for f in out])

    found = plain.mapInArrow(run, out)
    return found if row else found.select(*keep, *counts)
