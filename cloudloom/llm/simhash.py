"""SimHash near-duplicates, found by fuzzy hashing with the binary Golay code.

The (23, 12) Golay code is perfect: each word of 23 bits is within 3 errors of
exactly one codeword.  Decoding a segment of a fingerprint and its 23 neighbours
gives one or six codeword indices; two segments that differ in 2 bits at most
share one.  A fingerprint of 64 bits is cut into three segments (22, 21 and 21
bits).  With 3 errors at most, either some segment is free of errors and the one
after it has 2 at most (the pigeonhole, as the segments stand in a ring), or
each segment has exactly one.  The keys of the first case are an exact segment
and a codeword index of the next one; those of the second are a codeword index
of the first segment and an exact half of each of the others.  Rows that share a
key meet; links are verified by their distance.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import released, with_fields
from .shared import components, is_small, partitions, saved, stored, told_apart, without

SHINGLE, BITS, SEED = 3, 3, 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 20
#: Fixed value: the generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, bits)


# --- fingerprints -------------------------------------------------------------


def _words(text: bytes):
    """Lists of the words of a text, a megabyte at a time."""
    if len(text) <= _CHUNK:
        yield text.translate(_LOWER).split()
        return
    at, rest = 0, b""
    while at < len(text):
        part = rest + text[at : at + _CHUNK].translate(_LOWER)
        at += _CHUNK
        words = part.split()
        rest = b""
        if words and at < len(text) and part[-1:] not in b" \t\n\r\x0b\x0c":
            rest = words.pop()
        yield words


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits; a bit is 1 if it is set in over half of the hashes of the shingles; 0 if there are no words."""
    total, n, carried = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    few: list[bytes] = []
    for words in _words(text):
        words = carried + words
        if len(words) < shingle:
            carried = few = words
            continue
        hashes = np.array([digest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))], np.uint64)
        for lo in range(0, len(hashes), 8192):
            total += np.unpackbits(hashes[lo : lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
        carried = words[len(words) - shingle + 1 :] if shingle > 1 else []
    if not n:
        if not few:
            return 0
        return digest(b" ".join(few), SEED)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row; a null text is empty."""
    given = documents.select(F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return given.mapInArrow(run, given.select("doc_id").schema.add("fp", "long"))


# --- keys ---------------------------------------------------------------------


@cache
def syndromes() -> np.ndarray:
    """The error pattern of 3 bits at most for each of the 2048 remainders."""
    table = np.zeros(2048, np.int64)
    ones = [1 << k for k in range(23)]
    errors = [0, *ones, *(a | b for i, a in enumerate(ones) for b in ones[:i]), *(a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[:i]) for c in ones[:j])]
    table[remainder(np.array(errors))] = errors
    return table


def remainder(word: np.ndarray) -> np.ndarray:
    """Of words of 23 bits, divided by the generator polynomial."""
    word = word.copy()
    for k in range(22, 10, -1):
        word ^= np.where(word >> k & 1, GOLAY << k - 11, 0)
    return word


def decode(word: np.ndarray) -> np.ndarray:
    """The index, of 12 bits, of the nearest codeword."""
    return (word ^ syndromes()[remainder(word)]) >> 11


def nearby(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) of the codewords that a word or a word one bit away decodes to: one or six for each."""
    found = np.sort(np.column_stack([decode(word), *(decode(word ^ (1 << k)) for k in range(23))]), 1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    row, column = np.nonzero(first)
    return row, found[row, column]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) pairs: fingerprints within 3 bits of each other share a key."""
    fp = fp.view(np.uint64)
    part = [((fp >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64) for lo, n in SEGMENTS]
    near = [nearby(p) for p in part]
    out = []
    for k in range(3):
        row, index = near[(k + 1) % 3]
        out.append((k << 60 | index << 24 | part[k][row], row))
    row, index = near[0]
    for k in range(4):
        half = [(p >> 11 if k >> i & 1 else p & 2047)[row] for i, p in enumerate(part[1:])]
        out.append((3 + k << 60 | index << 24 | half[0] << 12 | half[1], row))
    return np.concatenate([k for k, _ in out]), np.concatenate([r for _, r in out])


# --- links --------------------------------------------------------------------


#: A bucket of more fingerprints is split by parts of the bits in which they differ.
BIG = 2_048


def forest(fp: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Links that connect what links of `bits` bits at most connect.

    Found breadth first; in a big bucket by parts: the bits in which its
    fingerprints differ are dealt into bits + 1 groups, and two fingerprints
    that link have the same bits in one of the groups at least.
    """
    rest = fp.view(np.uint64)
    if len(rest) > BIG:
        varies = int(np.bitwise_or.reduce(rest ^ rest[0]))
        places = [k for k in range(64) if varies >> k & 1]
        if len(places) > bits:
            links = []
            for k in range(bits + 1):
                key = rest & np.uint64(sum(1 << p for p in places[k :: bits + 1]))
                order = np.argsort(key, kind="stable")
                edge = np.concatenate(([0], np.flatnonzero(np.diff(key[order])) + 1, [len(key)]))
                for lo, hi in zip(edge, edge[1:], strict=False):
                    if hi - lo > 1:
                        links += forest(fp[order[lo:hi]], bits)
            return links
    links, signed = [], np.int64
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= bits
            if near.any():
                found = rest[near]
                rest = rest[~near]
                links += [(int(at.astype(signed)), int(x)) for x in found.astype(signed)]
                front.extend(found)
    return links


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): verified links between distinct fingerprints, enough to connect each group, in any bucket.

    A bucket holds distinct fingerprints that share 33 bits of key, 8 bytes each,
    and is worked off breadth first, a big one in parts, so that a large group of
    copies gives trees and not all its pairs.
    """
    if bits > BITS:
        raise ValueError(f"the keys find fingerprints that differ in {BITS} bits at most")

    def spread(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            for lo in range(0, len(fp), 4096):
                k, row = keys(fp[lo : lo + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp[lo : lo + 4096][row])], names=["k", "fp"])

    dealt = distinct.select("fp").mapInArrow(spread, "k long, fp long").repartition(partitions(distinct.sparkSession), "k").sortWithinPartitions("k", "fp")

    def meet(batches):
        held_k, held = None, []

        def of(groups):
            found = [x for fp in groups for x in forest(fp, bits)]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            k, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(k):
                continue
            edge = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))
            groups = []
            if k[0] == held_k:
                held.append(fp[: edge[1]])
            else:
                groups.append(np.concatenate(held) if held else fp[:0])
                held_k, held = k[0], [fp[: edge[1]]]
            if len(edge) > 2:
                groups.append(np.concatenate(held))
                size = np.diff(edge)
                two = edge[1:-2][size[1:-1] == 2]
                close = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= bits]
                yield pa.RecordBatch.from_arrays([pa.array(fp[close]), pa.array(fp[close + 1])], names=["a", "b"])
                groups += [fp[edge[g] : edge[g + 1]] for g in range(1, len(size) - 1) if size[g] > 2]
                held_k, held = k[-1], [fp[edge[-2] :]]
            yield of(g for g in groups if len(g) > 1)
        if held:
            yield of([np.concatenate(held)])

    return dealt.mapInArrow(meet, "a long, b long").distinct()


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links of `bits` bits) of every row.

    Words are what white space separates, A-Z lower-cased; a text of fewer words
    than a shingle is one shingle, and one without words (a null text too) has
    fingerprint 0 and links like any other.  Equal fingerprints always link, so
    repeated rows share a component.  A null doc_id counts only where a whole
    component has no other: its component_id is then null.  Texts are read whole, in
    parts of a megabyte; an empty table gives an empty one; other columns don't matter.
    """
    prints = saved(fingerprints(documents, shingle))
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, bits))
    inner = distinct.join(roots, distinct.fp == roots.node).groupBy("root").agg(F.min("least").alias("component_id"))
    found = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", "root").join(inner, "root", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    """16 lower-case digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(documents: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """The rows of the documents whose doc_id is their component's smallest, all columns.

    What is dropped moves as ids only, and texts stay where they are but for those
    of ids that are dropped (see shared.without).  Rows that repeat an id stay or go
    together.  Rows with a null id stay.
    """
    marked = near_duplicates(documents, shingle, bits)
    return without(documents, marked.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct())


# --- near copies ----------------------------------------------------------------

#: Of a near copy: words of a shingle, and the least share of the shingles of two texts that both have, as a fraction.
WORDS, SIMILAR = 5, (4, 5)
#: Counters that shingles are hashed to for their order, and how many of them a row holds on its way; bits of a sketch.
COUNTERS, BLOCK, SKETCH = 1 << 20, 1 << 12, 1024


def shingles(text: bytes, shingle: int = WORDS) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; a text of fewer words is one shingle, and one without words has none."""
    found, carried, short = [], [], True
    for words in _words(text):
        words = carried + words
        if len(words) >= shingle:
            short = False
            found.append(np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))], np.uint64)))
            words = words[len(words) - shingle + 1 :]
        carried = words
    if short:
        return np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)] if carried else [], np.uint64)
    return np.unique(np.concatenate(found))


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets, as sorted arrays, have SIMILAR of their union in common."""
    least, of = SIMILAR
    if of * min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return of * both >= least * (len(x) + len(y) - both)


def counters(texts: DataFrame) -> np.ndarray:
    """How many shingles of all texts fall on each of the COUNTERS; partial sums for each task, COUNTERS numbers on the driver."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(total, (shingles(x.as_py()) % np.uint64(COUNTERS)).astype(np.int64), 1)
        yield from packed(total.reshape(-1, BLOCK), np.flatnonzero(total.reshape(-1, BLOCK).any(1)))

    def packed(blocks, places):
        for k in places:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([blocks[k].tobytes()], pa.binary())], names=["block", "n"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[k] = total.get(k, 0) + np.frombuffer(n.as_buffer(), np.int64)
        yield from packed(total, total)

    sums = texts.select("text").mapInArrow(count, "block long, n binary").repartition("block").mapInArrow(add, "block long, n binary")
    found = np.zeros((COUNTERS // BLOCK, BLOCK), np.int64)
    for row in sums.collect():
        found[row.block] = np.frombuffer(row.n, np.int64)
    return found.reshape(-1)


def prefix(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """(the shingles by which a set meets others, rarest first; how many of them meet sets that are no smaller).

    Two similar sets of n <= m shingles have 4/9 (n + m) in common at least:
    8/9 n and 4/5 m.  So in any order of all shingles, one of the first
    n - 8/9 n + 1 of the smaller is among the first m - 4/5 m + 1 of the larger.
    """
    least, of = SIMILAR
    n = len(hashes)
    if not n:
        return hashes, 0
    longer, equal = n - -(-least * n // of) + 1, n - -(-2 * least * n // (least + of)) + 1
    order = np.lexsort((hashes, counts[(hashes % np.uint64(COUNTERS)).astype(np.int64)]))
    return hashes[order[:longer]], equal


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH bits as 64-bit numbers, each the parity of the hashes that fall on it: two sketches differ in no more bits than the sets in elements."""
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def _entries(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, k, pos and n of each shingle k by which a row meets others, by k: n is the size of its set, in which so many shingles are rarer than k."""
    spark = texts.sparkSession
    known = spark.sparkContext.broadcast(counts.astype(np.min_scalar_type(counts.max())))
    of_id = texts.select("doc_id").schema

    def spread(batches):
        for batch in released(batches):
            rows: list[tuple] = []
            held = 0
            for at, x in enumerate(batch.column(1)):
                own = shingles(x.as_py())
                front, _ = prefix(own, known.value)
                rows.append((at, front, len(own)))
                held += len(front)
                if held > 1 << 18:
                    yield packed(batch, rows)
                    rows, held = [], 0
            if rows:
                yield packed(batch, rows)

    def packed(batch, rows):
        size = [len(front) for _, front, _ in rows]
        columns = [
            batch.column(0).take(pa.array(np.repeat([at for at, _, _ in rows], size))),
            pa.array(np.concatenate([front for _, front, _ in rows]).view(np.int64)),
            pa.array(np.concatenate([np.arange(n) for n in size]).astype(np.int32)),
            pa.array(np.repeat([n for _, _, n in rows], size).astype(np.int32)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "k", "pos", "n"])

    return texts.mapInArrow(spread, with_fields(of_id, "k long, pos int, n int")).repartition(partitions(spark), "k")


def _stars(entries: DataFrame) -> DataFrame:
    """(a, na, b, nb): each row b of a shingle and the smallest set a that it meets there, with the sizes of their sets."""
    kind = entries.schema["doc_id"].dataType.simpleString()

    def meet(batches):
        centre = None  # the first row of the newest key
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([centre, batch] if centre is not None else [batch]).combine_chunks()
            k = table.column("k").to_numpy()
            edge = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))
            heads = np.repeat(edge, np.diff(np.append(edge, len(k))))
            later = table.column("later").to_numpy(zero_copy_only=False)
            member = np.flatnonzero((heads != np.arange(len(k))) & ~later[heads])
            centre = table.slice(edge[-1], 1).to_batches()[0]
            if len(member):
                a, b = table.take(pa.array(heads[member])), table.take(pa.array(member))
                columns = [a["doc_id"], a["n"], b["doc_id"], b["n"]]
                yield from pa.Table.from_arrays(columns, names=["a", "na", "b", "nb"]).combine_chunks().to_batches()

    return entries.select("doc_id", "k", (~_enough("n", "pos", "n")).alias("later"), "n").sortWithinPartitions("k", "later", "n", "doc_id").mapInArrow(meet, f"a {kind}, na int, b {kind}, nb int")


def _may_be_similar(n: str, m: str) -> Column:
    least, of = SIMILAR
    return F.col(n) * of >= F.col(m) * least


def _enough(n: str, pos: str, m: str) -> Column:
    """Whether a set of n that shares nothing with one of m before its shingle at pos has shingles enough left to be similar."""
    least, of = SIMILAR
    return (F.col(n) - F.col(pos)).cast("long") * (least + of) >= (F.col(n).cast("long") + F.col(m)) * least


def _meetings(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b): rows of different groups that share a shingle, by the first of which they may be similar; not distinct.

    Two similar sets have 4/9 (n + m) in common at least, all of it at or after
    the first shingle that both have.  So that shingle has as many at or after it
    in either set, and a pair that another shingle brings together, of which
    this isn't so, is left out there.
    """
    named = entries.select("k", F.col("doc_id").alias("id"), "n", "pos", _enough("n", "pos", "n").alias("first"))
    named = named.join(F.broadcast(roots) if is_small(roots) else roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    by_k = Window.partitionBy("k")
    mixed = named.withColumn("lo", F.min("root").over(by_k)).withColumn("hi", F.max("root").over(by_k)).withColumn("any", F.max("first").over(by_k)).where("any AND lo != hi")
    of_group = saved(mixed.groupBy("k", "id", "n", "first", "root").agg(F.min("pos").alias("pos")))
    # Shingles that the same rows share count once, in the place of a row's rarest.
    same = of_group.groupBy("k").agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64("id", "first")).alias("x"), F.bit_xor(F.xxhash64("first", "id", "n")).alias("y"))
    by = ["rows", "x", "y"]
    left = of_group.join(same, "k").groupBy(*by, "id", "n", "first", "root").agg(F.min("pos").alias("pos"))
    right = left.select(*by, *(F.col(c).alias(f"{c}_") for c in ("id", "n", "pos", "root")))
    once = (F.col("n") < F.col("n_")) | ((F.col("n") == F.col("n_")) & (F.col("id") < F.col("id_")))
    return (
        left.where("first")
        .join(right, by)
        .where((F.col("root") != F.col("root_")) & once & _may_be_similar("n", "n_") & _enough("n", "pos", "n_") & _enough("n_", "pos_", "n"))
        .select(F.least("id", "id_").alias("a"), F.greatest("id", "id_").alias("b"))
    )


def near_copies(documents: DataFrame) -> DataFrame:
    """(a, b): verified links between doc_ids whose texts share SIMILAR of their shingles, enough to connect all that such links connect.

    Candidates share one of their rarest shingles (see `prefix`), so no link is
    missed.  The order is by counters that all shingles are hashed to; which one
    it is matters for the work only.  A shingle's rows meet its smallest set
    first; where what links then connects still leaves several groups under a
    shingle, the rows of different groups meet in pairs (see `_meetings`), so that
    a group of copies makes no more pairs than rows.  Pairs are judged by their sizes and
    sketches, and by their whole sets where these can't tell.

    Null ids and texts have no links, and texts without words none either.
    Repeated rows count once; rows that share an id and differ in their texts
    link by any of them.  Texts are read whole, in parts of a megabyte, an empty
    table has no links, and other columns don't matter.
    """
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("text"))
    entries = _entries(texts, counters(texts))
    tried = saved(
        _stars(entries).where((F.col("a") != F.col("b")) & (F.col("na") <= F.col("nb")) & _may_be_similar("na", "nb")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    links = saved(_verified(tried, _sets_of(texts, tried)))

    roots = saved(components(links).toDF("id", "root"))
    left_over = saved(_meetings(entries, roots).distinct().join(tried, ["a", "b"], "left_anti"))
    return links.union(_verified(left_over, _sets_of(texts, left_over))).distinct()


def _sets_of(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets of the rows that stand in pairs, stored; of texts, at most those move that a bit array finds among them."""
    wanted = saved(pairs.select("a").union(pairs.select("b")).distinct().toDF("doc_id"))
    if is_small(wanted):
        found = texts.join(F.broadcast(wanted), "doc_id", "left_semi")
    else:
        maybe, _ = told_apart(texts, F.xxhash64("doc_id"), wanted, F.xxhash64("doc_id"))
        found = maybe.join(wanted, "doc_id", "left_semi")
    return stored(_sets(found), "shingle-sets")


def _sets(texts: DataFrame) -> DataFrame:
    """doc_id, n, bits (the sketch) and s (the sorted hashes) of each text."""

    def hashed(batches):
        for batch in released(batches):
            held, start, size = [], 0, 0
            for at, x in enumerate(batch.column(1)):
                held.append(shingles(x.as_py()))
                size += len(held[-1])
                if size > 1 << 19 or at == batch.num_rows - 1:
                    columns = [
                        batch.column(0).slice(start, len(held)),
                        pa.array([len(s) for s in held], pa.int32()),
                        pa.array([sketch(s) for s in held], pa.list_(pa.int64())),
                        pa.array([s.view(np.int64) for s in held], pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "bits", "s"])
                    held, start, size = [], at + 1, 0

    return texts.mapInArrow(hashed, with_fields(texts.select("doc_id").schema, "n int, bits array<long>, s array<long>"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose sets are similar: sketches go first, since two similar sets of n and m differ in (n + m) / 9 elements at most."""
    least, of = SIMILAR
    narrow = sets.select("doc_id", "n", "bits")
    differ = sum((F.bit_count(F.col("p")[k].bitwiseXOR(F.col("q")[k])) for k in range(SKETCH // 64)), F.lit(0))
    close = (
        pairs.join(narrow.toDF("a", "n", "p"), "a")
        .join(narrow.toDF("b", "m", "q"), "b")
        .where(_may_be_similar("n", "m") & _may_be_similar("m", "n") & (differ * (least + of) <= (F.col("n") + F.col("m")) * (of - least)))
        .select("a", "b")
        .distinct()
    )

    def judged(batches):
        for batch in batches:
            keep = [similar(x.values.to_numpy(), y.values.to_numpy()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["a", "b"])

    whole = sets.select("doc_id", F.col("s"))
    both = close.join(whole.toDF("a", "s"), "a").join(whole.toDF("b", "t"), "b").select("a", "b", "s", "t")
    return both.mapInArrow(judged, pairs.schema).distinct()


def one_of_near_copies(documents: DataFrame) -> DataFrame:
    """The rows of the documents but for those that links of near copies connect with a smaller doc_id, all columns.

    Rows that repeat an id stay or go together; null ids and texts stay; an empty
    table gives an empty one (see `near_copies`).
    """
    roots = components(near_copies(documents))
    return without(documents, roots.where(F.col("node") != F.col("root")).select("node"))
