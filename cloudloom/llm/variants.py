"""Spelling variants: words that differ by one character, and the form that the others are variants of.

Words are counted by Spark.  Ranges of the vocabulary become compact tries, of a
bounded size each; blocks of such shards are broadcast, and each word's automaton
for distance one goes through every shard depth-first and gives the words that it
accepts.  What a word finds is reduced to a count and its best neighbour before
anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import partitions, saved, stored

MIN_CHARS, MIN_COUNT, TIMES = 5, 3, 2
RUNS = r"[A-Za-zÀ-ÿ]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A shard has so many words and characters at most (one word more where a word alone is longer); a block of shards so many bytes.
SHARD_WORDS, SHARD_CHARS, BLOCK_BYTES = 65_536, 1 << 20, 32 << 20


def runs(documents: DataFrame, every: int = 97) -> DataFrame:
    """word, for each maximal run of letters (A-Z, a-z, U+00C0 to U+00FF) in whole texts, with A-Z in lower case.

    Where `every` divides the CRC32 of `<doc_id>:<word>`, the code point at that
    checksum modulo the word's length is taken out (`every` 0: nowhere), as a
    stand-in for typing errors; a run of one letter then is an empty word.  Null
    texts have none; a null id counts as empty.
    """
    word = F.explode(F.regexp_extract_all(F.translate(F.col("text"), _UPPER, _UPPER.lower()), F.lit(RUNS), F.lit(0)))
    found = documents.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), word.alias("w"))
    if not every:
        return found.select(F.col("w").alias("word"))
    h = found.withColumn("h", F.crc32(F.concat("i", F.lit(":"), "w").cast("binary")))
    at = (F.col("h") % F.length("w")).cast("int")
    less = F.concat(F.substring(F.col("w"), F.lit(1), at), F.substring(F.col("w"), at + 2, F.length("w")))
    return h.select(F.when(F.col("h") % every == 0, less).otherwise(F.col("w")).alias("word"))


def vocabulary(words: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the distinct words of at least so many code points that occur so often."""
    counts = words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= min_count)


@dataclass(frozen=True)
class Trie:
    """A trie level by level: the nodes of a level in order, so that a node's children stand together.

    labels: the letter that leads to each node but the root (node k + 1 has label
    k); first: where each node's children begin among the labels; n: how often the
    word that ends at a node occurs, 0 if none does.  Letters are one byte each.
    """

    labels: bytes
    first: np.ndarray | memoryview
    n: np.ndarray | memoryview

    def pack(self) -> bytes:
        return len(self.n).to_bytes(8, "little") + self.first.tobytes() + self.n.tobytes() + self.labels

    @staticmethod
    def unpack(blob: bytes) -> Trie:
        size = int.from_bytes(blob[:8], "little")
        at = 8 + 4 * (size + 1)
        view = memoryview(blob)
        return Trie(blob[at + 8 * size :], view[8:at].cast("i"), view[at : at + 8 * size].cast("q"))


def build(words: list[bytes], n: list[int]) -> Trie:
    """The trie of distinct sorted words."""
    level, word, label, end = [], [], [], []
    before = b""
    for k, w in enumerate(words):
        shared, most = 0, min(len(before), len(w))
        while shared < most and before[shared] == w[shared]:
            shared += 1
        level.append(np.arange(shared, len(w)))
        word.append(np.full(len(w) - shared, k))
        label.append(np.frombuffer(w, np.uint8)[shared:])
        end.append(np.where(np.arange(shared, len(w)) == len(w) - 1, n[k], 0))
        before = w
    depth, word, label, end = (np.concatenate(x) for x in (level, word, label, end))
    order = np.argsort(depth, kind="stable")  # nodes were made word by word; now level by level
    depth, word = depth[order], word[order]
    # A node's parent is the last node of the level above that was made for the same or an earlier word.
    key = depth * (len(words) + 1) + word
    parent = np.searchsorted(key, key - (len(words) + 1), "right")  # 0, the root, for the first level
    children = np.bincount(parent, minlength=len(depth) + 1)
    first = np.concatenate(([0], np.cumsum(children))).astype(np.int32)
    return Trie(label[order].tobytes(), first, np.concatenate(([0], end[order])).astype(np.int64))


class Search:
    """One trie, ready to be gone through."""

    def __init__(self, trie: Trie):
        self.labels, self.first, self.n = trie.labels, trie.first, trie.n

    def near(self, word: bytes) -> Iterator[tuple[bytes, int]]:
        """(neighbour, n) for the words at a distance of exactly one.

        The automaton's states are (letters read, edits made).  An edit is made only
        where the neighbour first differs from the word, so that each is reached in
        one way: a letter more or another one differs from the word's next letter, and
        the letter left out differs from the one after it.
        """
        labels, first, n = self.labels, self.first, self.n
        node, size = 0, len(word)
        for i in range(size + 1):
            a, b = first[node], first[node + 1]
            here = word[i] if i < size else -1
            if i < size and (i + 1 == size or word[i + 1] != here):
                found = self.rest(node, word, i + 1)
                if found:
                    yield word[:i] + word[i + 1 :], found
            for k in range(a, b):
                letter = labels[k]
                if letter == here:
                    continue
                if i < size:
                    found = self.rest(k + 1, word, i + 1)
                    if found:
                        yield word[:i] + bytes((letter,)) + word[i + 1 :], found
                found = self.rest(k + 1, word, i)
                if found:
                    yield word[:i] + bytes((letter,)) + word[i:], found
            k = labels.find(here, a, b) if here >= 0 else -1
            if k < 0:
                return
            node = k + 1

    def rest(self, node: int, word: bytes, i: int) -> int:
        """n of the word that the rest of `word` leads to from a node, 0 if none."""
        labels, first = self.labels, self.first
        for i in range(i, len(word)):
            k = labels.find(word[i], first[node], first[node + 1])
            if k < 0:
                return 0
            node = k + 1
        return self.n[node]


def shards(words: DataFrame) -> DataFrame:
    """trie (packed), size: one row for each range of the vocabulary, made where the range is.

    A range is cut wherever SHARD_WORDS words or SHARD_CHARS characters are full, so
    that no shard depends on how many words there are.
    """
    spark = words.sparkSession
    ranges = words.repartitionByRange(partitions(spark), "word").sortWithinPartitions("word")

    def run(batches):
        some, counts, chars = [], [], 0

        def row():
            blob = build(some, counts).pack()
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.array([len(blob)], pa.int64())], names=["trie", "size"])

        for batch in batches:
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = w.encode("latin-1")
                if some and (len(some) >= SHARD_WORDS or chars + len(w) > SHARD_CHARS):
                    yield row()
                    some, counts, chars = [], [], 0
                some.append(w)
                counts.append(n)
                chars += len(w)
        if some:
            yield row()

    return stored(ranges.select("word", "n").mapInArrow(run, "trie binary, size long"), "tries")


def blocks(tries: DataFrame) -> Iterator[list[bytes]]:
    """The shards in blocks of about BLOCK_BYTES, one block after another."""
    held, size = [], 0
    for r in tries.toLocalIterator():
        if held and size + r["size"] > BLOCK_BYTES:
            yield held
            held, size = [], 0
        held.append(bytes(r["trie"]))
        size += r["size"]
    if held:
        yield held


def better(a: tuple[int, bytes] | None, b: tuple[int, bytes]) -> bool:
    """Whether the neighbour b = (n, word) comes before a: more frequent, or as frequent and smaller."""
    return a is None or b[0] > a[0] or (b[0] == a[0] and b[1] < a[1])


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best_n, best: for each word with a neighbour at distance one, their number and the most frequent one (ties: the smallest).

    Each block of shards is broadcast, searched by all words, and given up.
    """
    spark = words.sparkSession
    spread = words.select("word").repartition(partitions(spark), "word")
    found = []
    for block in blocks(shards(words)):
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            searches = [Search(Trie.unpack(x)) for x in shared.value]
            for batch in batches:
                rows: list[tuple[str, int, int, str]] = []
                for text in batch.column(0).to_pylist():
                    w, near, best = text.encode("latin-1"), 0, None
                    for search in searches:
                        for v, n in search.near(w):
                            near += 1
                            if better(best, (n, v)):
                                best = n, v
                    if best:
                        rows.append((text, near, best[0], best[1].decode("latin-1")))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "n", "best"])

        found.append(stored(spread.mapInArrow(run, "word string, near long, n long, best string"), "neighbours"))
        shared.destroy()
    if not found:
        return spark.createDataFrame([], "word string, n_near long, best_n long, best string")
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    first = F.min(F.struct((-F.col("n")).alias("n"), "best"))
    return every.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("f")).select("word", "n_near", (-F.col("f.n")).alias("best_n"), F.col("f.best").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: where the links (word, form), one a word and without circles, lead in the end.  Each step doubles how far all have come."""
    now = saved(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = saved(now.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n, root for each row of a vocabulary (word, n; words are distinct and of letters up to U+00FF).

    Two words are near if one inserted, deleted or replaced code point makes one of
    the other.  form is the near word of largest n (ties: the smallest in order of
    code points) where that is at least `times` (2 or more) the word's own n, form_n its n; both
    null otherwise.  root is the last word that forms lead to, the word itself
    without a form.  n_near is 0 for a word alone; an empty vocabulary gives an
    empty table.
    """
    words = stored(words.select("word", "n"), "vocabulary")
    near = neighbours(words)
    good: Column = F.col("best_n") >= times * F.col("n")
    linked = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n"))
    linked = stored(linked, "variants")
    ends = roots(linked.where("form is not null"))
    return linked.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def grouped(groups: DataFrame) -> DataFrame:
    """root, n_words, n: the groups of words that lead to the same root, and how often their words occur together."""
    return groups.groupBy("root").agg(F.count("*").alias("n_words"), F.sum("n").alias("n"))
