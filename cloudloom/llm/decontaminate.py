"""Benchmark decontamination by pigeonhole edit matching.

Both sides are lower-cased and runs of white space become one space.  An item of
m characters may differ by k = m * rate edits; it is split into k + 1 pieces (one
more if that makes their number even), of which any match leaves one untouched.
An Aho-Corasick automaton finds exact pieces in one pass over a text.  Each hit
is verified by Myers' bit-parallel distance over ever larger parts of the item: a
part of n pieces may have n - 1 errors, and some piece of every match passes all
the way up to the whole item.  A piece that many items have is followed up only
for those of which half of the piece beside it is there too, as one error at most
leaves one half untouched.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Iterator
from functools import cached_property

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Edits for each character of an item; items of fewer characters have to be there exactly, as whole words.
RATE, MIN_CHARS = 0.1, 20
#: A piece of more owners is followed up by what is beside it.
OWNERS = 4
#: About so many characters of items go to the executors at once; more items take more passes.
BLOCK_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << k
    return out


def myers(pattern: dict[str, int], m: int, text: Iterable[str], anchored: bool = False) -> Iterator[int]:
    """After each character of a text: the least distance between the pattern and what ends here.

    What ends here starts anywhere, or at the text's start if anchored.
    """
    full, top, get = (1 << m) - 1, 1 << m - 1, pattern.get
    plus, minus, score, first = full, 0, m, int(anchored)
    for c in text:
        equal = get(c, 0)
        vertical = equal | minus
        horizontal = ((equal & plus) + plus ^ plus) | equal
        up = minus | full & ~(horizontal | plus)
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | first) & full
        down = down << 1 & full
        plus = down | full & ~(vertical | up)
        minus = up & vertical
        yield score


class Item:
    """A benchmark item, its pieces and the parts that they make."""

    def __init__(self, item_id, text: str, rate: float, min_chars: int):
        self.item_id, self.text, self.size = item_id, text, len(text)
        self.whole_words = len(text) < min_chars
        self.budget = 0 if self.whole_words else int(len(text) * rate)
        self.n = n = self.budget + 1 + (self.budget > 0 and self.budget % 2 == 0)
        self.edge = [len(text) * k // n for k in range(n + 1)]
        self.parts: dict[tuple[int, int], tuple[dict[str, int], int]] = {}

    def pieces(self) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.edge, self.edge[1:], strict=False)]

    def above(self, piece: int) -> Iterator[tuple[int, int, int]]:
        """The parts (first piece, end, budget) that hold a piece, smallest first."""
        size, last = 2, (piece, piece + 1)
        while last != (0, self.n):
            lo = piece // size * size
            part = lo, min(lo + size, self.n)
            if part != last:
                yield *part, self.budget if part == (0, self.n) else part[1] - lo - 1
            size, last = 2 * size, part

    def part(self, lo: int, hi: int) -> tuple[dict[str, int], int]:
        if (lo, hi) not in self.parts:
            text = self.text[self.edge[lo] : self.edge[hi]]
            self.parts[lo, hi] = masks(text), len(text)
        return self.parts[lo, hi]

    @cached_property
    def backwards(self) -> dict[str, int]:
        return masks(self.text[::-1])

    def window(self, text: str, piece: int, at: int) -> tuple[int, int]:
        """What a match whose exact piece is at text[at:] can reach."""
        return max(0, at - self.edge[piece] - self.budget), min(len(text), at + self.size - self.edge[piece] + self.budget)

    def verify(self, text: str, piece: int, at: int) -> tuple[int, int, int] | None:
        """(distance, end, -start) of the nearest match in the window around its exact piece at text[at:], if it is within the budget; of equals the first end, then the shortest."""
        if not self.budget:
            end = at + self.size
            alone = not self.whole_words or not (text[at - 1 : at].isalnum() or text[end : end + 1].isalnum())
            return (0, end, -at) if alone else None
        for lo, hi, budget in self.above(piece):
            pattern, m = self.part(lo, hi)
            start = max(0, at - (self.edge[piece] - self.edge[lo]) - budget)
            window = text[start : at + self.edge[hi] - self.edge[piece] + budget]
            if min(myers(pattern, m, window), default=m) > budget:
                return None
        best, end = min((d, k) for k, d in enumerate(myers(pattern, m, window)))
        before = window[: end + 1][::-1]
        length = next(k for k, d in enumerate(myers(self.backwards, m, before, True)) if d == best) + 1
        return best, start + end + 1, length - start - end - 1


class Owners:
    """The many (item, piece) pairs of one piece, by halves of the piece beside it."""

    def __init__(self, owners: list[tuple[int, int]], items: list[Item]):
        self.by_half: dict[tuple, list[tuple[int, int]]] = {}
        self.always = []
        for k, p in owners:
            item = items[k]
            if item.n == 1:
                self.always.append((k, p))
                continue
            right = p % 2 == 0
            a, b = item.edge[p ^ 1], item.edge[(p ^ 1) + 1]
            half, size = (a + b) // 2, b - a
            near, far = ((a, half), (half, b)) if right else ((half, b), (a, half))
            for (x, y), gap in (near, 0), (far, size - (far[1] - far[0])):
                for shift in (-1, 0, 1) if gap else (0,):
                    self.by_half.setdefault((right, gap + shift, y - x), {}).setdefault(item.text[x:y], []).append((k, p))

    def beside(self, text: str, at: int, end: int) -> Iterable[tuple[int, int]]:
        found = set(self.always)
        for (right, gap, size), known in self.by_half.items():
            x = end + gap if right else at - gap - size
            if x >= 0 and (own := known.get(text[x : x + size])):
                found.update(own)
        return sorted(found)


class Matcher:
    def __init__(self, items: Iterable[tuple], rate: float, min_chars: int):
        self.items = [Item(i, text, rate, min_chars) for i, raw in items if (text := normal(raw))]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for p, piece in enumerate(item.pieces()):
                pieces.setdefault(piece, []).append((k, p))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners if len(owners) <= OWNERS else Owners(owners, self.items)))
        self.automaton.make_automaton()

    def search(self, text: str, any_will_do: bool = False) -> dict[int, tuple[int, int, int]]:
        """(distance, start, end) of the nearest match of each item, by its number, that a normal text holds; or of any one match."""
        found: dict[int, tuple[int, int, int]] = {}
        seen: dict[int, tuple[int, int]] = {}
        if not self.items:
            return found
        for last, (n, owners) in self.automaton.iter(text):
            at = last - n + 1
            for k, p in owners.beside(text, at, last + 1) if isinstance(owners, Owners) else owners:
                item, best = self.items[k], found.get(k)
                if best and not best[0] and best[1] <= last:  # nothing is nearer, nor equal and before it
                    continue
                lo, hi = item.window(text, p, at)
                if k in seen and seen[k][0] <= lo and hi <= seen[k][1]:
                    continue
                if hit := item.verify(text, p, at):
                    seen[k] = lo, hi
                    found[k] = min(best or hit, hit)
                    if any_will_do:
                        break
            if any_will_do and found:
                break
        return {k: (d, -s, e) for k, (d, e, s) in found.items()}


_kept: tuple = (None, None)


def matcher(key: str, items: Broadcast, rate: float, min_chars: int) -> Matcher:
    """Built once in a worker process for the tasks on the same items."""
    global _kept
    if _kept[0] != key:
        _kept = key, Matcher(items.value, rate, min_chars)
    return _kept[1]


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[str, Broadcast]]:
    """A key and the items of each block of about `block_chars` characters, as a broadcast: the driver keeps one block at a time in memory."""
    spark = benchmark.sparkSession
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    n = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / block_chars))
    for k in range(n):
        yield uuid.uuid4().hex, spark.sparkContext.broadcast([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()])


def find(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, distance, start, end (in the normal text) for each document and item that it holds: the nearest match, the first end of equals, the shortest of these.

    An item of fewer than `min_chars` characters matches where it stands exactly
    and as whole words; null and blank items match nothing, null and empty texts
    hold nothing, and an empty table of either kind gives no row.  Texts are read
    whole, however long.  Rows that repeat a doc_id or an item_id count together.
    """
    given = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    schema = given.select("doc_id").schema
    schema.add(benchmark.schema["item_id"]).add("distance", "integer").add("start", "long").add("end", "long")
    item_type, out = to_arrow_type(benchmark.schema["item_id"].dataType), None
    for key, items in blocks(benchmark, block_chars):

        def run(batches, key=key, items=items):
            own = matcher(key, items, rate, min_chars)
            for batch in batches:
                rows = []
                for k, x in enumerate(batch.column(1)):
                    rows += [(k, own.items[i].item_id, *hit) for i, hit in own.search(normal(x.as_py())).items()]
                c = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(c[0], pa.int64())), pa.array(list(c[1]), item_type), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64())], names=[f.name for f in schema])

        part = given.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    best = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "end", (-F.col("start")).alias("start"))).alias("m"))
    return best.select("doc_id", "item_id", "m.distance", (-F.col("m.start")).alias("start"), "m.end")


def without_leaks(documents: DataFrame, benchmark: DataFrame, rate: float = RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item, all columns, without a shuffle; null and empty texts hold none, and repeated rows stay or go together."""
    for key, items in blocks(benchmark, block_chars):
        at = documents.columns.index("text")

        def run(batches, key=key, items=items, at=at):
            own = matcher(key, items, rate, min_chars)
            for batch in batches:
                yield batch.filter(pa.array([not own.search(normal(x.as_py()), True) for x in batch.column(at)], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents
