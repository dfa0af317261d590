"""SentencePiece encoding and decoding, with exact N-best segmentations.

The lattice of a text has an edge for each piece of the vocabulary at each place,
with the piece's score, and an edge for each unknown character, which becomes
byte pieces.  No piece has a space after another character, nor a line end, so
the lattice is a chain of independent ones, one for each chunk of a text.  Equal
chunks are solved once, and kept for the batches to come: a forward Viterbi pass
over all new ones in numpy gives best scores, and, where more than the best are
asked for, a backward pass the loss of each chunk's second best.  The N best of a text change only the N - 1 chunks whose second best loses
least; for these, A-star runs backward from the end of the chunk with the
forward scores as exact heuristics, and what it finds is combined.

Spaces stand for themselves and the sign U+2581 of a text becomes byte pieces,
so that decoding gives back every text exactly.  Pieces are matched in texts as
they are: the vocabulary's own normaliser has to be the identity.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import apart, fresh, released, with_fields

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: An unknown character's score is so much below the least piece's.
UNKNOWN = 10.0
_CHUNK = re.compile(r" *[^ \n]+| +|\n")
#: Chunks of more characters are solved one by one.
LONG = 40
BATCH_CHARS = 1_000_000
#: A task keeps about so many solved chunks.
KEPT = 100_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray, by: int, bits: int) -> np.ndarray:
    return (((h ^ (h >> np.uint64(31))) * np.uint64(by)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Vocabulary:
    """Pieces by id: text (spaces for U+2581; None for control, unknown and byte pieces), score, and the ids of the byte pieces."""

    texts: list[str | None]
    scores: list[float]
    bytes_: list[int]  # id of each byte's piece, or empty
    unknown: int
    prefix: bool = True  # whether a space is put before a text
    ids: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.ids = {}
        for k, t in enumerate(self.texts):
            if t is not None:
                self.ids.setdefault(t, k)
        self.longest = max(map(len, self.ids))
        self.low = min(self.scores[k] for k in self.ids.values()) - UNKNOWN
        # Beginnings of pieces that are no pieces themselves have the number -2.
        begun = dict.fromkeys((t[:k] for t in self.ids for k in range(1, len(t))), -2) | self.ids
        h = np.array([self.hash_of(t) for t in begun], np.uint64)
        ids = np.array(list(begun.values()), np.int32)
        self.tables = []
        for _ in range(64):
            if not len(h):
                break
            by, bits = 0xD6E8FEB86659FD93 + 2 * len(self.tables), 18 if not self.tables else 12
            slot = _mixed(h, by, bits)
            key, value = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            _, first = np.unique(slot, return_index=True)
            key[slot[first]], value[slot[first]] = h[first], ids[first]
            self.tables.append((by, bits, key, value))
            rest = np.ones(len(h), bool)
            rest[first] = False
            h, ids = h[rest], ids[rest]
        score = np.array(self.scores)
        self.score = np.append(score, self.low)  # at -1: unknown
        self.raw: list[bytes] = [b"" if t is None else t.encode() for t in self.texts]
        for b, k in enumerate(self.bytes_):
            self.raw[k] = bytes([b])

    @staticmethod
    def hash_of(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_BASE) + ord(c) + 1) & (1 << 64) - 1
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashes, -2 where a piece only begins so, -1 where there is no such piece."""
        out = np.full(len(h), -1, np.int32)
        for k, (by, bits, key, value) in enumerate(self.tables):
            if k == 0:
                slot = _mixed(h, by, bits)
                ok = key[slot] == h
                out = np.where(ok, value[slot], np.int32(-1))
                # Only where the slot is taken by another piece may a later table have it.
                rest = np.flatnonzero(~ok & (value[slot] != -1))
                continue
            if not len(rest):
                break
            slot = _mixed(h[rest], by, bits)
            ok = key[slot] == h[rest]
            out[rest[ok]] = value[slot[ok]]
            rest = rest[~ok & (value[slot] != -1)]
        return out


def load(path: str = VOCABULARY) -> Vocabulary:
    """The vocabulary of a SentencePiece model file on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    texts: list[str | None] = []
    bytes_: dict[int, int] = {}
    for k in range(n):
        piece = sp.id_to_piece(k)
        if sp.is_byte(k):
            bytes_[int(piece[1:-1], 16)] = k
        texts.append(None if sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k) or not piece else piece.replace("▁", " "))
    usual = [t is None or "\n" not in t and " " not in t.lstrip(" ") for t in texts]
    if not all(usual):
        raise ValueError("a piece spans a space or a line end")
    return Vocabulary(texts, [float(sp.get_score(k)) for k in range(n)], [bytes_[b] for b in range(256)] if len(bytes_) == 256 else [], sp.unk_id())


# --- one chunk ------------------------------------------------------------------


def forward(chunk: str, v: Vocabulary) -> tuple[list[float], list[list[tuple[int, int, float]]]]:
    """(best score up to each place, edges into each place as (start, id or -1, score))."""
    n = len(chunk)
    best, edges = [0.0] + [-np.inf] * n, [[] for _ in range(n + 1)]
    for j in range(1, n + 1):
        for i in range(max(0, j - v.longest), j):
            k = v.ids.get(chunk[i:j], -1)
            if k >= 0 or j - i == 1:
                s = v.scores[k] if k >= 0 else v.low
                edges[j].append((i, k, s))
                best[j] = max(best[j], best[i] + s)
    return best, edges


def nbest_chunk(chunk: str, v: Vocabulary, n: int) -> list[tuple[float, list[int]]]:
    """Up to n best (score, piece ids with -1 for unknown characters), best first, by A-star from the end."""
    best, edges = forward(chunk, v)
    out, order = [], 0
    # Of equal estimates the one nearest to the start goes first: a path is finished before its equals are begun.
    heap = [(-round(best[-1], 6), len(chunk), 0, 0.0, None)]
    while heap and len(out) < n:
        _, at, _, score, path = heapq.heappop(heap)
        if at == 0:
            ids = []
            while path:
                ids.append(path[0])
                path = path[1]
            out.append((score, ids))
            continue
        for i, k, s in edges[at]:
            order += 1
            heapq.heappush(heap, (-round(best[i] + s + score, 6), i, order, s + score, (k, path)))
    return sorted(out, key=lambda x: -x[0])


def plain(chunk: str, ids: list[int], v: Vocabulary) -> list[int]:
    """Piece ids with unknown characters as byte pieces (or as the unknown id, where there are none)."""
    if -1 not in ids:
        return ids
    out, at = [], 0
    for k in ids:
        if k >= 0:
            out.append(k)
            at += len(v.texts[k])
        else:
            out += [v.bytes_[b] for b in chunk[at].encode()] if v.bytes_ else [v.unknown]
            at += 1
    return out


# --- many chunks ----------------------------------------------------------------


def solve(chunks: list[str], v: Vocabulary, n_best: int = 2) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(ids, score, loss of the second best or infinity) of each chunk; with n_best=1 the loss is left out."""
    ids: list = [None] * len(chunks)
    score, loss = np.zeros(len(chunks)), np.full(len(chunks), np.inf)
    size = np.array([len(c) for c in chunks], np.int64)
    for n in np.unique(size):
        own = np.flatnonzero(size == n)
        if n > LONG:
            for k in own:
                two = nbest_chunk(chunks[k], v, min(n_best, 2))
                ids[k] = np.array(plain(chunks[k], two[0][1], v), np.int32)
                score[k] = two[0][0]
                loss[k] = two[0][0] - two[1][0] if len(two) > 1 else np.inf
            continue
        for lo in range(0, len(own), 4096):
            some = own[lo : lo + 4096]
            codes = np.frombuffer("".join([chunks[k] for k in some]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            _solve_equal(codes, some, chunks, v, ids, score, loss if n_best > 1 else None)
    return ids, score, loss


def _solve_equal(codes, some, chunks, v, ids, score, loss) -> None:
    m, n = codes.shape
    code = [codes[:, j].astype(np.uint64) + np.uint64(1) for j in range(n)]
    piece, gain = {}, {}
    for i in range(n):
        h, on = np.zeros(m, np.uint64), np.arange(m)  # rows in which some piece begins with what is read
        for j in range(i + 1, min(n, i + v.longest) + 1):
            h = h * _BASE + code[j - 1][on]
            k = v.find(h)
            if j - i == 1 or (k >= 0).any():
                own = np.full(m, -1, np.int32)
                own[on] = np.maximum(k, -1)
                piece[i, j] = own
                gain[i, j] = v.score[own] if j - i == 1 else np.where(own >= 0, v.score[own], -np.inf)
            more = k != -1
            h, on = h[more], on[more]
            if not len(on):
                break
    best, start = [np.zeros(m)], [None]
    for j in range(1, n + 1):
        top, at = np.full(m, -np.inf), np.zeros(m, np.int8)
        for i in range(max(0, j - v.longest), j):
            if (i, j) in gain:
                s = best[i] + gain[i, j]
                better = s > top
                top, at = np.where(better, s, top), np.where(better, np.int8(i), at)
        best.append(top)
        start.append(at)
    back = [None] * n + [np.zeros(m)]
    for i in range(n - 1, -1, -1) if loss is not None else ():
        top = np.full(m, -np.inf)
        for j in range(i + 1, min(n, i + v.longest) + 1):
            if (i, j) in gain:
                top = np.maximum(top, gain[i, j] + back[j])
        back[i] = top
    cur, second = np.full(m, n, np.int8), np.full(m, -np.inf)
    taken = np.full((m, n), -2, np.int32)  # the piece that starts here on the best path
    for j in range(n, 0, -1):
        here = cur == j
        for i in range(max(0, j - v.longest), j):
            if (i, j) in gain:
                on = here & (start[j] == i)
                if loss is not None:
                    second = np.maximum(second, np.where(on, -np.inf, best[i] + gain[i, j] + back[j]))
                taken[on, i] = piece[i, j][on]
        cur = np.where(here, start[j], cur)
    score[some] = best[n]
    if loss is not None:
        loss[some] = best[n] - second
    used = taken != -2
    flat, edge = taken[used], np.concatenate(([0], np.cumsum(used.sum(1))))
    strange = (taken == -1).any(1)
    for r, k in enumerate(some):
        own = flat[edge[r] : edge[r + 1]]
        ids[k] = np.array(plain(chunks[k], own.tolist(), v), np.int32) if strange[r] else own


@dataclass
class Encoded:
    ids: np.ndarray
    score: float
    others: list[tuple[float, list[tuple[int, int, list[int]]]]]  # second best and so on: score, and (place, pieces, new ids) where it differs from the best


def changed(ids: np.ndarray | list[int], changes: Iterable[tuple[int, int, list[int]]]) -> list[int]:
    """The ids of another segmentation: from each place so many pieces of the best one give way to others."""
    out, last = [], 0
    for at, n, new in changes:
        out += [*ids[last:at], *new]
        last = at + n
    return [*map(int, out), *map(int, ids[last:])]


class Encoder:
    """Encodes batch after batch and keeps what chunks it has solved, up to about `kept`."""

    def __init__(self, v: Vocabulary, n: int = 1, kept: int = KEPT):
        self.v, self.n, self.kept = v, n, kept
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.several: dict[str, list] = {}
        self.flat = np.zeros(0, np.int32)
        self.start, self.size = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.score, self.loss = np.zeros(0), np.zeros(0)

    def _learn(self, chunks: list[str]) -> None:
        ids, score, loss = solve(chunks, self.v, self.n)
        size = np.array([len(x) for x in ids], np.int64)
        self.flat = np.concatenate([self.flat, *ids]).astype(np.int32)
        self.size = np.concatenate([self.size, size])
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.score, self.loss = np.concatenate([self.score, score]), np.concatenate([self.loss, loss])

    def encode(self, texts: list[str]) -> Iterator[Encoded]:
        """The n best segmentations of each text; ties go to the chunk that comes first."""
        if len(self.number) > self.kept:
            self._forget()
        v, n, number, known = self.v, self.n, self.number, len(self.number)
        rows, words = [], []
        for text in texts:
            found = _CHUNK.findall(" " + text if v.prefix and text else text)
            rows.append(np.array([number.setdefault(c, len(number)) for c in found], np.int64))
            words.append(found if n > 1 else ())
        if len(number) > known:
            self._learn(list(itertools.islice(number, known, None)))
        flat, start, size, score, loss = self.flat, self.start, self.size, self.score, self.loss
        for row, chunks in zip(rows, words, strict=True):
            own = size[row]
            edge = np.concatenate(([0], np.cumsum(own)))
            out = flat[np.repeat(start[row] - edge[:-1], own) + np.arange(edge[-1])]
            total = float(score[row].sum())
            others: list[tuple[float, list]] = []
            if n > 1 and len(row):
                lost = loss[row]
                least = np.argpartition(lost, n - 2)[: n - 1] if len(row) > n else np.arange(len(row))
                limit = lost[least].max()
                at = np.flatnonzero(lost <= limit) if np.isfinite(limit) else np.flatnonzero(np.isfinite(lost))
                at = np.sort(at[np.argsort(lost[at], kind="stable")[: n - 1]])
                ways: list[tuple[float, tuple]] = [(0.0, ())]
                for p in at:
                    chunk = chunks[p]
                    if chunk not in self.several:
                        self.several[chunk] = nbest_chunk(chunk, v, n)
                    top = self.several[chunk][0][0]
                    ways = heapq.nsmallest(n, ((a + top - s, (*how, *(((int(p), r),) if r else ()))) for a, how in ways for r, (s, _) in enumerate(self.several[chunk])))
                for less, how in ways[1:]:
                    others.append((total - less, [(int(edge[p]), int(own[p]), plain(chunks[p], self.several[chunks[p]][r][1], v)) for p, r in how]))
            yield Encoded(out, total, others)


def encode_batch(texts: list[str], v: Vocabulary, n: int = 1) -> Iterator[Encoded]:
    """The n best segmentations of each text."""
    return Encoder(v, n).encode(texts)


def decode(ids: np.ndarray | list[int], v: Vocabulary) -> bytes:
    """The text, as UTF-8, that ids stand for; control and unknown ids stand for nothing."""
    raw = b"".join(map(v.raw.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
    return raw[1:] if v.prefix and raw[:1] == b" " else raw


def encode(documents: DataFrame, v: Vocabulary, n: int = 1, keep: list[str] | None = None, other_ids: bool = True, decoded: bool = True) -> DataFrame:
    """`keep` columns (doc_id by default) with ids, score, others and decoded, of every row; columns of these names give way.

    others has the score and ids of the second best segmentation and so on; with
    other_ids=False not all ids but `changes`: at each place `at` of the best ids
    `n` of them give way to `ids` (see `changed`).  With decoded=False there is no
    such column, and no text is put together again.

    A null text is empty: no ids, score 0, no others.  Fewer than n - 1 others
    come back where a text has fewer segmentations.  Of segmentations that tie,
    those that change earlier chunks come first; equal texts have equal ones.
    Texts are read whole, however long; an empty table gives an empty one.
    """
    keep = apart(["doc_id"] if keep is None else keep, ["ids", "score", "others", "decoded"])
    name = fresh("__text", keep)
    given = documents.select(*keep, F.coalesce("text", F.lit("")).cast("binary").alias(name))
    kind = "ids: array<int>" if other_ids else "changes: array<struct<at: int, n: int, ids: array<int>>>"
    schema = with_fields(given.drop(name).schema, f"ids array<int>, score double, others array<struct<score: double, {kind}>>" + ", decoded binary" * decoded)
    change = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
    other = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int32())) if other_ids else ("changes", pa.list_(change))]))

    def parts(batch):
        lo = size = 0
        texts = []
        for x in batch.column(batch.num_columns - 1):
            texts.append(x.as_py().decode("utf-8", "replace"))
            size += len(texts[-1])
            if size >= BATCH_CHARS:
                yield batch.slice(lo, len(texts)), texts
                lo, size, texts = lo + len(texts), 0, []
        if texts:
            yield batch.slice(lo, len(texts)), texts

    def run(batches):
        encoder = Encoder(v, n)
        for batch in released(batches):
            for part, texts in parts(batch):
                found = list(encoder.encode(texts))
                edge = np.concatenate(([0], np.cumsum([len(f.ids) for f in found]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate([f.ids for f in found]).astype(np.int32)))
                more = [[{"score": s, "ids": changed(f.ids, c)} if other_ids else {"score": s, "changes": [{"at": a, "n": k, "ids": i} for a, k, i in c]} for s, c in f.others] for f in found]
                back = [pa.array([decode(f.ids, v) for f in found], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, pa.array([f.score for f in found]), pa.array(more, other), *back], names=[f.name for f in schema])

    return given.mapInArrow(run, schema)
