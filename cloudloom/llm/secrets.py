"""Secret scans: fixed patterns, and formats inferred from what they find.

Credentials that the fixed patterns find are labelled; a bounded sample of them,
by kind and by the classes of letters and digits they use, trains one
probabilistic automaton each, and others are trained on other tokens.  A prefix
tree over signs and places between them is folded by state merging: two states
become one where the characters that follow, the lengths that remain and what
comes below agree within Hoeffding bounds, so prefixes, signs and lengths are
learned as far as the examples bear it out.  Every token of
every text is then scored by how much likelier its format is under some
credential's automaton than among other tokens, a mixture of automata, one for
each set of classes; what this makes a credential at the odds of the sample is a
span of its own.  The other tokens may hold credentials that no pattern finds:
where they use the same classes as labelled ones, those that the other automata
make credentials are not learned as tokens of no kind.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, sample
from .shared import saved

#: Fixed patterns, by kind in order; the second number is the least length of the group.
KINDS = ("assign", "access", "hex")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(
    "(?:" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile("AKIA[A-Z0-9]{12,}")
HEX = re.compile("[0-9a-f]{32,}")
_WORDS = (b"passw", b"secret", b"token", b"api")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Learn from about so many documents at most, and so many distinct tokens of each kind and set of classes; tokens are of at least so many characters.
DOCUMENTS, EXAMPLES, TOKEN = 20_000, 400, 8
#: Longer tokens are no examples; they are scored like any other.
LONGEST = 256
#: Error probability of the Hoeffding test; what a score has to exceed the logarithm of the odds against a credential by.
ALPHA, MARGIN = 0.05, 2.0
_CHARS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_.=-"
_NUMBER = {c: k for k, c in enumerate(_CHARS)}
_TOKEN_CLASS = np.zeros(256, bool)
_TOKEN_CLASS[[ord(c) for c in _CHARS]] = True
#: Classes of letters and digits; symbols of the tree: 0 for letters, digits, + and /, and one for each other sign.
_CLASSES = [set(c) for c in ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ")]
_SYMBOL = [max(0, k - _CHARS.index("/")) for k in range(len(_CHARS))]
N_SYMBOLS = 5
#: How many examples the characters of all places are worth at one place.
PRIOR = 8.0


def base_spans(text: bytes) -> tuple[list[tuple[int, int, str]], str | None]:
    """((start, end, kind) in code points, the text if it had to be decoded)."""
    low = text.translate(_LOWER)
    assign, access = any(w in low for w in _WORDS), b"AKIA" in text
    if not (assign or access):
        return [], None
    s = text.decode("utf-8", "replace")
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(s) if m.end(1) - m.start(1) >= 8] if assign else []
    if access:
        found += [(*m.span(), "access") for m in ACCESS.finditer(s)]
    return found, s


# --- probabilistic automata -----------------------------------------------------


@dataclass
class Automaton:
    """step[state, symbol]: next state or -1; log_p[state, character] and log_end[state]: smoothed; off[character]: where there is no way on."""

    step: np.ndarray
    log_p: np.ndarray
    log_end: np.ndarray
    off: np.ndarray

    def __post_init__(self) -> None:
        self._lists = self.step.tolist(), self.log_p.tolist(), self.log_end.tolist(), self.off.tolist()  # read one by one

    def log_likelihood(self, token: list[int]) -> float:
        """Of the numbers of a token's characters."""
        step, log_p, log_end, off = self._lists
        state, total = 0, 0.0
        for c in token:
            if state < 0:
                total += off[c]
                continue
            total += log_p[state][c]
            state = step[state][_SYMBOL[c]]
        return total + (log_end[state] if state >= 0 else off[-1])


def infer(examples: Iterable[str], alpha: float = ALPHA) -> Automaton:
    """State merging over the prefix tree, red-blue order, breadth first; each example counts once, as repeats are no evidence of their own."""
    count, child, flow, remaining = [0], [{}], [{}], [Counter()]
    chars = [np.zeros(len(_CHARS))]
    for token in map(numbers, examples):
        at = 0
        for k, c in enumerate(token):
            count[at] += 1
            remaining[at][len(token) - k] += 1
            chars[at][c] += 1
            s = _SYMBOL[c]
            flow[at][s] = flow[at].get(s, 0) + 1
            if s not in child[at]:
                child[at][s] = len(count)
                count.append(0)
                child.append({})
                flow.append({})
                remaining.append(Counter())
                chars.append(np.zeros(len(_CHARS)))
            at = child[at][s]
        count[at] += 1
        remaining[at][0] += 1
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def agree(a: int, b: int) -> bool:
        """Whether what follows two states agrees: remaining lengths (the end is one of 0), signs and characters, by what passes through the states themselves."""
        n, m = count[a], count[b]
        if not n or not m:
            return True
        bound = width * (n**-0.5 + m**-0.5)
        if bound >= 1:
            return True
        x, y = remaining[a], remaining[b]
        if any(abs(x[r] / n - y[r] / m) > bound for r in x.keys() | y.keys()):
            return False
        x, y = flow[a], flow[b]
        return all(abs(x.get(s, 0) / n - y.get(s, 0) / m) <= bound for s in x.keys() | y.keys()) and float(np.abs(chars[a] / n - chars[b] / m).max()) <= bound

    def alike(a: int, b: int) -> bool:
        todo, seen = [(a, b)], set()
        while todo:
            a, b = todo.pop()
            if (a, b) in seen:
                continue
            seen.add((a, b))
            if not agree(a, b):
                return False
            todo += [(child[a][s], child[b][s]) for s in child[a].keys() & child[b].keys()]
        return True

    def fold(a: int, b: int) -> None:
        """b, the root of a tree, goes into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            count[a] += count[b]
            remaining[a].update(remaining[b])
            chars[a] += chars[b]
            for s, y in child[b].items():
                flow[a][s] = flow[a].get(s, 0) + flow[b][s]
                if s in child[a]:
                    todo.append((child[a][s], y))
                else:
                    child[a][s] = y

    red, is_red, at = [0], {0}, 0
    while at < len(red):
        p = red[at]
        for s in sorted(child[p]):
            blue = child[p][s]
            if blue in is_red:
                continue
            for r in red:
                if alike(r, blue):
                    child[p][s] = r
                    fold(r, blue)
                    break
            else:
                red.append(blue)
                is_red.add(blue)
        # Folding may have hung new trees under red states that were done.
        again = [k for k, r in enumerate(red[: at + 1]) if any(c not in is_red for c in child[r].values())]
        at = again[0] if again else at + 1
    number = {r: k for k, r in enumerate(red)}
    everywhere = sum(chars[r] for r in red) + 0.5
    everywhere /= everywhere.sum()
    symbols = np.eye(N_SYMBOLS)[_SYMBOL]  # character x symbol
    share = everywhere / (symbols @ (everywhere @ symbols))  # of a character in its symbol
    step, log_p, log_end = np.full((len(red), N_SYMBOLS), -1), np.zeros((len(red), len(_CHARS))), np.zeros(len(red))
    for r, k in number.items():
        way = np.array([flow[r].get(s, 0) for s in range(N_SYMBOLS)], float)
        total = count[r] + 0.5 * (N_SYMBOLS + 1)
        log_p[k] = np.log((symbols @ (way + 0.5)) / total * (chars[r] + PRIOR * share) / (symbols @ way + PRIOR))
        log_end[k] = math.log((count[r] - way.sum() + 0.5) / total)
        for s, c in child[r].items():
            step[k, s] = number[c]
    end = 1 / 64
    return Automaton(step, log_p, log_end, np.append(np.log(everywhere * (1 - end)), math.log(end)))


def numbers(token: str) -> list[int]:
    return [_NUMBER[c] for c in token]


def classes_of(token: str) -> int:
    """Which classes of letters and digits it uses, as bits."""
    used = set(token)
    return sum(1 << k for k, c in enumerate(_CLASSES) if used & c)


def by_classes(tokens: Iterable[str]) -> dict[int, list[str]]:
    groups: dict[int, list[str]] = {}
    for t in sorted(set(tokens)):
        groups.setdefault(classes_of(t), []).append(t)
    return groups


@dataclass
class Model:
    """The credentials' automata; other tokens' automata by classes, with the logarithm of their share; the least score of a credential."""

    formats: list[Automaton]
    others: dict[int, tuple[float, Automaton]]
    threshold: float

    def score(self, token: str, least: float = -math.inf) -> float:
        """Log-likelihood ratio of the likeliest credential format to other tokens (where it is at least `least`); minus infinity without a model."""
        if not self.formats or not self.others:
            return -math.inf
        s = numbers(token)
        top, own = max(a.log_likelihood(s) for a in self.formats), classes_of(token)
        if own in self.others:
            share, a = self.others[own]
            if top - share - a.log_likelihood(s) < least:
                return -math.inf
        return top - max(share + a.log_likelihood(s) for share, a in self.others.values())


def train(examples: dict[str, list[str]], found: dict[tuple[str, int], int] | None = None) -> Model:
    """From tokens by kind; those of kind `other` are of no known kind.  Without both, nothing is ever found.

    `found` is the number of tokens by kind and classes that the examples were
    drawn from; that of the examples by default.  A token that several patterns
    find is an example of the last kind.
    """
    known: dict[str, set[str]] = {}
    taken: set[str] = set()
    for kind in reversed(KINDS):
        known[kind] = set(examples.get(kind, ())) - taken
        taken |= known[kind]
    groups = [(classes, g) for kind in KINDS for classes, g in sorted(by_classes(known[kind]).items())]
    formats = [infer(g) for _, g in groups]
    others = by_classes(set(examples.get("other", ())) - taken)
    if not formats or not others:
        return Model(formats, {}, math.inf)
    size = {c: len(g) if found is None else found["other", c] for c, g in others.items()}
    credentials = len(taken) if found is None else sum(n for (kind, _), n in found.items() if kind != "other")
    total = sum(size.values())
    threshold = MARGIN + max(0.0, math.log(total / credentials))
    log_share = {c: math.log(n / total) for c, n in size.items()}
    suspect = {c for c, _ in groups} & others.keys()
    model = Model(formats, {c: (log_share[c], infer(g)) for c, g in others.items() if c not in suspect}, threshold)
    more = {}
    for c in suspect:
        left = [t for t in others[c] if not model.others or model.score(t) < threshold]
        if left:
            more[c] = log_share[c] + math.log(len(left) / len(others[c])), infer(left)
    model.others |= more
    return model


# --- scans ------------------------------------------------------------------------


def long_tokens(column: pa.Array, least: int = TOKEN) -> list[list[tuple[int, int]]]:
    """(start, end) in bytes of the runs of token characters in each text."""
    raw, off = kernel.string_buffers(column)
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
    i, n = 0, len(column)
    while i < n:  # whole texts here: a run must not be cut
        j = max(i + 1, int(np.searchsorted(off, off[i] + kernel.SLICE_BYTES, "right")) - 1)
        inside = np.zeros(off[j] - off[i] + 2, np.int8)
        inside[1:-1] = _TOKEN_CLASS[raw[off[i] : off[j]]]
        change = np.flatnonzero(np.diff(inside))
        start, end = change[::2] + off[i], change[1::2] + off[i]
        first, last = np.searchsorted(off[i : j + 1], start, "right") - 1 + i, np.searchsorted(off[i : j + 1], end, "left") - 1 + i
        keep = (end - start >= least) | (first != last)
        for a, b, p, q in zip(start[keep].tolist(), end[keep].tolist(), first[keep].tolist(), last[keep].tolist(), strict=True):
            for k in range(p, q + 1):  # a run over the edge of texts is one run in each
                x, y = max(a, int(off[k])) - int(off[k]), min(b, int(off[k + 1])) - int(off[k])
                if y - x >= least:
                    out[k].append((x, y))
        i = j
    return out


def scan(text: bytes, tokens: list[tuple[int, int]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, long tokens that overlap none as (start, end, token)), in code points."""
    base, s = base_spans(text)
    if not tokens:
        return base, []
    ascii_ = text.isascii()
    rest, chars, at = [], 0, 0
    for a, b in tokens:
        chars += a - at if ascii_ else len(text[at:a].decode("utf-8", "replace"))
        token = text[a:b].decode("ascii")
        base += [(chars + m.start(), chars + m.end(), "hex") for m in HEX.finditer(token)]
        rest.append((chars, chars + b - a, token))
        chars, at = chars + b - a, b
    if not base:
        return base, rest
    first = sorted((s, e) for s, e, _ in base)
    starts, reach = [s for s, _ in first], list(itertools.accumulate((e for _, e in first), max))
    return base, [t for t in rest if not (k := bisect.bisect_left(starts, t[1])) or reach[k - 1] <= t[0]]


def ordered(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    rank = {k: i for i, k in enumerate((*KINDS, "learned"))}
    return sorted(spans, key=lambda x: (x[0], rank[x[2]], x[1]))


def examples_of(text: bytes, tokens: list[tuple[int, int]]):
    base, rest = scan(text, tokens)
    s = text.decode("utf-8", "replace") if base else ""
    for a, b, kind in base:
        value = s[a:b]
        yield kind, ASSIGN.match(value).group(1) if kind == "assign" else value
    for *_, token in rest:
        yield "other", token


def learn(documents: DataFrame, bound: int = DOCUMENTS, examples: int = EXAMPLES, longest: int = LONGEST) -> Model:
    """A model from about `bound` documents at most, and `examples` distinct tokens, of `longest` characters at most, of each kind and set of classes at most, by order of their hash."""
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    chosen = texts.where(sample.bucket(F.col("doc_id")) < sample.share(bound, documents.count())).select("text")

    def run(batches):
        for batch in batches:
            column = batch.column(0)
            found = sorted({x for text, t in zip(column.cast(pa.binary()), long_tokens(column), strict=True) for x in examples_of(text.as_py(), t) if len(x[1]) <= longest})
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([classes_of(x[1]) for x in found], pa.int32()), pa.array([x[1] for x in found], pa.string())], names=["kind", "classes", "token"])

    found = saved(chosen.mapInArrow(run, "kind string, classes int, token string").distinct())
    count = {(r["kind"], r["classes"]): r["count"] for r in found.groupBy("kind", "classes").count().collect()}
    by_kind: dict[str, list[str]] = {}
    if count:
        # About four times as many as wanted come to the driver; groups of so few come whole.
        limit = F.create_map(*(F.lit(x) for (kind, c), n in sorted(count.items()) for x in (f"{kind}{c}", sample.share(4 * examples, n))))
        some = found.where(sample.bucket(F.col("token")) < limit[F.concat("kind", F.col("classes").cast("string"))])
        groups: dict[tuple[str, int], list[tuple[int, str]]] = {}
        for r in some.select("kind", "classes", "token", sample.bucket(F.col("token")).alias("at")).collect():
            groups.setdefault((r["kind"], r["classes"]), []).append((r["at"], r["token"]))
        for (kind, _), tokens in groups.items():
            by_kind.setdefault(kind, []).extend(t for _, t in sorted(tokens)[:examples])
    return train(by_kind, count)


def find(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (doc_id by default) with secrets: (start, end, kind, score) of every row, in order; a column of that name gives way.

    Offsets are in code points, ends exclusive.  Base spans have no score; kind
    `learned` marks what only the automata found.  A null or empty text has none,
    equal texts have equal ones, texts and tokens of any length are read whole, and
    an empty table gives an empty one.
    """
    keep = kernel.apart(["doc_id"] if keep is None else keep, ["secrets"])
    name = kernel.fresh("__text", keep)
    given = documents.select(*keep, F.coalesce("text", F.lit("")).alias(name))
    schema = kernel.with_fields(given.drop(name).schema, "secrets array<struct<start: long, end: long, kind: string, score: double>>")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            column, out = batch.column(batch.num_columns - 1), []
            scores: dict[str, float] = {}
            for text, tokens in zip(column.cast(pa.binary()), long_tokens(column), strict=True):
                base, rest = scan(text.as_py(), tokens)
                score = {}
                for a, b, token in rest:
                    if token not in scores:
                        if len(scores) > 100_000:
                            scores.clear()
                        scores[token] = model.score(token, model.threshold)
                    if scores[token] >= model.threshold:
                        score[a] = round(scores[token], 6)
                        base = [*base, (a, b, "learned")]
                out.append([{"start": a, "end": b, "kind": k, "score": score.get(a) if k == "learned" else None} for a, b, k in ordered(base)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], names=[*batch.schema.names[:-1], "secrets"])

    return given.mapInArrow(run, schema)
