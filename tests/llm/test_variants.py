"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from cloudloom.llm import queries, variants

SF = "/root/testdata/sf0.001"
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(rows):
    for i, text in rows:
        for w in LETTERS.findall(text or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            yield w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w


def edits(w, letters):
    """All texts at a distance of exactly one."""
    out = {w[:i] + w[i + 1 :] for i in range(len(w))}
    out |= {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in letters for k in (0, 1) if i + k <= len(w)}
    return out - {w}


def brute(counts, times=2):
    letters, near = set("".join(counts)), {}
    for w, n in counts.items():
        found = sorted(((-counts[v], v) for v in edits(w, letters) if v in counts))
        good = found and -found[0][0] >= times * n
        near[w] = len(found), found[0][1] if good else None, -found[0][0] if good else None

    def root(w):
        while near[w][1] is not None:
            w = near[w][1]
        return w

    return {w: (near[w][1], root(w), n, near[w][0], near[w][2]) for w, n in counts.items()}


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


def test_query(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    counts = {w: n for w, n in Counter(words_of(documents)).items() if len(w) >= 5 and n >= 3}
    want = brute(counts)
    assert rows(queries.op11_spelling_variants(spark, SF)) == want
    assert len({r for _, r, *_ in want.values()}) < len(want) and any(f for f, *_ in want.values())


@pytest.mark.parametrize("size", [3, 40, 65_536])
def test_small_alphabets_and_shards(spark, monkeypatch, size):
    """Few letters, so that most words are near many; shards of few words, blocks of few shards."""
    monkeypatch.setattr(variants, "SHARD_WORDS", size)
    monkeypatch.setattr(variants, "BLOCK_BYTES", 4_000)
    r = random.Random(size)
    counts = {"".join(r.choices("abÀÿ", k=r.randint(1, 7))): r.choice([3, 3, 6, 6, 12, 13, 100, 10**10]) for _ in range(250)}
    counts |= {"a" * n: 4 for n in (1, 2, 3, 9, 30)} | {"b" * 5_000: 9, "b" * 5_001: 90}
    found = variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3))
    assert rows(found.select("word", "form", "root", "n", "n_near", "form_n")) == brute(counts)


def test_long_chains_of_forms(spark):
    """A form's form, twenty deep; ties go to the smallest word."""
    words = [("w" * (k + 1), 3 * 2**k) for k in range(20)] + [("zebra", 10), ("zebrb", 5), ("zebrc", 10), ("zzzzz", 3)]
    got = rows(variants.variants(spark.createDataFrame(words, "word string, n long")).select("word", "form", "root", "n", "n_near", "form_n"))
    assert got == brute(dict(words)) and got["w"][1] == "w" * 20 and got["zebrb"][0] == "zebra" and got["zzzzz"] == (None, "zzzzz", 3, 0, None)


def test_trie_by_level():
    r = random.Random(5)
    counts = {bytes(r.choices(b"abc\xe9", k=r.randint(1, 6))): r.randint(1, 9) for _ in range(300)}
    words = sorted(counts)
    trie = variants.Trie.unpack(variants.build(words, [counts[w] for w in words]).pack())
    search = variants.Search(trie)
    assert {w: search.rest(0, w, 0) for w in words} == counts and sum(n > 0 for n in trie.n) == len(counts)
    for w in [*words[:50], b"", b"zz", b"a" * 9]:
        found = list(search.near(w))
        assert len(dict(found)) == len(found)
        assert dict(found) == {v: n for v, n in counts.items() if v.decode("latin-1") in edits(w.decode("latin-1"), "abcé")}


def test_odd_documents(spark):
    odd = [(1, None), (2, ""), (None, "plants plants plants Plants"), (3, "123 !? ×÷ß"), (4, "straße straße Straße strasse"), (5, "q " * 10), (6, "x" * 300_000 + " y")]
    documents = spark.createDataFrame([(i, t, "clash", 0) for i, t in odd], "doc_id long, text string, word string, n int").repartition(4)
    got = {r.word: r.n for r in variants.vocabulary(variants.runs(documents)).collect()}
    assert got == {w: n for w, n in Counter(words_of(odd)).items() if len(w) >= 5 and n >= 3}
    assert {r.word: r.n for r in variants.vocabulary(variants.runs(documents, every=0), 1, 10).collect()} == {"q": 10}
    assert variants.variants(variants.vocabulary(variants.runs(documents.where("false")))).collect() == []
    assert variants.runs(spark.createDataFrame([("a", "Hello")], "doc_id string, text string"), every=0).collect()[0].word == "hello"


def test_groups(spark):
    words = spark.createDataFrame([("colour", 40), ("colur", 3), ("color", 9), ("other", 5)], "word string, n long")
    got = {tuple(r) for r in variants.grouped(variants.variants(words)).collect()}
    assert got == {("colour", 3, 52), ("other", 1, 5)}
