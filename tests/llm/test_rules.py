"""Quality rules against plain versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from cloudloom.llm import kernel, queries, rules

SF, SF1 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {i + k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            again += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), again, len(inside), n < 20 or 100 * len(inside) > 30 * n


def odd(r):
    phrase = "one two three four five six seven eight nine "
    texts = [None, "", " ", "\n\n", "a", "\x0b\x0c", "é語🙂 |#|", phrase * 3, phrase + "x " + phrase, (phrase + "\n") * 4, "same\nsame\n \n \nsame ", "w " * 30, phrase[:-1] * 2]
    texts += ["".join(r.choices(["ab", "c", "é", " ", "\n", "*", "\t", "cd "], k=r.randint(0, 200))) for _ in range(150)]
    return [*texts, "long word " * 40_000 + "end", "-" * 500_000 + " tail tail", ("é-ü " * 9 + "\n") * 20_000]


def test_statistics(spark, monkeypatch):
    texts = odd(random.Random(1))
    rows = [(k % 90 or None, t, "clash", 2) for k, t in enumerate(texts)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, kept string, __text int").repartition(3)
    got = rules.assess(documents, None, ["doc_id", "__text"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, 2, *plain_statistics(t)) for i, t, *_ in rows), key=str)
    assert rules.assess(documents.where("false"), None).collect() == []
    column = pa.array(texts, pa.large_string())
    for size in (7, 64, 5_000):
        monkeypatch.setattr(kernel, "SLICE_BYTES", size)
        some = column.slice(2, 160)
        assert np.array_equal(np.column_stack(rules.statistics(some, None, None)[:5]), [plain_statistics(t)[:5] for t in texts[2:162]])


def plain_buckets(text, bits):
    """Buckets of words and pairs, each hashed on its own."""
    out, h = [], []
    for w in WORDS.findall(text or ""):
        raw = np.frombuffer(w.encode(), np.uint8)
        h.append(int(kernel.span_hash(kernel.prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0]))
    mask = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & mask
        return x ^ (x >> 29)

    out = [*h, *(mix((a * 0x9E3779B97F4A7C15 + b) & mask) for a, b in zip(h, h[1:], strict=False))]
    return [x >> (64 - bits) for x in out]


def test_model_against_dictionaries(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = documents.select("doc_id", "text").collect()
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    bits = 12
    hits = {i: Counter(plain_buckets(t, bits)) for i, t in rows}
    raw, trusted = sum(hits.values(), Counter()), sum((h for i, h in hits.items() if i in good), Counter())

    def score(h, less=None):
        less = less or Counter()
        n, size = sum(h.values()), 1 << bits
        total_t, total_r = sum(trusted.values()) - sum(less.values()) + size, sum(raw.values()) - sum(less.values()) + size
        return sum(c * (math.log((trusted[b] - less[b] + 1) / total_t) - math.log((raw[b] - less[b] + 1) / total_r)) for b, c in h.items()) / max(1, n)

    again = labels.where("quality = 1").union(labels.where("quality = 1")).select("doc_id").union(spark.createDataFrame([(None,)], "doc_id long"))
    model = rules.learn(documents, again, bits, share=0.1)
    assert {b: int(n) for b, n in enumerate(model.raw) if n} == raw and {b: int(n) for b, n in enumerate(model.trusted) if n} == trusted
    own = sorted(score(hits[i], hits[i]) for i in good if i in hits)
    below = sum(s < model.threshold for s in own)
    assert below <= 0.1 * len(own) < sum(s < model.threshold + rules.STEP for s in own)
    for r in rules.assess(documents, model).collect():
        assert abs(r.log_ratio - score(hits[r.doc_id])) < 1e-8
        assert r.kept == (not r.base_failed and r.log_ratio >= model.threshold)


def test_clean_documents_stay_and_bad_ones_go(spark):
    found = {r.doc_id: r for r in queries.op13_quality_rules(spark, SF1).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    good, bad = ([found[i] for i, q in labels.items() if q == k and i in found] for k in (1, 0))
    good = [r for r in good if not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good) and sum(r.kept for r in bad) <= 0.3 * len(bad)


def test_odd_trust(spark):
    documents = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b"), (2, "")], "doc_id long, text string").repartition(3)
    nobody = spark.createDataFrame([], "doc_id long")
    for docs, trusted in ((documents, nobody), (documents.where("false"), nobody), (documents, documents.where("doc_id is null or doc_id = 2"))):
        model = rules.learn(docs, trusted)
        assert model.threshold == -math.inf and model.trusted.sum() == 0
        assert len(rules.assess(docs, model).collect()) == docs.count()
    model = rules.learn(documents, documents)
    assert model.raw.sum() == model.trusted.sum() == 6
    words = spark.createDataFrame([("x", "a b"), ("y", "c d")], "doc_id string, text string")
    assert rules.learn(words, words.where("doc_id = 'x'").select("doc_id")).trusted.sum() == 3


def test_beyond_broadcasts(spark, monkeypatch):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one = rules.learn(documents, labels.where("quality = 1"))
    monkeypatch.setattr("cloudloom.llm.shared.SMALL_ROWS", 1)
    two = rules.learn(documents, labels.where("quality = 1"))
    assert one.threshold == two.threshold and np.array_equal(one.raw, two.raw) and np.array_equal(one.trusted, two.trusted)
