"""Fill-in-the-middle against a plain version."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import infill, queries

SF = "/root/testdata/sf0.001"


def cut_plainly(doc_id, text, units="characters", seed=1):
    """(fim, form, n, prefix, middle) by the definition."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    text = text or ""
    white = " \t\n\r\x0b\x0c"
    begins = {"characters": lambda i: True, "words": lambda i: text[i] not in white and text[i - 1] in white, "lines": lambda i: text[i - 1] == "\n"}[units]
    at = [i for i in range(len(text)) if i == 0 or begins(i)]
    n = len(at)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return text, "plain", n, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    at.append(len(text))
    p, m, s = text[: at[a]], text[at[a] : at[b]], text[at[b] :]
    spm = h[3] % 100 < 20
    return f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}", "spm" if spm else "psm", n, a, b - a


def odd(r):
    letters = ["a", "é", "語", "🙂", " ", "\n", "\t", "<", ">", "P", "S", "M", "<S", "<P>", "word "]
    texts = [None, "", "x", "🙂", "\n", "<", "<S", "<M>", "ab<S>", *("".join(r.choices(letters, k=r.randint(0, 40))) for _ in range(300))]
    return [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(3, "x"), (3, "x"), (10**12, "long " * 200_000 + "é"), (-5, "語" * 90_000)]


@pytest.mark.parametrize("units", ["characters", "words", "lines"])
def test_odd_texts(spark, units):
    rows = odd(random.Random(2))
    documents = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in rows], "doc_id long, text string, form string, __0 double").repartition(3)
    got = infill.transform(documents, units=units).withColumn("back", infill.restored(F.col("fim"), F.col("form")))
    assert got.columns == ["doc_id", "__0", "fim", "form", "units", "prefix_units", "middle_units", "back"]
    want = [(i, 1.0, *cut_plainly(i, t, units), t or "") for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert {w[3] for w in want} == {"plain", "psm", "spm"}
    assert infill.transform(documents.where("false")).collect() == []


def test_slices_and_blocks(monkeypatch):
    """Cuts don't depend on how the bytes are sliced."""
    rows = [(i, t or "") for i, t in odd(random.Random(3))[:320]]
    column = pa.array([t for _, t in rows]).slice(7)
    draws = np.random.default_rng(1).integers(0, 1 << 32, (len(column), 2))
    no = np.zeros(len(column), bool)
    want = pa.Table.from_batches(infill.arrange(column, draws, no, no, "characters"))
    for block, size in ((1, 10), (3, 1 << 20), (64, 100)):
        monkeypatch.setattr(infill, "BLOCK", block)
        monkeypatch.setattr(infill, "SLICE", size)
        assert pa.Table.from_batches(infill.arrange(column, draws, no, no, "characters")).equals(want)


def test_query_and_parameters(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = documents.collect()
    got = {r.doc_id: (r.output_sha256, r.restored_sha256, r.form, r.n, r.prefix_chars, r.middle_chars) for r in queries.op12_fill_in_middle(spark, SF).collect()}
    for i, t in rows:
        fim, form, n, a, b = cut_plainly(i, t)
        assert got[i] == (hashlib.sha256(fim.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), form, n, a, b)
    assert {r.form for r in infill.transform(documents, plain_percent=0, spm_percent=100).collect()} == {"spm"}
    assert {r.form for r in infill.transform(documents, plain_percent=100).collect()} == {"plain"}
    one, two = ({r.doc_id: r.fim for r in infill.transform(documents, seed=s).collect()} for s in (1, 2))
    assert one.keys() == two.keys() and one != two
