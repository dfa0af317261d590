"""Toxicity, quality and language: accuracy on rows that were held out, and the cases that inputs may hold."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cloudloom.llm import kernel, language, quality, queries, sample, toxicity

SF = "/root/testdata/sf0.1"


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.fixture(scope="module")
def labelled():
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas().merge(pq.read_table(f"{SF}/labels.parquet").to_pandas(), on="doc_id")
    docs["crc"] = [crc(i) for i in docs.doc_id]
    return docs


def test_toxicity_of_held_out_documents(labelled):
    seen, held = labelled[labelled.crc % 5 != 0], labelled[labelled.crc % 5 == 0]
    model = toxicity.train(zip(seen.text, seen.toxic, strict=True))
    found = toxicity.logits(pa.array(held.text), *model) > 0
    toxic = held.toxic.to_numpy() == 1
    assert found[toxic].mean() > 0.85
    assert found[~toxic].mean() < 0.01
    words = toxicity.logits(pa.array(["the idiott went home", "the river went home"]), *model)
    assert words[0] > words[1]  # a misspelling that no row has


@pytest.mark.parametrize("gap", [" ", "", "。"], ids=["spaces", "none", "marks"])
def test_scores_do_not_depend_on_slices(labelled, monkeypatch, gap):
    some = labelled[:400]
    toxic = toxicity.train(zip(some.text, some.toxic, strict=True))
    good = quality.train(zip(some.text, some.quality, some.n_chars, strict=True))
    lang = language.build({"a": np.arange(9, dtype=np.uint64) << np.uint64(40), "b": language.kernel.Grams(*kernel.spaced(*kernel.string_buffers(pa.array(["idiot river stone"])))).of(3)[1]})
    r = np.random.default_rng(3)
    words = " ".join(labelled.text[:60]).split()
    long = " ".join(words[:5000]) + gap.join(r.choice(words, 12_000 if gap == " " else 3_000)) + " idiot stone, river idiot\n" + " ".join(words[:9000])
    column, n = pa.array([long, "a", None, "", long[:500], "one two"]), pa.array([len(long), 1, None, 0, 500, None])
    whole = toxicity.logits(column, *toxic), quality.logits(column, n, good), language.decide(column, lang)[1], quality.features(column, n)[0]
    assert len(list(kernel.slices(column))) == 1
    for size in (1 << 10, 5_000, 1 << 16):
        monkeypatch.setattr(kernel, "SLICE_BYTES", size)
        parts = [p.tobytes() for p, o, rows in kernel.slices(column) if rows[0] == 0 and len(o) == 2]
        assert b"".join(parts).decode() == long and len(parts) > 1
        cut = toxicity.logits(column, *toxic), quality.logits(column, n, good), language.decide(column, lang)[1], quality.features(column, n)[0]
        for x, y in zip(whole, cut, strict=True):
            assert np.abs(x - y).max() < 1e-9
    assert whole[0][2] == whole[0][3] == toxic[1] / toxicity.ONE


def test_scores_take_little_memory():
    """Arrays over the grams of a few megabytes of texts, in a task of a small executor."""
    column = pa.array([" ".join(f"w{k * j % 9973}" for k in range(300)) for j in range(1, 2000)])
    each = np.arange(1 << toxicity.BITS) % 1000
    toxicity.logits(column[:3], each, 0)  # tables that stay
    tracemalloc.start()
    got = toxicity.logits(column, each, 0)
    assert column.nbytes > 3 << 20 and tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()
    assert got[5] == toxicity.logits(column[5:6], each, 0)[0]


def test_tables_of_powers_follow_the_slices():
    """A process that never sees a large slice keeps no large tables; the numbers are the same."""
    kept = kernel._powers, kernel._inverses
    try:
        kernel._powers = kernel._inverses = np.ones(1, np.uint64)
        few = [x.copy() for x in kernel.powers(70_000)]
        assert few[0].nbytes <= 1 << 20
        assert all((x[: len(y)] == y).all() for x, y in zip(kernel.powers(1 << 18), few, strict=True))
    finally:
        kernel._powers, kernel._inverses = kept


def test_scores_send_a_kept_text_once(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, n_chars long, lang string")
    model = toxicity.train([("the idiot", 1), ("the river", 0)])
    kept = toxicity.score(df, model, df.columns)
    assert "__text" not in kept._jdf.queryExecution().optimizedPlan().toString() and kept.columns == [*df.columns, "toxicity_score"]
    few = {(r.doc_id, r.toxicity_score) for r in toxicity.score(df, model).collect()}
    assert {(r.doc_id, r.toxicity_score) for r in kept.collect()} == few
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((r[0] or 0, r[1] or "") for r in ROWS)


def test_statistics_of_texts_of_megabytes():
    for n in (100_000, 200_000, 400_000):
        stats = dict(zip(quality.STATS, quality.features(pa.array(["ab cd ef gh ij " * (n // 5)]), None)[0][0], strict=True))
        assert stats["distinct words"] == pytest.approx(5 / n) and stats["repeat of the word before"] == 0
    stats = dict(zip(quality.STATS, quality.features(pa.array(["ab " * 900_000]), None)[0][0], strict=True))
    assert stats["repeat of the word before"] == pytest.approx(1 - 1 / 900_000)


def test_quality_of_held_out_documents(labelled):
    seen, held = labelled[labelled.crc % 4 != 2], labelled[labelled.crc % 4 == 2]
    model = quality.train(zip(seen.text, seen.quality, seen.n_chars, strict=True))
    score = 1 / (1 + np.exp(-quality.logits(pa.array(held.text), pa.array(held.n_chars), model)))
    good = held.quality.to_numpy() == 1
    assert (score[good] >= 0.7).mean() > 0.98
    assert (score[~good] < 0.7).mean() > 0.95


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    model = quality.Model(0.3, rng.standard_normal(quality.N) * 0.1, rng.standard_normal((quality.N, quality.RANK)) * 0.1, np.sort(rng.random((len(quality.STATS), quality.BINS - 1)), 1))
    text = "one two two Three!! | four"
    stats, words, buckets = quality.features(pa.array([text]), pa.array([7]))
    ids = [*buckets[0], *quality.bins(stats, model.edges)[0]]
    x = [1 / words[0]] * len(buckets[0]) + [1.0] * len(quality.STATS)
    slow = model.bias + sum(model.weights[i] * v for i, v in zip(ids, x, strict=True))
    slow += sum(model.factors[ids[i]] @ model.factors[ids[j]] * x[i] * x[j] for i in range(len(ids)) for j in range(i))
    assert quality.logits(pa.array([text]), pa.array([7]), model)[0] == pytest.approx(slow)


def test_language_of_held_out_documents(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.op5_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.95
    assert found.score.between(0, 1).all()


def test_bitmask_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    grams = {f"l{k:02}": rng.integers(0, 1 << 63, 500, dtype=np.uint64) for k in range(11)}
    model = language.build(grams)
    assert len(model.planes) == 2
    for k, name in enumerate(model.languages):
        for at in language.slots(grams[name]):
            assert (model.planes[k // 8][at] & (1 << k % 8) > 0).all()
    strange = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    for k in range(len(model.languages)):
        hit = np.ones(len(strange), bool)
        for at in language.slots(strange):
            hit &= model.planes[k // 8][at] & (1 << k % 8) > 0
        assert hit.mean() < 5 * model.wrong[k] + 1e-3


ROWS = [(1, "the idiot and the river", 9, "en"), (1, "the idiot and the river", 9, "en"), (2, None, None, None), (3, "", 0, "fr"), (None, "12 34", 5, "de"), (4, "é" * 300_000 + " x", 3, None), (5, "日本語", 3, "xx")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string").withColumn("__text", F.lit("clash")).withColumn("score", F.lit(1))


def test_models_take_any_rows(spark):
    df = frame(spark)
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (3, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    yes = F.lit(True)
    for learn, score, name in ((toxicity.learn, toxicity.score, "toxicity_score"), (quality.learn, quality.score, "quality_score")):
        rows = score(df, learn(df, labels, yes)).collect()
        assert len(rows) == 7 and all(0 <= r[name] <= 1 for r in rows)
        assert len({r[name] for r in rows if r.doc_id == 1}) == 1
        rows = score(df, learn(df, labels.limit(0), yes), ["doc_id", "lang"]).collect()
        assert all(r[name] < 1e-5 for r in rows)
        assert score(df.limit(0), learn(df.limit(0), labels, yes)).count() == 0
    found = {r.doc_id: r for r in language.identify(df, language.learn(df, yes)).collect()}
    assert found[2].lang_pred == found[3].lang_pred == found[None].lang_pred == "und"
    assert found[1].lang_pred == "en" and found[5].lang_pred == "xx"
    assert {r.lang_pred for r in language.identify(df, language.learn(df.limit(0), yes)).collect()} == {"und"}


def test_sample_is_bounded_and_repeatable(spark):
    ids = spark.range(20_000)
    n = ids.where(sample.bucket(F.col("id")) < sample.share(1000, 20_000)).count()
    assert 850 < n < 1150
    assert ids.where(sample.bucket(F.col("id")) < sample.share(30_000, 20_000)).count() == 20_000
    got = spark.range(50).select("id", sample.crc_of(F.col("id")).alias("c")).collect()
    assert all(r.c == crc(r.id) for r in got)


def test_span_hashes_follow_the_bytes():
    data = np.frombuffer(b"abcabc abc", np.uint8)
    h = kernel.span_hash(kernel.prefix_hash(data), np.array([0, 3, 7, 1]), np.array([3, 6, 10, 4]))
    assert h[0] == h[1] == h[2] != h[3]
    buf, starts = kernel.spaced(*kernel.string_buffers(pa.array(["Ab É", "", "c"])))
    assert bytes(kernel.lower(buf)).decode() == " ab é  c " and starts.tolist() == [0, 6, 7]


SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "fold", "label", "least", "sure"), [("op8_toxicity", (5, 0), "toxic", 0.5, 0.8), ("op10_quality", (4, 2), "quality", 0.7, 0.9)])
def test_score_queries(spark, name, fold, label, least, sure):
    documents = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    df = queries.QUERIES[name](spark, SMALL)
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    held = {i for i in documents if crc(i) % fold[0] == fold[1]}
    assert {r.doc_id for r in rows if r.held_out} == held
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= least) for r in rows)
    assert len({(documents[r.doc_id].text, documents[r.doc_id].n_chars, r.score) for r in rows}) == len({(documents[r.doc_id].text, documents[r.doc_id].n_chars) for r in rows})
    known = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and labels.get(r.doc_id) in (0, 1)]
    assert len(known) > 20 and np.mean(known) > sure
    learned = [(documents[i].text or "", v, documents[i].n_chars) for i, v in labels.items() if i in documents and v in (0, 1) and i not in held and len(documents[i].text or "") <= 60_000]
    learned.sort(key=lambda r: str((r[0], r[1]) if name == "op8_toxicity" else r))
    texts = [documents[r.doc_id].text or "" for r in rows]
    if name == "op8_toxicity":
        z = toxicity.logits(pa.array(texts), *toxicity.train((t, v) for t, v, _ in learned))
    else:
        z = quality.logits(pa.array(texts), pa.array([documents[r.doc_id].n_chars for r in rows]), quality.train(learned))
    assert [r.score for r in rows] == pytest.approx((1 / (1 + np.exp(-z))).tolist(), abs=2e-9)


def test_language_query(spark):
    documents = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    df = queries.op5_language_id(spark, SMALL)
    assert df.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = df.collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    learned = {d.lang for i, d in documents.items() if d.lang is not None and crc(i) % 4 != 2}
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in documents[r.doc_id].text or "")) and r.lang_pred in learned | {"und"} for r in rows)
    # the n-grams of each language, counted one by one
    model = language.learn(spark.read.parquet(f"{SMALL}/documents.parquet"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    some = [r for r in rows if 20 < len(documents[r.doc_id].text or "") < 400][:40]
    for r in some:
        hits, total = np.zeros(len(model.languages)), 0
        grams = kernel.Grams(*kernel.spaced(*kernel.string_buffers(pa.array([documents[r.doc_id].text]))))
        for n in language.SIZES:
            for h in grams.of(n)[1]:
                total += 1
                at = [int(h) >> language.SLOT_BITS * k & (1 << language.SLOT_BITS) - 1 for k in range(language.HASHES)]
                hits += [all(model.planes[k // 8][a] >> k % 8 & 1 for a in at) for k in range(len(model.languages))]
        fair = np.maximum(0, (hits - total * model.wrong) / (1 - model.wrong))
        assert r.lang_pred == model.languages[int(fair.argmax())] and r.score == pytest.approx(fair.max() / fair.sum(), abs=1e-8)


def test_ties_go_to_the_first_language():
    same = np.arange(1, 400, dtype=np.uint64) << np.uint64(20)
    grams = kernel.Grams(*kernel.spaced(*kernel.string_buffers(pa.array(["stone river"])))).of(3)[1]
    model = language.build({"b": np.concatenate([same, grams]), "a": np.concatenate([same, grams])})
    kind, share = language.decide(pa.array(["stone river", "qqqq"]), model)
    assert kind == ["a", "a"] and share[0] == pytest.approx(0.5, abs=0.01) and share[1] == 0
