"""Tables that already have columns named as the operators' outputs and helpers, and ids of other types."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cloudloom.llm import chat, decontaminate, language, linededup, media, pieces, quality, secrets, toxicity

SF = "/root/testdata/sf0.001"
TAKEN = (
    "toxicity_score lang_pred lang_score quality_score n_lines n_dropped fp component_id ids n_pieces secrets score others decoded media_type corrected "
    "embedded keep start end item_id distance label node root h1 __id __text __d __t __x __n __null __bits __blob d t x k a b"
).split()


@pytest.fixture(scope="module")
def docs(spark):
    some = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    return some.select("*", *(F.lit(f"taken {c}").alias(c) for c in TAKEN))


@pytest.mark.parametrize("k", range(4))
def test_stages_return_what_they_were_given(spark, docs, k):
    got = corpus_pipeline.STAGES[k][1](spark, docs, SF)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[c] == f"taken {c}" for r in rows for c in TAKEN)


def test_outputs_take_the_place_of_columns_of_their_names(spark, docs):
    labels, every = spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True)
    done = {
        ("toxicity_score",): lambda d: toxicity.score(d, toxicity.learn(d, labels, every), d.columns),
        ("quality_score",): lambda d: quality.score(d, quality.learn(d, labels, every), d.columns),
        ("lang_pred", "lang_score"): lambda d: language.identify(d, language.learn(d, every), d.columns),
        ("secrets",): lambda d: secrets.find(d, secrets.learn(d), d.columns),
        ("n_lines", "n_dropped"): linededup.dedup_lines,
        ("ids", "score", "others", "decoded"): lambda d: pieces.encode(d, pieces.load(), 2, d.columns),
        ("ids", "n_lines"): lambda d: media.each_text(d, lambda text: (len(text), 1), "ids long, n_lines long", d.columns),
    }
    n = docs.count()
    for names, operator in done.items():
        got = operator(docs)
        assert got.columns == [*(c for c in docs.columns if c not in names), *names], names
        rows = got.collect()
        assert len(rows) == n and not any(r[c] == f"taken {c}" for r in rows for c in names)
        assert all(r[c] == f"taken {c}" for r in rows for c in TAKEN if c not in names)


def test_ids_of_other_types(spark):
    turns = [("c", 0, "user", "hi"), ("c", 1, "assistant", "yo"), (None, None, None, None)]
    got = chat.formatted(spark.createDataFrame(turns, "conv_id string, turn int, role string, text string"), texts=False)
    assert {r.conv_id: r.n_turns for r in got.collect()} == {"c": 2, None: 1}
    item = "a benchmark question of more than twenty characters"
    documents = spark.createDataFrame([(1, f"before {item} after"), (2, "nothing"), (3, None)], "doc_id int, text string").repartition(4)
    for kind, key in (("string", "q"), ("int", 7)):
        found = decontaminate.find(documents, spark.createDataFrame([(key, item)], f"item_id {kind}, text string"))
        assert [tuple(r) for r in found.collect()] == [(1, key, 0, 7, 7 + len(item))]
        assert found.schema["item_id"].dataType.simpleString() == kind
