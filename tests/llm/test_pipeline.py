"""Each stage against what it has to keep, and the queries' SQL."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cloudloom.llm import pieces, queries, simhash
from tests.llm.test_text import slow_fingerprint, slow_lines

SF = "/root/testdata/sf0.001"


def read(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "decontamination", "sentencepiece"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")] == list(range(1, 14))
    assert queries.QUERIES.keys() <= entry.queries().keys() and queries.ORACLE_SQL.keys() <= entry.oracle_sql().keys()


def test_each_stage(spark):
    docs = read(spark)
    kept = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    scores = {r.doc_id: r.score for r in queries.op8_toxicity(spark, SF).collect()}
    assert ids(kept) == sorted(k for k, s in scores.items() if s < 0.5)

    lines = corpus_pipeline.drop_repeated_lines(spark, docs, SF)
    assert lines.schema == docs.schema
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(((r.doc_id, r.text) for r in lines.collect()), key=str) == sorted(((d, t) for d, _, _, t in slow_lines(rows)), key=str)
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    one = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    prints = {d: slow_fingerprint(t) for d, t in rows}
    left = ids(one)
    assert all((prints[a] ^ prints[b]).bit_count() > 3 for a in left for b in left if a < b)
    assert all(any((prints[d] ^ prints[k]).bit_count() <= 3 for k in prints if k != d) for d in prints if d not in set(left))

    clean = corpus_pipeline.drop_leaks(spark, docs, SF)
    leaks = {r.doc_id for r in queries.op3_decontamination(spark, SF).collect()}
    assert leaks and ids(clean) == sorted(set(prints) - leaks) and clean.schema == docs.schema

    tokens = {r.doc_id: r.ids for r in corpus_pipeline.tokenize(spark, docs, SF).collect()}
    v = pieces.load()
    assert all(pieces.decode(tokens[d], v).decode() == t for d, t in rows)

    plain = pieces.encode(docs, v, 1, decoded=False)
    assert plain.columns == ["doc_id", "ids", "score", "others"] and {r.doc_id: r.ids for r in plain.collect()} == tokens


def test_near_copies_are_dropped(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = {r.doc_id: (r.text or "").lower().split() for r in docs.collect()}
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, w in words.items() if w}
    of = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            of[x].add(d)
    near = {(a, b) for d in of.values() for a in d for b in d if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    left = set(ids(dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, sf)))
    assert any(sets[a] != sets[b] for a, b in near) and not [(a, b) for a, b in near if a in left and b in left]
    linked = {d for pair in near for d in pair}
    assert all(d in linked or not words[d] for d in words.keys() - left)


def test_near_copies_of_templated_pages(spark):
    """500 pairs of 0.81 among pages of one template, which are 0.78 alike: every pair is found and no two others."""

    def page(j, edits):
        words = [f"t{k}" for k in range(400)] + [f"own{j}_{k}" for k in range(55)]
        for q in range(edits):
            words[20 + 40 * q] = f"edit{j}_{q}"
        return " ".join(words)

    def share(a, b):
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split()))
        return len(a & b) / len(a | b)

    assert 0.81 < share(page(0, 0), page(0, 9)) < 0.82 and 0.78 < share(page(0, 0), page(1, 0)) < 0.79
    rows = [(f"{j:04}{kind}", page(j, edits)) for j in range(500) for kind, edits in (("a", 0), ("b", 9))]
    found = simhash.near_copies(spark.createDataFrame(rows, "doc_id string, text string").repartition(8))
    assert sorted((r.a, r.b) for r in found.collect()) == [(f"{j:04}a", f"{j:04}b") for j in range(500)]


def test_near_copies_by_chains_and_odd_rows(spark):
    """Links that no middle page has, sets of all sizes, repeated ids, empty and null texts: components as by brute force."""
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60)]
    rows = [(1000, None), (None, "a b c d e f"), (1001, ""), (1002, "one two"), (1003, "ONE  two"), (1004, "b")]
    for chain in range(6):
        text = [f"c{chain}_{k}" for k in range(40 + 60 * chain)]
        for step in range(12):
            rows.append((chain * 100 + step, " ".join(text)))
            if step % 3 == 2:
                text = text + rng.sample(words, 2 + chain)
            else:
                text = [*text]
                text[rng.randrange(len(text))] = f"x{chain}_{step}"
    rows += [(3, rows[8][1]), (3, "another text of the same id with seven words")]
    sets = defaultdict(list)
    for d, t in rows:
        w = (t or "").lower().split()
        if w and d is not None:
            sets[d].append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    near = {(a, b) for a in sets for b in sets if a < b and any(5 * len(x & y) >= 4 * len(x | y) for x in sets[a] for y in sets[b])}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.a, r.b) for r in simhash.near_copies(frame).collect()}

    def least(pairs):
        root = {d: d for d in sets}
        for _ in sets:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert got <= near and least(got) == least(near) and (1002, 1003) in got
    assert simhash.near_copies(frame.limit(0)).count() == 0


def test_alike_pages_meet_in_few_rows(spark, monkeypatch):
    """300 pages of one text that are about 0.65 alike, some ids with a second text: the links are those of brute force, and no shingle brings pairs together that an earlier one decides."""
    rng = random.Random(5)
    base = [f"t{k}" for k in range(140)]

    def page(j, edits):
        words = [*base]
        for k in rng.sample(range(140), edits):
            words[k] = f"e{rng.randrange(4)}_{k}" if rng.random() < 0.5 else f"own{j}_{k}"
        return " ".join(words)

    rows = [(j, page(j, rng.choice((2, 3, 3)))) for j in range(300)]
    rows += [(j, page(j, 3)) for j in range(0, 300, 10)]
    rows += [(1000 + j, rows[j][1] + " end") for j in range(0, 300, 25)]
    sets = defaultdict(list)
    for d, t in rows:
        w = t.split()
        sets[d].append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    near = {(a, b) for a in sets for b in sets if a < b and any(5 * len(x & y) >= 4 * len(x | y) for x in sets[a] for y in sets[b])}
    met = []
    meet = simhash._meetings
    monkeypatch.setattr(simhash, "_meetings", lambda entries, roots: met.append(meet(entries, roots)) or met[-1])
    got = {(r.a, r.b) for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}

    def least(pairs):
        root = {d: d for d in sets}
        for _ in range(20):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert len(near) > 20 and got <= near and least(got) == least(near)
    assert met[0].count() < 100_000


@pytest.mark.parametrize("n, m", [(n, m) for n in (1, 2, 5, 9, 10, 45, 100) for m in (n, n + 1, n * 5 // 4)])
def test_prefixes_of_similar_sets_meet(n, m):
    rng = np.random.default_rng(n * 1000 + m)
    counts = rng.integers(0, 9, simhash.COUNTERS)
    both = -(-4 * (n + m) // 9)
    for _ in range(20):
        pool = np.unique(rng.integers(0, 1 << 63, 2 * (n + m) + 9, dtype=np.uint64))
        pool = rng.permutation(pool)
        if both > n:
            continue
        x, y = np.sort(pool[:n]), np.sort(pool[n - both : n - both + m])
        assert simhash.similar(x, y)
        (px, equal), (py, _) = simhash.prefix(x, counts), simhash.prefix(y, counts)
        assert set(px[:equal].tolist()) & set(py.tolist())
        assert np.bitwise_count((simhash.sketch(x) ^ simhash.sketch(y)).view(np.uint64)).sum() <= n + m - 2 * both


def test_whole_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() < read(spark).count()
    assert len(ids(out)) == len(set(ids(out)))


def test_odd_documents_pass(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "x " * 100_000, "en", "s", 1), (3, "x " * 100_000, "en", "s", 1), (None, "a clean text", "en", None, 9)], read(spark).schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        assert {1, 3, None} <= {r.doc_id for r in got.collect()}, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.tokenize(spark, docs, SF).count() == 5


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    theirs = con.sql(queries.ORACLE_SQL[name])
    df = queries.QUERIES[name](spark, SF)
    order = [theirs.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in theirs.fetchall()), key=str)


def test_the_last_stage_does_all_of_op1(spark):
    want = {r.doc_id: (r.ids, r.n_pieces, r.score, r.others, r.decoded_sha256) for r in queries.op1_sentencepiece(spark, SF).collect()}
    got = {r.doc_id: (r.ids, r.n_pieces, r.score, r.others, r.decoded_sha256) for r in corpus_pipeline.tokenize(spark, read(spark), SF).collect()}
    assert got == want and any(len(r[3]) == 3 for r in got.values())
