"""Similarity joins, components and the pipeline against plain versions."""

import random

import pytest
from oracle import spark_rows, sql_rows

import corpus_pipeline
from weftflow.llm import jaccard, packing, quality, queries, toxicity
from weftflow.llm.common import table
from weftflow.llm.components import components

SF = "/root/testdata/sf0.001"


def words_of(text):
    return (text or "").encode().lower().split()


def shingle_set(text, size):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute(rows, size, percent):
    """component by id, of (id, text); ids that repeat are one document."""
    sets = [(i, shingle_set(t, size)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                lo, hi = sorted((top(i), top(j)))
                up[hi] = lo
    return {i: top(i) for i, _ in sets}


def near_copies(seed, n=60):
    """Texts, copies of them, and copies with so many edits that some pairs are just above a threshold and some just below."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 9, 20, 60, 150, 400]))]
        for _ in range(rng.randint(1, 5)):
            w = base[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return list(enumerate(texts, 1))


@pytest.mark.parametrize(("size", "percent", "seed"), [(4, 85, 1), (5, 80, 2), (3, 50, 3), (4, 85, 4)])
def test_join(spark, size, percent, seed):
    rows = near_copies(seed)
    got = {r.doc_id: r for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()}
    want = brute(rows, size, percent)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(shingle_set(t, size)) for i, t in rows)
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("seed", [5, 6])
def test_join_over_many_tiles(spark, monkeypatch, seed):
    """One cluster of sets that lie near one another, in tiles of a few sets."""
    monkeypatch.setattr(jaccard, "TILE_SETS", 8)
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(1, 90):
        w = base[:]
        for _ in range(rng.choice([1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"v{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute(rows, 4, 85)


def test_join_sql(spark):
    assert spark_rows(queries.op2_jaccard_join(spark, SF)) == sql_rows(queries.ORACLE_SQL["op2_jaccard_join"], SF)


def test_join_oddities(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(5, a, 0), (6, a.upper(), 0), (7, None, 0), (8, "", 0), (9, " \n\t", 0), (None, a, 0), (None, "alone x", 0), (3, a, 0), (3, b, 0), (4, b, 0), (10, "é É", 0), (11, "é É", 0), (12, "one", 0), (13, "x" * 300_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_shingles int")
    got = sorted(((r.doc_id or 0, r.component_id or 0) for r in jaccard.join(df, 4, 85).collect()))
    assert got == [(0, 0), (0, 3), (3, 3), (3, 3), (4, 3), (5, 3), (6, 3), (7, 7), (8, 8), (9, 9), (10, 10), (11, 10), (12, 12), (13, 13)]
    assert jaccard.join(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (None, 4), (7, None)]
    up = {x: x for e in edges for x in e if x is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            lo, hi = sorted((top(a), top(b)))
            up[hi] = lo
    linked = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    kept = docs
    for (name, stage), module, least, label in zip(corpus_pipeline.STAGES[:2], (quality, toxicity), (queries.GOOD, queries.TOXIC), ("quality", "toxic"), strict=True):
        scored = {r.doc_id: r.score for r in module.score(kept, module.fit(kept, labels, label)).collect()}
        out = stage(spark, kept, SF)
        good = {i for i, s in scored.items() if (s >= least) == (label == "quality")}
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == good, name
        kept = out
    before = kept.collect()
    want = brute([(r.doc_id, r.text) for r in before], 5, 80)
    kept = corpus_pipeline.drop_near_copies(spark, kept, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({want[r.doc_id] if words_of(r.text) else r.doc_id for r in before})
    pieces = corpus_pipeline.pack(spark, kept, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.collect()}
    assert packing.SCHEMA.split()[0] == pieces.columns[0]


def test_pipeline_runs_and_takes_empty_tables(spark, tmp_path):
    for t in ("documents", "labels"):
        table(spark, SF, t).limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.run(spark, SF).count() > 0


def test_near_copies_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, text + " more", "x"), (None, text, "x"), (3, None, "x"), (4, "", "x")], "doc_id long, text string, component_id string")
    got = sorted(r.doc_id or 0 for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == [0, 1, 3, 4]


def test_near_copies_keep_unlike_rows_of_one_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(7, None), (7, a), (7, None), (7, ""), (8, b), (8, c), (8, b.upper()), (9, b + " more"), (10, c), (5, c + " more"), (None, a), (11, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == sorted([(7, ""), (7, a), (8, b.upper()), (5, c + " more"), (0, a), (11, "")])
