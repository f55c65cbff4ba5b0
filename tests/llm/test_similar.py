import random

import brute
import numpy as np
import pytest

import corpus_pipeline
from tatterloom.llm import similar
from tatterloom.llm.common import stored


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"x{rng.random()}"
    return " ".join(out)


@pytest.fixture(scope="module")
def near():
    """Texts with zero to five words changed of 120, chains of changes, a passage common to all."""
    rng = random.Random(5)
    common = [f"c{k}" for k in range(40)]
    out = []
    for g in range(12):
        words = common + [f"g{g}.{k}" for k in range(80)]
        out.append(" ".join(words))
        out += [edited(rng, words, n) for n in range(6)]
        for _ in range(3):
            words = edited(rng, words, 2).split()
            out.append(" ".join(words))
    rng.shuffle(out)
    return list(enumerate(out))


def test_stage_finds_all_groups_of_similarity(spark, near):
    found = corpus_pipeline.near(spark, spark.createDataFrame(near, "doc_id long, text string"), "")
    assert sorted((r.doc_id for r in found.collect()), key=str) == brute.least_similar(near)
    assert len(brute.least_similar(near)) < len(near)


def test_stage_on_rows_of_all_kinds(docs, rows, spark):
    found = corpus_pipeline.near(spark, docs, "")
    assert found.columns == docs.columns
    assert sorted((r.doc_id for r in found.collect()), key=str) == brute.least_similar(rows)


def test_stage_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()), key=str) == brute.least_similar(rows)


def test_stage_empty(empty):
    assert similar.similar_dedup(empty).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_forest_is_all_links_within_a_bucket(seed):
    rng = random.Random(seed)
    sets = [set(rng.sample(range(24), rng.randint(12, 24))) for _ in range(60)]
    a, b = similar.linked([np.array(sorted(s), np.int64) for s in sets], 0.8)
    edges = {frozenset(map(int, e)) for e in zip(a, b, strict=True)}
    assert all(brute.alike(*(sets[k] for k in e)) for e in edges)
    mine = brute.components(range(60), lambda i, j: frozenset((i, j)) in edges)
    assert mine == brute.components(sets, brute.alike)


def test_buckets_too_large_for_a_task(spark, near):
    docs = stored(spark.createDataFrame([(d, t.upper() if d % 2 else t) for d, t in near], "doc_id long, text string"))
    small = {(r._row_id, r.group) for r in similar.similar_groups(docs, most=4).collect()}
    large = {(r._row_id, r.group) for r in similar.similar_groups(docs).collect()}
    groups = lambda found: {frozenset(d for d, g in found if g == of) for _, of in found}
    assert groups(small) == groups(large)


def test_one_row_stays_of_rows_that_repeat_an_id(spark):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, words), (1, words + " extra"), (2, words + " other"), (None, "a b"), (None, "A  b"), (None, None)]
    found = similar.similar_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id for r in found), key=str) == [1, None, None]


def test_stage_goes_through_the_gray_index(spark, near, monkeypatch):
    asked, links = [], similar.simhash.links

    def seen(codes, radius, most):
        asked.append((codes.count(), radius))
        return links(codes, radius, most)

    monkeypatch.setattr(similar.simhash, "links", seen)
    found = corpus_pipeline.near(spark, spark.createDataFrame(near, "doc_id long, text string"), "")
    assert sorted((r.doc_id for r in found.collect()), key=str) == brute.least_similar(near)
    assert asked and asked[0][0] > 1 and asked[0][1] == similar.RADIUS


@pytest.mark.parametrize("most", [6, 5_000])
def test_fingerprints_connect_all_within_the_radius(spark, near, most):
    fps = [similar.fingerprint(similar.shingles(t)) for _, t in near]
    rows = [(k, fp - (1 << 64) if fp >> 63 else fp) for k, fp in enumerate(fps)]
    edges = similar._by_fingerprints(spark.createDataFrame(rows, "uid long, fp long"), similar.RADIUS, most).collect()
    groups = brute.components(fps, lambda a, b: (a ^ b).bit_count() <= similar.RADIUS)
    linked = {frozenset((r.a, r.b)) for r in edges}
    assert brute.components(range(len(fps)), lambda i, j: frozenset((i, j)) in linked) == groups
    assert len(set(groups)) < len(groups)
