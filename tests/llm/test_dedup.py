import random

import brute
import numpy as np
import pytest

from tatterloom.llm import common, decontaminate, exact_dedup, simhash, similar, substring_dedup
from tatterloom.llm.components import star_components


def test_exact_decisions(docs, rows):
    found = exact_dedup.duplicate_decisions(docs).collect()
    assert len(found) == len(rows)
    assert {(r._row_id, r.keep_id, r.group_size, bytes(r.sha).hex()) for r in found} == brute.exact_groups(rows)
    kept = [bytes(r.sha) for r in found if r.kept]
    assert len(kept) == len(set(kept)) == len({brute.lower(t) for _, t in rows})
    assert all(r._row_id == r.keep_id for r in found if r.kept)


def test_exact_keeps_one_row_of_each_text(docs, rows):
    found = exact_dedup.exact_dedup(docs)
    assert found.columns == docs.columns
    texts = [brute.lower(r.text) for r in found.collect()]
    assert sorted(texts) == sorted({brute.lower(t) for _, t in rows})


def test_exact_full_filter_gives_the_same(docs, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MIN_CELLS", 1 << 4)
    monkeypatch.setattr(exact_dedup, "MAX_CELLS", 1 << 4)
    found = exact_dedup.duplicate_decisions(docs).collect()
    assert {(r._row_id, r.keep_id, r.group_size, bytes(r.sha).hex()) for r in found} == brute.exact_groups(rows)


@pytest.fixture
def shuffled(monkeypatch):
    """No side is few enough to be broadcast, bitmaps come one at a time, one group in two is hot."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(common, "BITMAPS", 1)
    monkeypatch.setattr(common, "HOT", 2)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(decontaminate, "MOST_KEYS", 0)


def test_exact_in_slices_without_broadcasts(docs, rows, shuffled, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SLICE_ROWS", 80)
    found = exact_dedup.duplicate_decisions(docs).collect()
    assert {(r._row_id, r.keep_id, r.group_size, bytes(r.sha).hex()) for r in found} == brute.exact_groups(rows)
    texts = [brute.lower(r.text) for r in exact_dedup.exact_dedup(docs).collect()]
    assert sorted(texts) == sorted({brute.lower(t) for _, t in rows})


def test_contamination_without_broadcasts(docs, rows, shuffled, spark):
    items = [(k, t) for k, (_, t) in enumerate(rows[::9])] + [(None, "one"), (1000, "x1 b"), (1001, None)]
    found = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    got = [(r._row_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect()]
    want = [(d, n, hit, tuple(x for x in ids if x != "None")) for d, n, hit, ids in brute.contamination(rows, items)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_similar_without_broadcasts(docs, rows, shuffled):
    found = similar.similar_dedup(docs)
    assert found.columns == docs.columns
    assert sorted((r.doc_id for r in found.collect()), key=str) == brute.least_similar(rows)


def test_exact_hot_copies(spark):
    docs = spark.createDataFrame([(k, "same" if k % 3 else f"t{k}") for k in range(3000)], "doc_id long, text string")
    found = exact_dedup.duplicate_decisions(docs).where("kept").collect()
    assert len(found) == 1001 and max(r.group_size for r in found) == 2000


def test_empty_tables(empty):
    for f in (exact_dedup.duplicate_decisions, exact_dedup.exact_dedup, simhash.near_duplicates, substring_dedup.repeat_digests):
        assert f(empty).count() == 0


def test_simhash_groups(docs, rows):
    found = [(r._row_id, f"{r.fp & simhash.ALL:016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(found, key=str) == sorted(brute.near_groups(rows), key=str)


@pytest.mark.parametrize("spread", [1, 40])
def test_forest_is_all_links(spread):
    rng = np.random.default_rng(spread)
    base = rng.integers(0, 1 << 63, spread, dtype=np.uint64)
    flips = [base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 63, (60, 2))]
    codes = np.unique(np.concatenate([base, *flips]))
    a, b = simhash.forest(codes)
    place = {int(c): k for k, c in enumerate(codes)}
    linked = {frozenset((place[int(x)], place[int(y)])) for x, y in zip(a, b, strict=True)}
    mine = brute.components(range(len(codes)), lambda i, j: frozenset((i, j)) in linked)
    assert mine == brute.components([int(c) for c in codes], lambda x, y: (x ^ y).bit_count() <= 2)


def test_hot_index_keys_are_dealt_again(spark):
    rng = np.random.default_rng(3)
    codes = np.unique(np.concatenate([np.uint64(1 << int(a)) ^ rng.integers(0, 1 << 12, 40, dtype=np.uint64) for a in rng.integers(0, 63, 20)]))
    table = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    star = {r.a: r.b for r in star_components(simhash.links(table, most=5)).collect()}
    label = [star.get(int(c), int(c)) for c in codes.view(np.int64)]
    roots = brute.components([int(c) for c in codes], lambda x, y: (x ^ y).bit_count() <= 2)
    assert len({*zip(label, roots, strict=True)}) == len(set(label)) == len(set(roots))


def test_star_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 101)], "a long, b long")
    assert {r.a: r.b for r in star_components(edges).collect()} == {**{k: 0 for k in range(1, 51)}, 101: 100}


def test_substring(docs, rows):
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.without_repeats(docs).collect()]
    assert sorted(found, key=str) == sorted(brute.repeats(rows), key=str)


def test_substring_from_files_and_in_batches(docs, rows, spark, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    found = substring_dedup.without_repeats(spark.read.parquet(str(tmp_path / "d")), batches=5)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found.collect()), key=str) == sorted(brute.repeats(rows), key=str)


def test_substring_edges_of_a_shared_passage(spark):
    shared = [f"s{k}" for k in range(60)]
    docs = [(k, " ".join([*(f"a{k}.{j}" for j in range(k)), *shared[k : 60 - k], *(f"b{k}.{j}" for j in range(40))])) for k in range(14)]
    found = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(found) == sorted(brute.repeats(docs))


def test_substring_index_is_opened_again(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(80)] for _ in range(10)]
    line = lambda: " ".join([*(f"x{rng.randint(0, 900)}" for _ in range(rng.randint(0, 60))), *rng.choice(base)[rng.randint(0, 20) : rng.randint(40, 80)]])
    rows = [(k, line()) for k in range(120)]
    early, late = (common.stored(spark.createDataFrame(part, "doc_id long, text string")) for part in (rows[:50], rows[50:]))
    folder = common.shared_dir(spark, "index")
    first = substring_dedup.FingerprintIndex(spark, folder, 4)
    first.add(early)
    first.close()
    again = substring_dedup.FingerprintIndex(spark, folder)
    number = again.add(late)
    ids = {(r.file, r.row): r.doc_id for r in late.select("doc_id", *common.place(late)).collect()}
    gone = {d: set() for d in ids.values()}
    for r in again.repeated_spans([number]).collect():
        for k in range(r.span // 32, r.span // 32 + r.span % 32 + 1):
            gone[ids[r.file, r.row]].update(range(k, k + 35))
    again.close()
    assert {d: len(x) for d, x in gone.items()} == {d: n for d, _, n, _ in brute.repeats(rows) if d >= 50}


def test_substring_runs_merge_as_they_lie(spark):
    index = substring_dedup.FingerprintIndex(spark, common.shared_dir(spark, "index"), 4)
    runs = [index._run(index._write_run(spark.createDataFrame([(k, k % 3, 1)], "anchor long, cover long, n long").repartition(4, "anchor"))["path"]) for k in (1, 2)]
    with substring_dedup._as_stored(spark):
        plan = substring_dedup.merged_runs(*runs)._jdf.queryExecution().executedPlan().toString()
    index.close()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
