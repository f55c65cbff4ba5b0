import collections

import brute
import oracle
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tatterloom.llm import queries

CONTRACT = {
    1: {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    2: {"doc_id", "held_out", "score", "predicted"},
    3: {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    4: {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    5: {"doc_id", "start", "n_tokens", "ids_crc32"},
    6: {"page_id", "url", "text", "n_chars"},
    7: {"doc_id", "fingerprint", "component_id"},
    8: {"doc_id", "n_words", "n_removed", "kept_sha256"},
    9: {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    10: {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
}


def documents(spark, table="documents"):
    return spark.read.parquet(f"{oracle.SF}/{table}.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_what_its_sql_gives(name, spark):
    oracle.same(queries.queries()[name], queries.oracle_sql()[name], spark)


@pytest.mark.parametrize("name", sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0])))
def test_columns_and_row_counts(name, spark):
    found = queries.queries()[name](spark, oracle.SF)
    number = int(name[2:].split("_")[0])
    assert set(found.columns) >= CONTRACT[number]
    assert found.count() == documents(spark, "pages" if number in (6, 10) else "documents").count()


def test_near_groups_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    found = [(r.doc_id, r.fingerprint, r.component_id) for r in queries.op7_simhash_near_dedup(spark, oracle.SF).collect()]
    assert sorted(found) == sorted(brute.near_groups(rows))


def test_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in documents(spark, "labels").collect()}
    held = [r for r in queries.op2_quality_classifier(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    marked = [r for r in held if r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in marked) >= 0.95 * len(marked)


def test_pipeline_is_its_stages_by_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    good = {r.doc_id for r in queries.op2_quality_classifier(spark, oracle.SF).collect() if r.predicted}
    left = [d for d in docs if d[0] in good]
    kept = {keep for _, keep, _, _ in brute.exact_groups(left)}
    left = [d for d in left if d[0] in kept]
    least = set(brute.least_similar(left))
    left = [d for d in left if d[0] in least]
    items = [(r.item_id, r.text) for r in documents(spark, "benchmark").collect()]
    clean = {d for d, _, hit, _ in brute.contamination(left, items) if not hit}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {d: tokenizer.encode(t, add_special_tokens=False).ids for d, t in left if d in clean}
    found = corpus_pipeline.run(spark, oracle.SF).collect()
    assert {r.doc_id: list(r.ids) for r in found} == want and len(found) == len(want)


def test_pipeline_on_rows_of_all_kinds(docs, rows, spark, tmp_path):
    """Nulls, empty texts, repeated rows and columns of clashing names go through all stages."""
    labels = [(d, int(len(t or "") % 5 > 0)) for d, t in rows if d is not None]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "one two three four"), (1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = collections.defaultdict(set)
    for d, t in rows:
        texts[d].add(t or "")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert 0 < len(found) <= len(rows)
    assert all(list(r.ids) in [tokenizer.encode(t, add_special_tokens=False).ids for t in texts[r.doc_id]] for r in found)


def test_pipeline_on_an_empty_table(empty, spark, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
