import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from tatterloom.operators import align, profile, sampling
from tatterloom.operators.schemas import Synonyms, cluster_blocks, header_groups
from tatterloom.plans import artifacts, cli, control, pipeline
from tatterloom.sources import lines as source
from tatterloom.sources import sinks
from tatterloom.sources.tables import VERSIONS, Tables
from tatterloom.streaming.ingest import ingest


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "in"
    (d / "deep").mkdir(parents=True)
    (d / "a.csv").write_text("customer_name,email,age\nAnn,a@x.org,30\nBob,b@x.org\nCy,,x,extra\n\n")
    (d / "deep" / "b.txt").write_text("email;customer_name;age\nd@x.org;Di;41\ne@x.org;Ed;50")
    (d / "c.tsv").write_bytes("місто\tвік\nКиїв\t5\n".encode("cp1251"))
    (d / "d.log").write_text("not read")
    return d


def test_files_and_numbered_lines(spark, folder, tmp_path):
    files = source.input_files(spark, [str(folder), str(folder / "d.log"), str(folder / "a.csv")])
    assert [f.rsplit("/", 1)[1] for f in files] == ["a.csv", "c.tsv", "b.txt", "d.log", "a.csv"][: len(files)]
    found = source.raw_lines(spark, [f for f in files if not f.endswith("log")])
    by_file = {}
    for r in sorted(found.collect(), key=lambda r: r.line_no):
        by_file.setdefault(r.file_id.rsplit("/", 1)[1], []).append((r.line_no, r.raw))
    assert by_file["c.tsv"] == [(0, "місто\tвік"), (1, "Київ\t5")]
    assert by_file["b.txt"][2] == (2, "e@x.org;Ed;50") and len(by_file["a.csv"]) == 5


def test_numbers_across_splits(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"f{k}.csv").write_text("".join(f"{k},{i}\n" for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        found = source.raw_lines(spark, [str(tmp_path / f"f{k}.csv") for k in range(2)]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found) == 8000 and all(int(r.raw.split(",")[1]) == r.line_no for r in found)


def test_block_plan_covers_and_keeps_gaps(spark):
    files = spark.createDataFrame([("a", 1000), ("b", 1), ("c", 0), ("d", 57_000)], "file_id string, total_lines long")
    plan = sampling.block_plan(files, 1000, 200).collect()
    own = {f: sorted((r.start_line, r.end_line) for r in plan if r.file_id == f) for f in "abcd"}
    assert own["b"] == [(0, 0)] and own["c"] == [] and own["a"] == [(0, 999)]
    assert own["d"][0][0] == 0 and own["d"][-1][1] == 56_999
    assert all(b[0] <= a[1] + 1 for a, b in zip(own["d"], own["d"][1:], strict=False))


@pytest.mark.parametrize(
    ("cells", "sources", "targets", "want"),
    [
        (["a", "b", "c"], None, None, ["a", "b", "c"]),
        (["a", "b", "c"], [0, 1], [1, 0], ["b", "a", "c"]),
        (["a"], [0], [2], ["", "", "a"]),
        (["a", "b", "c"], [0, 2], [1, 1], ["b", "c", ""]),
        (["a", "b"], [5], [0], ["", "a"]),
        ([""], [], [], [""]),
    ],
)
def test_alignment(spark, cells, sources, targets, want):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(cells, sources, targets)], "cells array<string>, s array<int>, t array<int>")
    assert row.select(align.aligned(F.col("cells"), F.col("s"), F.col("t")).alias("x")).first().x == want


def test_contract_counts(spark):
    specs = [align.Spec("name", index=0), align.Spec("email", index=1), align.Spec("age", "int", min_value=0, max_value=99, index=2), align.Spec("gone", required=True), align.Spec("note", allow_null=True)]
    rows = spark.createDataFrame([(["a", "b", "3"],), (["a", " ", "x"],), (["a", "b", "100", "z"],), ([""],), (["a", "b", "nan"],)], "cells array<string>").selectExpr("cells", "size(cells) AS observed")
    got = align.validated(rows, 3, specs).agg(*align.summary_columns()).first().asDict()
    assert got == {"total_rows": 5, "short_rows": 1, "long_rows": 1, "empty_rows": 1, "missing_required": 5 + 1 + 3, "type_mismatches": 3}


def test_synonyms_and_groups(spark):
    names = Synonyms.of({"order_total": ["Order Total", "order-total"]})
    assert names.canonical("order total") == "order_total" and names.canonical("Other Name") == "other_name" and names.canonical("дата") == "column"
    assert names.with_variant("x", "Sum").canonical("SUM") == "x"
    raw = spark.createDataFrame([("Order Date",), ("order_date",), (" ORDER-date ",), ("Місто",)], "raw string")
    assert {r.slug: len(r.variants) for r in header_groups(raw).collect()}["order date"] == 3


def test_alike_headers_share_a_schema(spark):
    rows = [(0, ",", 2, "Customer Id,Order Total"), (1, ",", 2, "Customer Id,Order Total"), (2, ",", 2, "customer_id,order_totl"), (3, ";", 2, "Customer Id;Order Total"), (4, ",", 2, "x,y")]
    found = cluster_blocks(spark.createDataFrame(rows, "ord long, delimiter string, column_count int, header_sample string"), Synonyms({}))
    assert {r.ord: r.schema_ord for r in found.collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}


def test_all_phases_and_resume(spark, folder, tmp_path, monkeypatch):
    config = control.load_config("low_memory")
    mapping = pipeline.review(pipeline.analyze(spark, [str(folder)], config))
    assert mapping.schemas.count() == 3
    document = mapping.document()
    artifacts.save_mapping(document, tmp_path / "m.json")
    assert artifacts.load_mapping(tmp_path / "m.json")["artifact_version"] == artifacts.ARTIFACT_VERSION
    assert len(artifacts.write_artifacts(document, tmp_path / "m.json")) == 2
    contracts = artifacts.Contracts()
    contracts.register(artifacts.Contract.of({"schema_id": "customer_name", "columns": [{"name": "email"}, {"name": "age", "data_type": "int"}]}))
    mapping, bound = pipeline.normalize(mapping, contracts)
    assert len(bound) == 1
    tables = Tables(spark, str(tmp_path / "tables"))
    tables.migrate()
    tables.persist_mapping(mapping)
    assert tables.read("schemas").count() == 3 and tables.read("column_profiles").count() == tables.read("header_occurrences").count() == 9
    assert json.loads(tables.read("header_profiles").where("raw_header = 'age'").first().type_profile_json)["integer"] == 3
    real, calls = pipeline.write_rows, []

    def crash_once(*a, **k):
        calls.append(a[2])
        if len(calls) == 2:
            raise RuntimeError("lost")
        real(*a, **k)

    monkeypatch.setattr(pipeline, "write_rows", crash_once)
    dest, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    with pytest.raises(RuntimeError):
        pipeline.materialize(mapping, dest, config, contracts=bound, job_id="j", checkpoint_dir=marks, telemetry=str(tmp_path / "t.jsonl"))
    done = pipeline.materialize(mapping, dest, config, contracts=bound, job_id="j", checkpoint_dir=marks, telemetry=str(tmp_path / "t.jsonl"))
    assert len(calls) == 4 and len(done) == 3 and not (tmp_path / "marks" / "materialize" / "j.json").exists()
    people = next(s for s in done if s.schema_name == "customer_name")
    assert people.rows_written == 4 and people.validation["short_rows"] == 2 and people.validation["long_rows"] == 1 and people.validation["type_mismatches"] == 1
    rows = spark.read.option("header", True).csv(f"{dest}/{people.target}").collect()
    assert sum(r.customer_name == "Ann" for r in rows) == 1
    states = [json.loads(x)["state"] for x in (tmp_path / "t.jsonl.jobs").read_text().splitlines()]
    assert states[-1] == "DONE" and "FAILED" in states
    assert {r["schema_name"] for r in pipeline.plan(mapping, str(tmp_path / "plan.json"))} >= {"customer_name"}


def test_swapped_columns_are_put_in_the_founders_order(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, head in enumerate(["client name,client email", "client email,client name"]):
        row = [f"n{k}", f"e{k}@x.org"]
        (tmp_path / "in" / f"{k}.csv").write_text(f"{head}\n{','.join(row if k == 0 else row[::-1])}\n")
    mapping = pipeline.review(pipeline.analyze(spark, [str(tmp_path / "in")], control.load_config()))
    rows = []
    for s in pipeline.materialize(mapping, str(tmp_path / "out"), control.load_config()):
        rows += [(r.client_name, r.client_email) for r in spark.read.option("header", True).csv(f"{tmp_path}/out/{s.target}").collect()]
    assert sorted(rows) == [("n0", "e0@x.org"), ("n1", "e1@x.org")]


def test_quoted_cells(spark, tmp_path):
    (tmp_path / "q.csv").write_text('a;b\n"x;1";"two\nlines"\n;"say ""hi"""\n')
    assert [r.cells for r in source.quoted_cells(spark, str(tmp_path / "q.csv"), ";").collect()] == [["a", "b"], ["x;1", "two\nlines"], ["", 'say "hi"']]


def test_sinks(spark, tmp_path):
    import sqlite3

    df = spark.createDataFrame([(str(k), "x") for k in range(5)], "id string, v string").coalesce(1)
    sinks.write_rows(df, "csv", str(tmp_path / "c"), 2)
    assert len(list((tmp_path / "c").glob("*.csv"))) == 3
    sinks.write_rows(df, "parquet", str(tmp_path / "p"), 2)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5
    for _ in range(2):
        sinks.write_rows(df, "database", "", db_url=f"sqlite:///{tmp_path}/d.db", table="users")
    with sqlite3.connect(tmp_path / "d.db") as db:
        assert db.execute("SELECT count(*) FROM users").fetchone() == (5,)
    with pytest.raises(ValueError, match="none of"):
        sinks.write_rows(df, "xml", "")
    assert sinks.distinct_names(["a", "", "a"]) == ["a", "column_2", "a_2"] and sinks.distinct_names([]) == ["column_1"]


def test_tables(spark, tmp_path):
    tables = Tables(spark, str(tmp_path / "t"))
    assert tables.migrate() == sorted(VERSIONS) and tables.migrate() == []
    tables.job_metrics(schema_id="s", rows_written=120, short_rows=2, long_rows=1, empty_rows=5)
    assert tables.read("job_metrics").first().error_count == 3
    for k in range(5):
        tables.progress(schema_id="s", processed_rows=k)
    tables.progress(file_path="/x/stem.csv", processed_rows=9)
    assert [r.processed_rows for r in tables.progress_events("s", 2).collect()] == [4, 3]
    tables.prune_progress(3, "s")
    assert tables.read("job_progress_events").count() == 4
    tables.prune_progress(0)
    assert tables.read("job_progress_events").count() == 0
    tables.job_event("j", "PENDING")
    tables.job_event("j", "FAILED", "why", error="why")
    row = tables.job_status("j").first()
    assert row.state == "FAILED" and row.last_error == "why" and row.created_at < row.updated_at


def test_control(tmp_path):
    with pytest.raises(control.EngineError, match="CONFIG_ERROR"):
        control.load_config("none")
    with pytest.raises(control.EngineError, match="greater than zero"):
        control.load_config(overrides={"profile": {"block_size": 0}})
    with pytest.raises(control.EngineError, match="none of"):
        control.load_config(overrides={"global": {"error_policy": "guess"}})
    assert control.load_config("workstation").profile.block_size == 10_000 and control.error_mode("strict") == "strict"
    box = control.Sandbox(tmp_path / "r", (tmp_path / "other",))
    assert box.resolve("a", "b") == (tmp_path / "r" / "a" / "b").resolve() and box.resolve(str(tmp_path / "other" / "x"))
    with pytest.raises(control.EngineError):
        box.resolve("..", "x")
    with pytest.raises(control.EngineError):
        box.resolve("gone", must_exist=True)
    budget = control.Budget(control.Limits(10, 20, 3, str(tmp_path / "s")))
    with budget.reserve(memory_mb=8, workers=2):
        with pytest.raises(control.OverBudget):
            budget.reserve(memory_mb=3)
        assert budget.available("memory_mb") == 2
    assert budget.available("memory_mb") == 10 and budget.plan_workers(9) == 3
    assert budget.scratch_dir("a/b").name == "a-b"
    job = control.Job("j")
    job.transition(control.JobState.VALIDATING)
    with pytest.raises(ValueError, match="no way"):
        job.transition(control.JobState.MAPPING)
    job.fail()
    with pytest.raises(ValueError, match="no way"):
        job.transition(control.JobState.DONE)
    throttle = control.Throttle(4)
    assert [throttle.report(9) for _ in range(4)] == [3, 2, 1, 1]
    assert control.progress(50, 100, 5)["eta_seconds"] == 5 and control.progress(1, 10**8, 1)["total_rows"] == 0
    marks = control.Manifests(tmp_path / "m")
    marks.save("j", "p", {"a": 1})
    assert marks.load("j", "p")["a"] == 1 and marks.load("k", "p") == {}


def test_streaming_reads_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,n\n1,2\n3\n")
    run = lambda: ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks"), ["id", "n"], [align.Spec("n", "int", index=1)], header="id,n").awaitTermination()
    run()
    (tmp_path / "in" / "b.csv").write_text("id,n\n5,x,y\n")
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.id, r.n, r.is_short, r.is_long, r.n_missing, r.n_mismatch) for r in rows) == [("1", "2", False, False, 0, 0), ("3", "", True, False, 1, 0), ("5", "x", False, True, 0, 1)]


def test_database_rows_are_numbered_in_chunks(spark, folder, tmp_path):
    config = control.load_config("low_memory", overrides={"profile": {"writer_chunk_rows": 2}})
    done = pipeline.materialize(pipeline.review(pipeline.analyze(spark, [str(folder / "a.csv")], config)), str(tmp_path), config, "database", db_url=f"sqlite:///{tmp_path}/d.db")
    with sqlite3.connect(tmp_path / "d.db") as db:
        found = db.execute(f'SELECT customer_name, chunk_index, row_in_chunk FROM "{done[0].target}" ORDER BY 2, 3').fetchall()
    assert [f[1:] for f in found] == [(k // 2, k % 2) for k in range(len(found))] and [f[0] for f in found][:3] == ["Ann", "Bob", "Cy"]


def test_command_line_stays_in_its_folder(tmp_path, monkeypatch, capsys):
    (tmp_path / "here").mkdir()
    monkeypatch.chdir(tmp_path / "here")
    assert cli.main(["analyze", "../other.csv"]) == 1 and "outside the sandbox" in capsys.readouterr().err
    args = cli.checked(cli.parser().parse_args(["analyze", str(tmp_path), "s3://bucket/x", "--output", "out/m.json"]))
    assert args.inputs == [str(tmp_path), "s3://bucket/x"] and args.output == str(tmp_path / "here" / "out" / "m.json")


def test_command_line(folder, tmp_path, spark, capsys):
    assert cli.main(["analyze", str(folder), "--output", str(tmp_path / "m.json")]) == 0
    assert (tmp_path / "m.header_clusters.json").exists()
    assert cli.main(["analyze", str(folder), "--profile", "none"]) == 1


def test_sampled_lines_join_a_few_rows_per_block(spark, monkeypatch):
    sides, small = [], getattr(sampling, "small", None)
    monkeypatch.setattr(sampling, "small", lambda df: sides.append(df.count()) or small(df), raising=False)
    lines = spark.range(3000).selectExpr("'a' AS file_id", "id AS line_no", "concat('x', id) AS raw").where("line_no % 5 <> 3")
    blocks = [(0, 0, 299), (1, 130, 420), (2, 400, 410), (3, 700, 2900), (4, 2950, 2999)]
    found = sampling.sampled_lines(lines, spark.createDataFrame([("a", *b) for b in blocks], "file_id string, block_id int, start_line long, end_line long"))
    own = [(0, 0), (1, 300), (3, 700), (4, 2950)]
    want = {(b, n, f"x{n}", n - a) for b, a in own for n in range(a, min(a + 100, [r[2] for r in blocks if r[0] == b][0] + 1)) if n % 5 != 3}
    assert {(r.block_id, r.line_no, r.raw, r.ord) for r in found.collect()} == want and found.count() == len(want)
    assert len(sides) == 1 and sides[0] <= 2 * len(own)


def test_sketches_are_not_kept_per_distinct_value(spark):
    import oracle

    from tatterloom import queries

    plan = queries.approx_distinct(spark, oracle.SF)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "approx_count_distinct" in line and "value#" in line.split("functions=")[0]]
    df = spark.createDataFrame([(1, 0.0, "a"), (1, -0.0, None), (2, 1.5, "a ")], "k int, x double, s string")
    found = profile.distinct_values(df, {c: F.col(c) for c in df.columns})
    assert sorted((r.header, r.value or "-") for r in found.collect()) == [("k", "1"), ("k", "2"), ("s", "-"), ("s", "a"), ("s", "a "), ("x", "-0.0"), ("x", "0.0"), ("x", "1.5")]


def test_blocks_meet_their_schemas_unshuffled(spark):
    blocks = spark.range(2000).selectExpr("id AS ord", "',' AS delimiter", "2 AS column_count", "concat('total,col ', repeat(char(97 + id % 3), 9)) AS header_sample")
    found = cluster_blocks(blocks, Synonyms({}))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert {(r.ord, r.schema_ord) for r in found.collect()} == {(k, k % 3) for k in range(2000)}


def test_exact_profiles_of_ragged_rows(spark):
    rows = spark.range(300).selectExpr("'a' AS file_id", "id AS line_no", "if(id % 100 = 50, array('1', ' x', '', 'z'), array(string(id % 7), if(id % 2 = 0, 'x', 'x ')))  AS cells")
    found = profile.profile_rows(rows, spark.createDataFrame([("a", ["k", "v", "none"])], "file_id string, headers array<string>"), exact=True)
    got = {r.idx: (r.header, r.unique_estimate, r.n_integer, r.n_text, r.n_null, r.total_values) for r in found.collect()}
    assert got == {0: ("k", 7, 300, 0, 0, 300), 1: ("v", 1, 0, 300, 0, 300), 2: ("none", 0, 0, 0, 300, 300), 3: ("column_4", 1, 0, 3, 247, 250)}
    assert "SortMergeJoin [file_id" not in "".join(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "line_no" in line)
