"""The registered queries of the engine's own operators, with the SQL that gives the same rows.

Ragged text is derived from the tables by expressions that Spark and DuckDB share: a field is dropped from every
seventh row, one is added to every eleventh, and every thirteenth line is blank.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tatterloom.functions import scalars as S
from tatterloom.operators import align, blocks, headers, offsets, profile, sampling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Derived ragged text, in expressions of both dialects

_ORDER = "CAST(o_orderkey AS STRING) || ',' || CAST(o_custkey AS STRING) || ',' || o_orderstatus || ',' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)"
_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
LINE = f"CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN {_ORDER} WHEN o_orderkey % 11 = 0 THEN {_ORDER} || ',' || {_DAY} || ',extra' ELSE {_ORDER} || ',' || {_DAY} END"
FILE, NUMBER = "CAST(o_orderkey % 3 AS INT)", "CAST(floor(o_orderkey / 3) AS BIGINT)"
RAGGED = f"SELECT {FILE} AS file_id, {NUMBER} AS line_no, {LINE} AS raw FROM orders"
CELLS = f"SELECT file_id, line_no, raw, string_split(raw, ',') AS cells FROM ({RAGGED})"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "orders").selectExpr(f"{FILE} AS file_id", f"{NUMBER} AS line_no", f"{LINE} AS raw")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).withColumn("cells", S.split_line(F.col("raw"), ","))


_KIND = r"""CASE WHEN trim({v}) = '' OR {v} IS NULL THEN 'empty' WHEN regexp_matches({v}, '\b\d{{1,4}}[./-]\d{{1,2}}[./-]\d{{1,4}}\b') THEN 'date'
 WHEN regexp_full_match(trim({v}), '[+-]?\d+') THEN 'integer' WHEN regexp_full_match(replace(trim({v}), ',', '.'), '[+-]?(\d+\.\d*|\d*\.\d+)') THEN 'float' ELSE 'text' END"""
_NUM = "try_cast(replace(trim({v}), ',', '.') AS DOUBLE)"


def _kind(v: str) -> str:
    return _KIND.format(v=v)


_PROFILE = f"""count(*) FILTER (kind = 'integer') AS n_integer, count(*) FILTER (kind = 'float') AS n_float, count(*) FILTER (kind = 'text') AS n_text,
 count(*) FILTER (kind = 'date') AS n_date, count(*) FILTER (kind = 'empty') AS n_null, count(*) AS total_values,
 count(DISTINCT CASE WHEN kind <> 'empty' THEN trim(value) END) AS unique_estimate,
 min(CASE WHEN kind IN ('integer', 'float') THEN {_NUM.format(v="value")} END) AS numeric_min, max(CASE WHEN kind IN ('integer', 'float') THEN {_NUM.format(v="value")} END) AS numeric_max,
 min(CASE WHEN kind = 'date' THEN strftime(try_strptime(trim(value), '%Y-%m-%d'), '%Y-%m-%d') END) AS date_min, max(CASE WHEN kind = 'date' THEN strftime(try_strptime(trim(value), '%Y-%m-%d'), '%Y-%m-%d') END) AS date_max"""

_STACKED = {
    "orders": [("o_orderkey", "o_orderkey"), ("o_custkey", "o_custkey"), ("o_orderstatus", "o_orderstatus"), ("o_totalprice", "CAST(o_totalprice AS DECIMAL(18,2))"), ("o_orderdate", "CAST(o_orderdate AS DATE)"), ("o_orderpriority", "o_orderpriority")],
    "lineitem": [(c, c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")] + [(c, f"CAST({c} AS DECIMAL(18,2))") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")] + [("l_returnflag", "l_returnflag"), ("l_linestatus", "l_linestatus"), ("l_shipdate", "CAST(l_shipdate AS DATE)")],
    "customer": [("c_custkey", "c_custkey"), ("c_name", "c_name"), ("c_nationkey", "c_nationkey"), ("c_acctbal", "CAST(c_acctbal AS DECIMAL(18,2))"), ("c_mktsegment", "c_mktsegment")],
    "events": [("event_id", "event_id"), ("ts", "CAST(ts AS DATE)"), ("user_id", "user_id"), ("event_type", "event_type"), ("props", "props")],
}


def _stacked_sql(table: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS idx, '{h}' AS header, CAST({e} AS STRING) AS value FROM {table}" for i, (h, e) in enumerate(_STACKED[table]))


def _stacked(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    columns = _STACKED[table]
    return profile.stack_columns(_t(spark, sf_dir, table), [h for h, _ in columns], {h: F.expr(e) for h, e in columns})


def _profile_sql(table: str) -> str:
    return f"SELECT idx, header, {_PROFILE} FROM (SELECT *, {_kind('value')} AS kind FROM ({_stacked_sql(table)})) GROUP BY idx, header"


@query(_profile_sql("orders"))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_cells(_stacked(spark, sf_dir, "orders"), ["idx", "header"], exact=True)


@query(_profile_sql("lineitem"))
def column_profile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_cells(_stacked(spark, sf_dir, "lineitem"), ["idx", "header"], exact=True)


@query(_profile_sql("customer"))
def column_profile_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_cells(_stacked(spark, sf_dir, "customer"), ["idx", "header"], exact=True)


@query(f"SELECT header, {_kind('value')} AS kind, count(*) AS n FROM ({_stacked_sql('events')}) GROUP BY ALL")
def classify_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stacked(spark, sf_dir, "events").groupBy("header", S.classify(F.col("value")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT header, true AS within_error, count(DISTINCT value) AS exact FROM ({_stacked_sql('lineitem')}) GROUP BY header")
def approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates against exact counts; both from the distinct values, of which a sketch says the same as of all values."""
    values, v = profile.distinct_values(_t(spark, sf_dir, "lineitem"), {h: F.expr(e) for h, e in _STACKED["lineitem"]}), F.col("value")
    found = values.groupBy("header").agg(F.approx_count_distinct(v, profile.DISTINCT_ERROR).alias("about"), F.count(v).alias("exact"))
    return found.select("header", (F.abs(F.col("about") - F.col("exact")) <= 4 * profile.DISTINCT_ERROR * F.col("exact") + 1).alias("within_error"), "exact")


_DELIMITER = """CASE WHEN trim({v}) = '' THEN ',' WHEN c >= s AND c >= t AND c >= p THEN ',' WHEN s >= t AND s >= p THEN ';' WHEN t >= p THEN chr(9) ELSE '|' END"""
_DOC_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents"


def _doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "raw"))


@query(
    f"SELECT {_DELIMITER.format(v='raw')} AS delimiter, count(*) AS n FROM (SELECT raw, len(raw) - len(replace(raw, ',', '')) AS c, len(raw) - len(replace(raw, ';', '')) AS s, "
    f"len(raw) - len(replace(raw, chr(9), '')) AS t, len(raw) - len(replace(raw, '|', '')) AS p FROM ({_DOC_LINES})) GROUP BY ALL"
)
def detect_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_lines(spark, sf_dir).groupBy(S.detect_delimiter(F.col("raw")).alias("delimiter")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(text) - len(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS total_lines FROM documents")
def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tatterloom.sources.lines import counted_lines

    return _t(spark, sf_dir, "documents").select("doc_id", counted_lines(F.col("text")).alias("total_lines"))


_FIRST = f"SELECT doc_id, arg_min(raw, line_no) AS raw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) WHERE trim(raw) <> '' GROUP BY doc_id"


@query(
    f"SELECT doc_id AS file_id, delimiter, array_to_string(list_transform(string_split(raw, delimiter), lambda x: trim(x)), '~') AS headers FROM (SELECT *, {_DELIMITER.format(v='raw')} AS delimiter FROM (SELECT *, len(raw) - len(replace(raw, ',', '')) AS c, "
    f"len(raw) - len(replace(raw, ';', '')) AS s, len(raw) - len(replace(raw, chr(9), '')) AS t, len(raw) - len(replace(raw, '|', '')) AS p FROM ({_FIRST})))"
)
def header_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.first_headers(_doc_lines(spark, sf_dir).withColumnRenamed("doc_id", "file_id")).withColumn("headers", F.array_join("headers", "~")).drop("header_line")


@query(f"SELECT file_id, len(cells)::INT AS width, count(*) AS n FROM ({CELLS}) GROUP BY ALL")
def tokenize_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).groupBy("file_id", F.size("cells").alias("width")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT file_id, arg_max(width, n * 1000000000 - f) AS column_count FROM (SELECT file_id, len(cells)::INT AS width, count(*) AS n, min(line_no) AS f FROM ({CELLS}) GROUP BY ALL) GROUP BY file_id")
def width_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    widths = _cells(spark, sf_dir).groupBy("file_id", F.size("cells").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    return widths.groupBy("file_id").agg(F.max_by("width", F.struct("n", -F.col("first"))).alias("column_count"))


_GAP, _SIZE = 200, 300
_PLAN = f"""WITH RECURSIVE f AS (SELECT file_id, max(line_no) + 1 AS n FROM ({RAGGED}) GROUP BY file_id),
g(file_id, n, l, r) AS (SELECT file_id, n, 0::BIGINT, (n - 1)::BIGINT FROM f UNION ALL
 SELECT file_id, n, CASE WHEN k = 0 THEN l ELSE l + (r - l) // 2 END, CASE WHEN k = 0 THEN l + (r - l) // 2 ELSE r END FROM g, (VALUES (0), (1)) AS s(k) WHERE r - l > {_GAP}),
pts AS (SELECT DISTINCT file_id, n, unnest([l, r]) AS pos FROM g),
ids AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY pos) - 1 AS block_id FROM pts),
b AS (SELECT file_id, block_id, least(n - 1, greatest(0, pos - {_SIZE // 2}) + {_SIZE} - 1) AS end_line FROM ids),
plan AS (SELECT file_id, min(block_id)::INT AS block_id, greatest(0, end_line - {_SIZE} + 1)::BIGINT AS start_line, end_line::BIGINT AS end_line FROM b GROUP BY file_id, end_line)
"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _lines(spark, sf_dir).groupBy("file_id").agg((F.max("line_no") + 1).alias("total_lines"))
    return sampling.block_plan(files, _SIZE, _GAP)


@query(_PLAN + "SELECT * FROM plan")
def block_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


_BLOCKS = "SELECT *, 's' || CAST(block_id % 4 AS STRING) AS schema_id, CAST(block_id % 4 AS INT) AS schema_ord FROM plan"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).withColumns({"schema_id": F.concat(F.lit("s"), (F.col("block_id") % 4).cast("string")), "schema_ord": (F.col("block_id") % 4).cast("int")})


@query(
    _PLAN + f"SELECT schema_id, block_id, count(*) AS lines, min(line_no) AS first_line, max(line_no) AS last_line FROM (SELECT file_id, line_no, schema_id, block_id, row_number() OVER (PARTITION BY file_id, line_no ORDER BY schema_ord, start_line, block_id) AS k "
    f"FROM ({RAGGED}) JOIN ({_BLOCKS}) USING (file_id) WHERE line_no BETWEEN start_line AND end_line) WHERE k = 1 GROUP BY schema_id, block_id"
)
def block_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the disjoint intervals of their first-winning blocks."""
    owned = blocks.assigned_lines(_lines(spark, sf_dir), blocks.compacted(_blocks(spark, sf_dir)))
    return owned.groupBy("schema_id", "block_id").agg(F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


@query(
    _PLAN + f"SELECT file_id, line_no, schema_id, block_id FROM (SELECT file_id, line_no, schema_id, block_id, row_number() OVER (PARTITION BY file_id, line_no ORDER BY schema_ord, start_line, block_id) AS k "
    f"FROM ({RAGGED}) JOIN ({_BLOCKS}) USING (file_id) WHERE line_no BETWEEN start_line AND end_line) WHERE k = 1"
)
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = blocks.covered_lines(_lines(spark, sf_dir), _blocks(spark, sf_dir))
    found = blocks.first_wins(joined.select("file_id", "line_no", "schema_ord", "start_line", "schema_id", "block_id"), ["file_id", "line_no"], [F.col("schema_ord"), F.col("start_line"), F.col("block_id")])
    return found.select("file_id", "line_no", "schema_id", "block_id")


@query(_PLAN + f"SELECT schema_id, 'Schema ' || schema_id AS schema_name, count(*) AS block_count, sum(end_line - start_line + 1)::BIGINT AS estimated_rows, array_to_string(list_sort(list(DISTINCT file_id)), ',') AS files FROM ({_BLOCKS}) WHERE schema_ord < 3 GROUP BY schema_id")
def plan_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _blocks(spark, sf_dir).withColumn("schema_id", F.when(F.col("schema_ord") < 3, F.col("schema_id")))
    schemas = own.select("schema_id", F.concat(F.lit("Schema "), "schema_id").alias("name")).where("schema_id is not null").distinct()
    return blocks.plan_rollup(own, schemas).withColumn("files", F.array_join(F.transform("files", lambda f: f.cast("string")), ","))


_MAP = "(VALUES (0, 0, 1), (0, 1, 0), (1, 4, 0), (1, 0, 6), (1, 2, 6)) AS m(file_id, source_index, target_index)"
_ALIGN = f"""SELECT file_id, line_no, CASE WHEN file_id = 0 THEN [coalesce(cells[2], ''), cells[1]] || cells[3:]
 WHEN file_id = 1 THEN [coalesce(cells[5], ''), coalesce(rest[1], ''), coalesce(rest[2], ''), coalesce(rest[3], ''), coalesce(rest[4], ''), coalesce(rest[5], ''), coalesce(cells[3], '')] ELSE cells END AS cells, len(cells)::INT AS observed
 FROM (SELECT *, list_filter(cells, lambda x, i: i NOT IN (1, 3, 5)) AS rest FROM ({CELLS}))"""


def _aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (1, 4, 0), (1, 0, 6), (1, 2, 6)], "file_id int, source_index int, target_index int")
    return align.align_rows(_cells(spark, sf_dir), entries)


@query(f"SELECT file_id, line_no, array_to_string(cells, '|') AS cells, observed FROM ({_ALIGN})")
def align_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _aligned(spark, sf_dir).select("file_id", "line_no", F.array_join("cells", "|").alias("cells"), "observed")


@query(f"SELECT file_id, line_no, array_to_string(list_resize(cells, 5, ''), '|') AS cells FROM ({CELLS})")
def fit_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("file_id", "line_no", F.array_join(align.fitted(F.col("cells"), 5), "|").alias("cells"))


SPECS = [
    align.Spec("order_id", "int", index=0), align.Spec("customer", "integer", min_value=100, max_value=1000, index=1), align.Spec("status", allowed_values=("F", "O"), index=2),
    align.Spec("total", "decimal", min_value=1000, index=3), align.Spec("day", "date", index=4), align.Spec("note", allow_null=True), align.Spec("items", "json"),
]
_COUNTS = f"""SELECT file_id, list_resize(cells, 5, '') AS w, len(cells) AS observed, raw FROM ({CELLS})"""
_CHECK = f"""SELECT file_id, observed, trim(raw) = '' AS is_empty,
 (w[1] = '')::INT + (w[2] = '')::INT + (w[3] = '')::INT + (w[4] = '')::INT + (w[5] = '')::INT + 1 AS n_missing,
 (w[2] <> '' AND NOT (try_cast(w[2] AS INT) BETWEEN 100 AND 1000))::INT + (w[3] <> '' AND w[3] NOT IN ('F', 'O'))::INT + (w[4] <> '' AND try_cast(w[4] AS DOUBLE) < 1000)::INT AS n_mismatch FROM ({_COUNTS})"""
_SUMMARY = f"""SELECT file_id, count(*) AS total_rows, count(*) FILTER (observed < 5) AS short_rows, count(*) FILTER (observed > 5) AS long_rows, count(*) FILTER (is_empty) AS empty_rows,
 sum(n_missing)::BIGINT AS missing_required, sum(n_mismatch)::BIGINT AS type_mismatches FROM ({_CHECK}) GROUP BY file_id"""


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.validated(_cells(spark, sf_dir).withColumn("observed", F.size("cells")), 5, SPECS)


@query(f"SELECT file_id, n_missing::BIGINT AS n_missing, n_mismatch::BIGINT AS n_mismatch, count(*) AS n FROM ({_CHECK}) GROUP BY ALL")
def validate_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).groupBy("file_id", "n_missing", "n_mismatch").agg(F.count(F.lit(1)).alias("n"))


@query(_SUMMARY)
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).groupBy("file_id").agg(*align.summary_columns())


@query(f"SELECT file_id, short_rows + long_rows + missing_required + type_mismatches AS error_count FROM ({_SUMMARY})")
def error_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation_summary(spark, sf_dir).select("file_id", align.error_count().alias("error_count"))


@query("SELECT o_orderstatus AS status, o_orderstatus IN ('F', 'O') AS ok, count(*) AS n FROM orders GROUP BY ALL")
def enum_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = align.check(F.col("o_orderstatus"), align.Spec("status", allowed_values=("F", "O")))
    return _t(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), (bad == 0).alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment AS segment, count(*) FILTER (CAST(c_acctbal AS DECIMAL(18,2)) < 0) AS below, count(*) FILTER (CAST(c_acctbal AS DECIMAL(18,2)) > 9000) AS above FROM customer GROUP BY ALL")
def bounds_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    low, high = (align.check(v, align.Spec("balance", "decimal", **b))[1] for b in ({"min_value": 0}, {"max_value": 9000}))
    return _t(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.sum(low).cast("long").alias("below"), F.sum(high).cast("long").alias("above"))


@query("SELECT event_type, json_valid(props) AS ok, json_valid(left(props, len(props) - 1)) AS cut_ok, count(*) AS n FROM events GROUP BY ALL")
def json_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.expr("left(props, length(props) - 1)")
    return _t(spark, sf_dir, "events").groupBy("event_type", S.is_json(F.col("props")).alias("ok"), S.is_json(cut).alias("cut_ok")).agg(F.count(F.lit(1)).alias("n"))


_CHUNK = 4000


@query(f"SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // {_CHUNK} AS chunk_index, (row_number() OVER (ORDER BY o_orderkey) - 1) % {_CHUNK} AS row_in_chunk FROM orders")
def chunk_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.chunked(_t(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], _CHUNK)


@query("SELECT event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 500")
def progress_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.newest(_t(spark, sf_dir, "events").select("event_type", "event_id", "ts"), "event_type", [F.col("ts").desc(), F.col("event_id").desc()])


@query("SELECT event_id, ts, event_type FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts DESC, event_id DESC LIMIT 100")
def progress_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    one = events.agg(F.min("event_type").alias("event_type"))
    return events.join(F.broadcast(one), "event_type").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(100)


@query("SELECT user_id AS job_id, min(ts) AS created_at, count(*) AS events, arg_max(event_type, (ts, event_id)) AS state, max((ts, event_id))[1] AS updated_at FROM events GROUP BY user_id")
def job_status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("state"), F.col("ts").alias("updated_at"), "event_id")
    return blocks.latest(events, "job_id", F.struct("updated_at", "event_id"), "updated_at").drop("event_id")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 6) AS moving_avg FROM events")
def throttle_moving_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.moving_average(_t(spark, sf_dir, "events"), "value", "event_id", "user_id").select("event_id", F.round("moving_avg", 6).alias("moving_avg"))


# Headers: the tables' own column names as three files' headers, with types from what the names suggest

_NAMES = [
    "r_regionkey", "r_name", "n_nationkey", "n_name", "n_regionkey", "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "s_suppkey", "s_name", "s_nationkey", "s_acctbal",
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "Order Date", "order-date", "ORDERDATE", "Month", "mon", "місяць", "City", "місто", "town", "Age", "years", "Customer Id", "customer_id", "cust id", "Total", "total price", "",
]


def _header_rows() -> list[tuple]:
    """(file_id, idx, raw, ord, n_date, n_integer, n_float, n_text, n_empty): each name in one to three files."""
    rows = []
    for k, name in enumerate(_NAMES):
        for f in range(1 + k % 3):
            numeric = name.lower().endswith(("key", "id", "years")) or name in ("Age", "")
            money, day = any(w in name.lower() for w in ("total", "acctbal")), "date" in name.lower()
            rows.append((f"f{f}", k - (f if k % 4 == 0 else 0), name, len(rows), 90 if day else 0, 80 if numeric else 0, 70 if money else 0, 60 if not (day or numeric or money) else 5, 3 + f))
    return rows


_HEADER_COLUMNS = "file_id string, idx int, raw string, ord int, n_date long, n_integer long, n_float long, n_text long, n_empty long"
_HEADERS = "(VALUES " + ", ".join(str(r).replace('"', "'") for r in _header_rows()) + ") AS h(file_id, idx, raw, ord, n_date, n_integer, n_float, n_text, n_empty)"


def _headers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_header_rows(), _HEADER_COLUMNS)


def _slugs_sql() -> str:
    """Distinct headers with their Latin slugs, by replacing letters one by one."""
    from tatterloom.functions.names import CYRILLIC

    slug = "lower(h)"
    for k, v in CYRILLIC.items():
        slug = f"replace({slug}, '{k}', '{v}')"
    return f"SELECT h, trim(regexp_replace({slug}, '[^a-z0-9]+', ' ', 'g')) AS s FROM (SELECT DISTINCT CASE WHEN trim(raw) <> '' THEN trim(raw) ELSE 'column_' || CAST(idx + 1 AS STRING) END AS h FROM {_HEADERS})"


_GRAMS = "CASE WHEN s = '' THEN [] WHEN len(s) <= 3 THEN [s] ELSE list_distinct(list_transform(range(1, len(s) - 1), lambda i: substr(s, i::INT, 3))) END"
_NODES = f"SELECT *, {_GRAMS} AS g, list_distinct(list_filter(string_split(s, ' '), lambda x: x <> '')) AS t FROM ({_slugs_sql()})"
_JACCARD = "CASE WHEN len(x.{c}) = 0 AND len(y.{c}) = 0 THEN 1.0 ELSE len(list_intersect(x.{c}, y.{c}))::DOUBLE / len(list_distinct(x.{c} || y.{c})) END"
_SCORE = f"0.5 * CASE WHEN x.s = y.s THEN 1.0 WHEN x.s = '' OR y.s = '' THEN 0.0 ELSE 1 - levenshtein(x.s, y.s)::DOUBLE / greatest(len(x.s), len(y.s)) END + 0.3 * {_JACCARD.format(c='g')} + 0.2 * {_JACCARD.format(c='t')}"


@query(f"SELECT * FROM (SELECT x.h AS a, y.h AS b, round({_SCORE}, 6) AS score FROM ({_NODES}) x, ({_NODES}) y WHERE x.h < y.h) WHERE score >= 0.72")
def header_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs whose score links them, found without comparing all pairs."""
    nodes = headers.header_nodes(_headers(spark))
    x, y = nodes.alias("x"), nodes.alias("y")
    side = lambda t: {k: F.col(f"{t}.{k}") for k in ("slug", "grams", "tokens")}
    pairs = headers.candidate_pairs(nodes).join(x, F.col("a") == F.col("x.header")).join(y, F.col("b") == F.col("y.header"))
    return pairs.select("a", "b", F.round(headers.similarity(side("x"), side("y")), 6).alias("score")).where("score >= 0.72")


@query(f"SELECT h AS header, s AS slug, replace(s, ' ', '') AS joined, translate(s, ' aeiouy', '') AS skeleton, len({_GRAMS})::INT AS grams FROM ({_slugs_sql()})")
def transliterate_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.header_nodes(_headers(spark)).select("header", "slug", "joined", "skeleton", F.size("grams").alias("grams"))


@query()
def header_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.header_clusters(_headers(spark)).withColumn("headers", F.array_join("headers", "|"))


_BUCKETS = ("date", "integer", "float", "text", "empty")
_MOST = "greatest(" + ", ".join(f"sum(n_{b})" for b in _BUCKETS) + ")"
_SUM = "(" + " + ".join(f"sum(n_{b})" for b in _BUCKETS) + ")"


@query(
    f"SELECT lower(trim(raw)) AS name, round(least(1.0, greatest(0.35, 0.35 + 0.4 * {_MOST}::DOUBLE / {_SUM} + 0.25 * least(1.0, count(DISTINCT (file_id, idx)) / 4.0))), 2) AS confidence, "
    f"arg_max(raw, (n, len(raw) = strlen(raw), -len(raw), -ord)) AS canonical_name FROM (SELECT *, count(*) OVER (PARTITION BY raw) AS n FROM {_HEADERS}) GROUP BY lower(trim(raw))"
)
def cluster_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _headers(spark)
    counted = rows.join(rows.groupBy("raw").agg(F.count(F.lit(1)).alias("n")), "raw")
    total = [F.sum(f"n_{b}") for b in _BUCKETS]
    purity = F.greatest(*total) / sum(total, F.lit(0))
    plain = (F.char_length("raw") == F.octet_length("raw")).cast("int")
    return counted.groupBy(F.lower(S.strip(F.col("raw"))).alias("name")).agg(
        headers.confidence(purity, F.count_distinct("file_id", "idx")).alias("confidence"), F.max_by("raw", F.struct("n", plain, -F.char_length("raw"), -F.col("ord"))).alias("canonical_name")
    )


@query(f"SELECT lower(trim(canonical_name)) AS canonical_name, string_agg(raw, '|' ORDER BY raw) AS headers, 1.0::DOUBLE AS confidence, false AS needs_review FROM (SELECT DISTINCT raw AS canonical_name, raw FROM {_HEADERS}) GROUP BY 1")
def merge_clusters_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _headers(spark).select(F.col("raw").alias("canonical_name"), F.array("raw").alias("headers")).distinct()
    return headers.merge_by_name(one).withColumn("headers", F.array_join("headers", "|"))


@query(f"SELECT lower(raw) AS raw_header, {', '.join(f'sum(n_{b})::BIGINT AS n_{b}' for b in _BUCKETS)} FROM {_HEADERS} GROUP BY 1")
def header_type_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headers.type_profiles(_headers(spark).withColumn("raw_header", F.lower("raw")))


_TARGET = f"SELECT raw, arg_max(idx, n * 1000 - f) AS target_index FROM (SELECT lower(raw) AS raw, idx, count(*) AS n, min(ord) AS f FROM {_HEADERS} GROUP BY 1, 2) GROUP BY raw"


@query(
    f"SELECT file_id, idx AS source_index, lower(h.raw) AS canonical_name, target_index, CASE WHEN idx <> target_index THEN idx - target_index END AS offset_from_index, "
    f"CASE WHEN idx <> target_index THEN 'auto-detected' END AS offset_reason, CASE WHEN idx <> target_index THEN 1.0::DOUBLE END AS offset_confidence FROM {_HEADERS} JOIN ({_TARGET}) t ON lower(h.raw) = t.raw"
)
def offset_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offsets.detect_offsets(_headers(spark).withColumn("canonical_name", F.lower("raw")))


_SHARE = " + ".join(f"abs(x.n_{b}::DOUBLE / x.total - y.n_{b}::DOUBLE / y.total)" for b in _BUCKETS)
_SEEN = " + ".join(f"(x.n_{b} > 0 OR y.n_{b} > 0)::INT" for b in _BUCKETS)
_TOTALS = f"SELECT *, {' + '.join(f'n_{b}' for b in _BUCKETS)} AS total FROM {_HEADERS}"


@query(f"SELECT x.ord, round(greatest(0, 1 - ({_SHARE}) / ({_SEEN})), 2) AS confidence FROM ({_TOTALS}) x JOIN ({_TOTALS}) y ON y.ord = x.ord + 1")
def type_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = _headers(spark).alias("x"), _headers(spark).alias("y")
    side = lambda t: {b: F.col(f"{t}.n_{b}") for b in _BUCKETS}
    return x.join(y, F.col("y.ord") == F.col("x.ord") + 1).select(F.col("x.ord").alias("ord"), offsets.type_confidence(side("x"), side("y")).alias("confidence"))


@query("SELECT p_type AS name, regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g') AS compact, regexp_replace(replace(lower(trim(p_type)), ' ', '_'), '[^a-z0-9_]', '', 'g') AS snake, "
       "trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS unicode, regexp_replace(lower(p_type), '[^a-z0-9_-]', '_', 'g') || '.csv' AS file, count(*) AS n FROM part GROUP BY p_type")  # fmt: skip
def slug_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("name")
    names = _t(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return names.select("name", S.compact_slug(v).alias("compact"), S.snake_slug(v).alias("snake"), S.unicode_slug(v).alias("unicode"), S.output_name(v).alias("file"), "n")


_SYNONYMS = {"customer_id": ["cust_id", "client_id", "klient_id", "customerid"], "order_total": ["total", "amount", "summa", "Order Total"], "order_date": ["date", "datum", "orderdate"], "store_id": ["shop_id", "mag_id"]}
_LOOKUP = "(VALUES " + ", ".join(f"('{''.join(c for c in v.lower() if c.isalnum())}', '{k}')" for k, vs in _SYNONYMS.items() for v in dict.fromkeys([k, *vs])) + ") AS l(key, name)"


@query(f"SELECT DISTINCT raw, coalesce(name, CASE WHEN s = '' THEN 'column' ELSE s END) AS normalized FROM (SELECT raw, regexp_replace(replace(lower(trim(raw)), ' ', '_'), '[^a-z0-9_]', '', 'g') AS s, regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') AS k FROM {_HEADERS}) LEFT JOIN (SELECT DISTINCT * FROM {_LOOKUP}) ON key = k AND k <> ''")
def synonym_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tatterloom.operators.schemas import Synonyms

    return _headers(spark).select("raw").distinct().select("raw", Synonyms.of(_SYNONYMS).normalized(F.col("raw")).alias("normalized"))


_PART = [("p_name", "p_name"), ("p_brand", "p_brand"), ("p_size", "CAST(p_size AS STRING)"), ("price", "replace(CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS STRING), '.', ',')"), ("flag", "CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE '0' END"), ("day", "'2024/0' || CAST(1 + p_size % 9 AS STRING) || '/11'"), ("none", "''")]
_PART_SQL = " UNION ALL ".join(f"SELECT '{h}' AS header, {e} AS v FROM part" for h, e in _PART)
_FLAGS = "SELECT header, bool_and(trim(v) = '' OR try_cast(replace(trim(v), ',', '.') AS DOUBLE) IS NOT NULL) AS maybe_numeric, bool_and(trim(v) = '' OR regexp_matches(v, '[-/.]')) AS maybe_date, bool_and(trim(v) = '' OR lower(trim(v)) IN ('true', 'false', '0', '1', 'yes', 'no')) AS maybe_bool"


@query(f"SELECT *, CASE WHEN maybe_bool THEN 'bool' WHEN maybe_numeric AND NOT maybe_date THEN 'decimal' WHEN maybe_date AND NOT maybe_numeric THEN 'date' ELSE 'string' END AS data_type FROM ({_FLAGS} FROM ({_PART_SQL}) GROUP BY header)")
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = profile.stack_columns(_t(spark, sf_dir, "part"), [h for h, _ in _PART], {h: F.expr(e) for h, e in _PART})
    v = F.col("value")
    blank = S.strip(v) == ""
    flags = cells.groupBy("header").agg(F.bool_and(blank | S.looks_numeric(v)).alias("maybe_numeric"), F.bool_and(blank | S.looks_date(v)).alias("maybe_date"), F.bool_and(blank | S.looks_bool(v)).alias("maybe_bool"))
    return flags.withColumn("data_type", S.inferred_type(F.col("maybe_numeric"), F.col("maybe_date"), F.col("maybe_bool"), F.lit(True)))


_KIND_OF = "CASE WHEN maybe_bool THEN 'bool' WHEN maybe_numeric AND NOT maybe_date THEN 'decimal' WHEN maybe_date AND NOT maybe_numeric THEN 'date' ELSE 'string' END"


@query(
    _PLAN + f""", own AS (SELECT file_id, block_id, end_line, greatest(start_line, coalesce(max(end_line) OVER (PARTITION BY file_id ORDER BY start_line, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 0)) AS own_start FROM plan),
s AS (SELECT c.file_id, block_id, line_no - own_start AS ord, cells FROM ({CELLS}) AS c JOIN own ON own.file_id = c.file_id AND line_no BETWEEN own_start AND least(end_line, own_start + {sampling.SIGNATURE_LINES - 1})),
p AS (SELECT file_id, block_id, ord, generate_subscripts(cells, 1) - 1 AS idx, trim(unnest(cells)) AS v FROM s),
d AS (SELECT file_id, block_id, idx, string_agg(v, '|' ORDER BY o) AS samples FROM (SELECT file_id, block_id, idx, v, min(ord) AS o FROM p WHERE v <> '' GROUP BY ALL) GROUP BY ALL),
t AS (SELECT file_id, block_id, idx, count(*) AS sample_count, {', '.join(f"count(*) FILTER (kind = '{b}') AS n_{b}" for b in _BUCKETS)}, {_FLAGS.removeprefix("SELECT header, ")} FROM (SELECT *, {_kind('v')} AS kind FROM p) GROUP BY file_id, block_id, idx)
SELECT t.* REPLACE (t.idx::INT AS idx), {_KIND_OF} AS data_type, coalesce(samples, '') AS samples FROM t LEFT JOIN d USING (file_id, block_id, idx)"""
)
def signature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signatures of every planned block, from the lines that are its own."""
    _, columns = sampling.signatures(sampling.sampled_lines(_lines(spark, sf_dir), _plan(spark, sf_dir)), sampling.SIGNATURE_LINES)
    return columns.withColumn("samples", F.coalesce(F.array_join("samples", "|"), F.lit("")))


@query(
    f"WITH c AS (SELECT file_id, line_no, cells FROM ({CELLS})), i AS (SELECT file_id, unnest(range(0, 6))::INT AS idx FROM (SELECT DISTINCT file_id FROM c)), f AS (SELECT file_id, 5 AS idx, min(line_no) AS since FROM c WHERE len(cells) > 5 GROUP BY file_id), "
    f"v AS (SELECT i.file_id, i.idx, coalesce(c.cells[i.idx + 1], '') AS value FROM i JOIN c USING (file_id) LEFT JOIN f ON f.file_id = i.file_id AND f.idx = i.idx WHERE i.idx < 5 OR c.line_no >= since) "
    f"SELECT file_id, idx, CASE WHEN idx < 5 THEN 'h' || CAST(idx AS STRING) ELSE 'column_6' END AS header, {_PROFILE.replace('AS unique_estimate', 'AS exact')} FROM (SELECT *, {_kind('value')} AS kind FROM v) GROUP BY file_id, idx"
)
def profile_ragged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cells(spark, sf_dir)
    names = rows.select("file_id").distinct().withColumn("headers", F.array(*[F.lit(f"h{k}") for k in range(5)]))
    return profile.profile_rows(rows, names, exact=True).withColumn("exact", F.col("unique_estimate")).drop("unique_estimate")


# Contracts, targets, schemas

_CONTRACTS = [("retail", "orders", "2"), ("retail", "stock", "1"), ("default", "people", "3"), ("lab", "orders", "9"), ("lab", "runs", "4")]
_SCHEMAS = [("s1", "orders", None, "retail"), ("s2", "x", "stock", "retail"), ("s3", "people", None, None), ("s4", "runs", None, "retail"), ("s5", "none", "none", "lab"), ("s6", "stock", "orders", "lab"), ("s7", "y", "people", "lab")]


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows) + ")"


@query(
    f"WITH c AS (SELECT * FROM {_values(_CONTRACTS)} AS c(ns, id, version)), s AS (SELECT * FROM {_values(_SCHEMAS)} AS s(schema_id, name, contract_id, namespace)) "
    "SELECT schema_id, name, x.ns AS namespace, x.id AS contract_id, x.version FROM (SELECT s.schema_id, s.name, coalesce((SELECT c FROM c WHERE ns = coalesce(namespace, 'default') AND id = contract_id), "
    "(SELECT c FROM c WHERE ns = coalesce(namespace, 'default') AND id = name), (SELECT arg_min(c, ns) FROM c WHERE id = coalesce(contract_id, name))) AS x FROM s)"
)
def contract_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tatterloom.operators.schemas import bind_contracts

    known = spark.createDataFrame(_CONTRACTS, "namespace string, contract_id string, version string")
    return bind_contracts(spark.createDataFrame(_SCHEMAS, "schema_id string, name string, contract_id string, namespace string"), known)


_ENTRIES = [("a", 0, "Order ID", None), ("a", 1, "amount", None), ("a", 2, "when", None), ("a", 3, "kept", 7), ("b", 0, "??", None), ("b", 1, "order-id", None)]
_TARGETS = [(0, "order_id", "int"), (1, "total", "decimal"), (2, "day", "date"), (3, "Order Id", "string"), (4, "note", "string")]
_KINDS = [("a", 0, 9, 0, 0, 0), ("a", 1, 0, 5, 1, 0), ("a", 2, 0, 0, 0, 4), ("b", 0, 0, 0, 3, 1), ("b", 1, 1, 0, 0, 0)]


@query(
    f"WITH e AS (SELECT * FROM {_values(_ENTRIES)} AS e(file_id, source_index, canonical_name, target)), t AS (SELECT * FROM {_values(_TARGETS)} AS t(i, name, kind)), k AS (SELECT * FROM {_values(_KINDS)} AS k(f, j, n_integer, n_float, n_text, n_date)) "
    "SELECT file_id, source_index, canonical_name, coalesce(target, (SELECT min(i) FROM t WHERE trim(regexp_replace(lower(t.name), '[^a-z0-9]+', '_', 'g'), '_') = trim(regexp_replace(lower(canonical_name), '[^a-z0-9]+', '_', 'g'), '_')), "
    "(SELECT min(i) FROM t WHERE kind = CASE WHEN greatest(n_integer, n_float, n_text, n_date) = n_integer THEN 'int' WHEN greatest(n_integer, n_float, n_text, n_date) = n_float THEN 'decimal' WHEN greatest(n_integer, n_float, n_text, n_date) = n_text THEN 'string' ELSE 'date' END)) AS target_index "
    "FROM e LEFT JOIN k ON f = file_id AND j = source_index"
)
def resolve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark.createDataFrame(_ENTRIES, "file_id string, source_index int, canonical_name string, target_index int")
    columns = spark.createDataFrame(_TARGETS, "index int, name string, data_type string")
    kinds = spark.createDataFrame(_KINDS, "file_id string, idx int, n_integer long, n_float long, n_text long, n_date long")
    return offsets.resolve_targets(entries, columns, kinds)


@query(f"SELECT header, value, n FROM (SELECT *, row_number() OVER (PARTITION BY header ORDER BY n DESC, value) AS k FROM (SELECT header, value, count(*) AS n FROM ({_stacked_sql('events')}) GROUP BY ALL)) WHERE k <= 3")
def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.top_values(_stacked(spark, sf_dir, "events"), ["header"], 3)


@query()
def schema_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas of the ragged orders' lines taken as headers: those of one width whose texts are alike."""
    from tatterloom.operators.schemas import Synonyms, cluster_blocks

    lines = _t(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS BIGINT) AS ord", f"{LINE} AS raw").where("raw <> ''")
    found = lines.select("ord", F.lit(",").alias("delimiter"), F.size(S.split_line(F.col("raw"), ",")).alias("column_count"), F.regexp_replace("raw", r"\d+", "id").alias("header_sample"))
    return cluster_blocks(found, Synonyms.of({})).groupBy("schema_ord").agg(F.count(F.lit(1)).alias("blocks"))
