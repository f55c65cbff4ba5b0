"""Blocks as intervals of lines: disjoint owners, line joins, plan roll-ups, chunk numbers, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tatterloom.operators.durable import durable, small

_RANGE = 12  # bits: intervals meet lines by ranges of 4,096 lines


def compacted(blocks: DataFrame) -> DataFrame:
    """Disjoint (file_id, start_line, end_line, schema_id, block_id) that cover what blocks (…, schema_ord) cover.

    Blocks overlap heavily; a line belongs to the block with the least (schema_ord, start_line, block_id). Blocks are
    few beside lines; each elementary interval between their bounds takes its owner, and neighbours with one owner merge.
    """
    bounds = blocks.select("file_id", F.explode(F.array("start_line", F.col("end_line") + 1)).alias("lo")).distinct()
    order = Window.partitionBy("file_id").orderBy("lo")
    parts = bounds.withColumn("hi", F.lead("lo").over(order) - 1).where("hi is not null")
    owner = F.min_by(F.struct("schema_id", "block_id"), F.struct("schema_ord", "start_line", "block_id")).alias("o")
    placed = parts.withColumn("_range", F.shiftright("lo", _RANGE))  # a block that covers an interval has a range with its first line
    owned = placed.join(_ranged(blocks), ["file_id", "_range"]).where("start_line <= lo and hi <= end_line").groupBy("file_id", "lo", "hi").agg(owner)
    owned = owned.select("file_id", "lo", "hi", "o.*")
    before = F.lag(F.struct("schema_id", "block_id", "hi")).over(order)
    new = F.when((before["schema_id"] == F.col("schema_id")) & (before["block_id"] == F.col("block_id")) & (before["hi"] + 1 == F.col("lo")), 0).otherwise(1)
    runs = owned.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("file_id", "run", "schema_id", "block_id").agg(F.min("lo").alias("start_line"), F.max("hi").alias("end_line")).drop("run")


def _ranged(intervals: DataFrame) -> DataFrame:
    """Intervals, once per range of lines that they have a line in."""
    return intervals.withColumn("_range", F.explode(F.sequence(F.shiftright("start_line", _RANGE), F.shiftright("end_line", _RANGE))))


def covered_lines(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """lines (file_id, line_no, …) with each block that covers them; a line meets only the blocks of its range."""
    placed = lines.withColumn("_range", F.shiftright("line_no", _RANGE))
    return placed.join(small(durable(_ranged(blocks))), ["file_id", "_range"]).where("line_no between start_line and end_line").drop("_range")


def assigned_lines(lines: DataFrame, intervals: DataFrame) -> DataFrame:
    """lines (file_id, line_no, …) with their block.

    Disjoint intervals are cut into ranges of lines, so the join is an equality on file and range.
    """
    return covered_lines(lines, intervals)


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per keys, the first in order; partial aggregation, so a common key isn't gathered."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def without_headers(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """lines without the first of each file that equals its header text (file_id, header)."""
    headers = small(headers)
    h = lines.join(headers, "file_id").where(F.trim("raw") == F.trim("header")).groupBy("file_id").agg(F.min("line_no").alias("header_line"))
    return lines.join(small(durable(h)), "file_id", "left").where("header_line is null or line_no <> header_line").drop("header_line")


def plan_rollup(blocks: DataFrame, schemas: DataFrame) -> DataFrame:
    """(schema_id, schema_name, block_count, estimated_rows, files) of blocks with a schema; a schema without a name goes by its id."""
    named = blocks.where("schema_id is not null").join(schemas.select("schema_id", "name"), "schema_id", "left")
    return named.groupBy("schema_id").agg(
        F.first(F.coalesce("name", F.col("schema_id").cast("string"))).alias("schema_name"), F.count(F.lit(1)).alias("block_count"),
        F.sum(F.col("end_line") - F.col("start_line") + 1).cast("long").alias("estimated_rows"), F.array_sort(F.collect_set("file_id")).alias("files"),
    )


def chunked(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """rows with chunk_index and row_in_chunk, numbered in order without gathering them in one task.

    Rows are dealt out by ranges of their order and numbered within a range; the ranges' counts, a row each, give
    what stands before.
    """
    dealt = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()))
    own = F.col("_seq").bitwiseAND((1 << 33) - 1)
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    numbered = dealt.join(F.broadcast(before), "_part").withColumn("_k", own + F.coalesce("_before", F.lit(0)))
    return numbered.withColumns({"chunk_index": F.floor(F.col("_k") / size).cast("long"), "row_in_chunk": (F.col("_k") % size).cast("long")}).drop("_part", "_seq", "_n", "_before", "_k")


def newest(events: DataFrame, key: str, order: list[Column], most: int = 500) -> DataFrame:
    """The newest `most` events per key, none if most is 0 or less: a limit that is the feature."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return events.where(F.lit(False)) if most <= 0 else events.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def latest(events: DataFrame, key: str, order: Column, first: str) -> DataFrame:
    """The last event per key, with the first value of a column kept as created_at."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"), F.min(first).alias("created_at"), F.count(F.lit(1)).alias("events")).select(key, "created_at", "events", *[F.col(f"r.{c}").alias(c) for c in rest if c != "created_at"])


def moving_average(rows: DataFrame, value: str, order: str, by: str, width: int = 8) -> DataFrame:
    """rows with the mean of the last `width` values per group."""
    return rows.withColumn("moving_avg", F.avg(value).over(Window.partitionBy(by).orderBy(order).rowsBetween(1 - width, 0)))
