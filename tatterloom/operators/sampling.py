"""Block plans and block signatures: where a file is sampled, and what the samples say about its shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tatterloom.functions.scalars import BUCKETS, classify, clean_cell, detect_delimiter, inferred_type, looks_bool, looks_date, looks_numeric, split_line, strip
from tatterloom.operators.durable import durable, small

SIGNATURE_LINES = 100
BUFFER_BYTES = 1 << 20
MOST_SPLITS = 40  # a gap halves with each; enough for 2**40 lines


def split_points(n: Column, gap: int) -> Column:
    """Line numbers 0 and n - 1, and midpoints between neighbours until none are over `gap` apart."""
    start = F.when(n <= 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.array(F.lit(0).cast("bigint"), (n - 1).cast("bigint"))))

    def halve(points: Column, _: Column) -> Column:
        def part(p: Column, i: Column) -> Column:
            right = F.get(points, i + 1)
            middle = p + F.floor((right - p) / 2).cast("bigint")
            return F.when(right - p > gap, F.array(p, middle)).otherwise(F.array(p))

        return F.flatten(F.transform(points, part))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_SPLITS)), start, halve)


def block_plan(files: DataFrame, block_size: int, min_gap: int) -> DataFrame:
    """(file_id, block_id, start_line, end_line) for files (file_id, total_lines); a range planned twice keeps its first id."""
    points = files.select("file_id", "total_lines", F.posexplode(split_points(F.col("total_lines"), min_gap)).alias("block_id", "at"))
    last = F.col("total_lines") - 1
    first = F.greatest(F.lit(0).cast("bigint"), F.col("at") - block_size // 2)
    end = F.least(last, first + block_size - 1)
    ranges = points.select("file_id", "block_id", end.alias("end_line"), F.greatest(F.lit(0).cast("bigint"), end - block_size + 1).alias("start_line"))
    return ranges.groupBy("file_id", "start_line", "end_line").agg(F.min("block_id").alias("block_id")).select("file_id", "block_id", "start_line", "end_line")


def sampled_lines(lines: DataFrame, plan: DataFrame, most: int = SIGNATURE_LINES) -> DataFrame:
    """(file_id, block_id, line_no, raw, ord): each block's first lines that no block before it takes.

    A block's own range starts after the end of the one before, so a line belongs to one block. Of a range only the
    first `most` lines count. Ranges are keyed by stretches of lines, at most two each, so there are a few rows per
    block to join and never one per line; they are counted before they are broadcast.
    """
    order = Window.partitionBy("file_id").orderBy("start_line", "block_id")
    own = plan.withColumn("own_start", F.greatest("start_line", F.coalesce(F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(0))))
    own = own.where("own_start <= end_line").withColumn("stop", F.least(F.col("end_line"), F.col("own_start") + most - 1))
    bits = most.bit_length()
    stretch = F.explode(F.sequence(F.shiftright("own_start", bits), F.shiftright("stop", bits))).alias("_stretch")
    wanted = durable(own.select("file_id", "block_id", "own_start", "stop", stretch))
    met = lines.withColumn("_stretch", F.shiftright("line_no", bits)).join(small(wanted), ["file_id", "_stretch"]).where("line_no between own_start and stop")
    return met.select("file_id", "block_id", "line_no", "raw", (F.col("line_no") - F.col("own_start")).cast("long").alias("ord"))


def signatures(sample: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """(blocks, columns) from sampled_lines().

    blocks: delimiter of the header line, its text, and the commonest width (of equals, that seen first).
    columns: up to `cap` distinct samples in order, counts by type, what all of them may be, and the type so inferred.
    """
    keys = ["file_id", "block_id"]
    sample = sample.select(*keys, "ord", "raw").repartition(*keys)  # all that follows is by block, so nothing moves again
    head = sample.groupBy(*keys).agg(F.min_by("raw", "ord").alias("header_sample")).withColumn("delimiter", detect_delimiter(F.col("header_sample")))
    first = F.first("raw").over(Window.partitionBy(*keys).orderBy("ord"))
    cells = sample.withColumn("_first", first).withColumn("cells", split_line(F.col("raw"), detect_delimiter(F.col("_first"))))
    widths = cells.groupBy(*keys, F.size("cells").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    mode = widths.groupBy(*keys).agg(F.max_by("width", F.struct("n", -F.col("first"))).alias("column_count"))
    parts = cells.select(*keys, "ord", F.posexplode("cells").alias("idx", "cell"))
    # equal cells of a column are counted first, and each distinct one is cleaned and classified once
    once = parts.groupBy(*keys, "idx", "cell").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("_times")).withColumn("value", clean_cell(F.col("cell")))
    v, blank, kind = F.col("value"), F.col("value") == "", F.col("_kind")
    once = once.withColumns({"_kind": classify(v), "_numeric": blank | looks_numeric(v), "_dated": blank | looks_date(v), "_bool": blank | looks_bool(v)})
    seen = F.array_sort(F.collect_list(F.when(~blank, F.struct("ord", "value"))))
    columns = once.groupBy(*keys, "idx").agg(
        F.sum("_times").alias("sample_count"), *[F.coalesce(F.sum(F.when(kind == b, F.col("_times"))), F.lit(0).cast("long")).alias(f"n_{b}") for b in BUCKETS],
        F.bool_and("_numeric").alias("maybe_numeric"), F.bool_and("_dated").alias("maybe_date"), F.bool_and("_bool").alias("maybe_bool"),
        F.slice(F.array_distinct(F.transform(seen, lambda s: s["value"])), 1, cap).alias("samples"),
    )
    columns = columns.withColumn("samples", F.when(F.size("samples") > 0, F.col("samples")))
    return head.join(mode, keys), columns.withColumn("data_type", inferred_type(F.col("maybe_numeric"), F.col("maybe_date"), F.col("maybe_bool"), F.col("sample_count") > 0))


def first_headers(lines: DataFrame) -> DataFrame:
    """(file_id, header_line, delimiter, headers): the first line of each file that isn't blank, split by its own delimiter."""
    first = lines.where(strip(F.col("raw")) != "").groupBy("file_id").agg(F.min_by("raw", "line_no").alias("raw")).withColumn("delimiter", detect_delimiter(F.col("raw")))
    return first.select("file_id", F.col("raw").alias("header_line"), "delimiter", F.transform(split_line(F.col("raw"), F.col("delimiter")), strip).alias("headers"))
