"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

The text is read once, for a narrow table of digests, dealt by a prefix of the digest into slices of at most
SLICE_ROWS rows on average, so that each slice's filter has CELLS_PER_ROW cells a row at any size of the input. Pass 1
counts the cells of a slice's filter (two cells a row) and keeps, as bitmaps of 32,768 cells, those that were hit
twice: a row whose text occurs again has both cells among them. Partial filters travel as the counters of the cells
they touch, combined on the map side; a dense partial filter from each task would be larger once there are over half a
dozen tasks. Pass 2 probes the slice's bitmaps, which are broadcast: at most MAX_CELLS / 8 bytes. Rows with a cell that
was hit once go straight to the result; only the others shuffle, as digests, and are grouped by SHA-256.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tatterloom.llm.common import ascii_lower, bit_of, keep_rows, row_key, shared_dir, spread, stored, whole, with_groups, written

CELLS_PER_ROW = 16
MIN_CELLS, MAX_CELLS = 1 << 16, 1 << 30
SLICE_ROWS = MAX_CELLS // CELLS_PER_ROW
_BUCKET = 15  # bits of a cell's place in its bitmap, as in bitmap_construct_agg


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of a stored table: its id and place, and the SHA-256 of the normalised text."""
    rows = spread(docs.select(*row_key(docs, id_col), whole(text_col).alias("_text")))
    return rows.select("_row_id", "file", "row", F.unhex(F.sha2(ascii_lower(F.col("_text")), 256)).alias("sha"))


def _cell(salt: int, cells: int) -> Column:
    return F.pmod(F.xxhash64("sha", F.lit(salt)), F.lit(cells))


def repeated_cells(rows: DataFrame, cells: int) -> DataFrame:
    """Pass 1: (bucket, bits), the bitmaps of the cells that were hit at least twice."""
    hit = rows.select(F.explode(F.array(_cell(0, cells), _cell(1, cells))).alias("cell"))
    twice = hit.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    place = F.col("cell").bitwiseAND((1 << _BUCKET) - 1)
    return twice.groupBy(F.shiftright("cell", _BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"))


def _probe(rows: DataFrame, bitmaps: DataFrame, cells: int) -> DataFrame:
    """Pass 2: rows with `maybe`, false only if the text surely occurs once."""
    for salt in (0, 1):
        rows = rows.withColumn(f"c{salt}", _cell(salt, cells)).withColumn("bucket", F.shiftright(f"c{salt}", _BUCKET))
        rows = rows.join(F.broadcast(bitmaps), "bucket", "left")
        rows = rows.withColumn(f"m{salt}", bit_of(F.col("bits"), F.col(f"c{salt}").bitwiseAND((1 << _BUCKET) - 1))).drop("bucket", "bits", f"c{salt}")
    return rows.withColumn("maybe", F.col("m0") & F.col("m1")).drop("m0", "m1")


def _slice_decisions(rows: DataFrame, n: int) -> DataFrame:
    """Decisions on the rows of one slice, n of them."""
    cells = min(MAX_CELLS, max(MIN_CELLS, 1 << (CELLS_PER_ROW * max(1, n) - 1).bit_length()))
    probed = _probe(rows, written(repeated_cells(rows, cells), "bitmaps"), cells)
    maybe = probed.where("maybe").drop("maybe")
    groups = maybe.groupBy("sha").agg(F.max(F.struct("_row_id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    again = with_groups(maybe, written(groups.where("group_size > 1"), "groups"), "sha", "group_size")
    found = again.select(
        "_row_id", "file", "row", "sha",
        F.when(F.col("keep").isNull(), F.col("_row_id")).otherwise(F.col("keep._row_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce((F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row")), F.lit(True)).alias("kept"),
    )
    alone = probed.where(~F.col("maybe")).select("_row_id", "file", "row", "sha", F.col("_row_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return alone.unionByName(found)


def duplicate_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of a stored table: _row_id, file, row, sha, keep_id, group_size, kept.

    Texts are equal if identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest id stays; among rows that repeat id and text, one. A null id is less than any other. An empty table
    gives an empty result; other columns of docs are not read.
    """
    docs = stored(docs)
    spark, n = docs.sparkSession, docs.count()
    slices = -(-n // SLICE_ROWS)
    if slices <= 1:
        return _slice_decisions(written(digests(docs, id_col, text_col), "digests"), n)
    path, of = shared_dir(spark, "digests"), F.pmod(F.xxhash64("sha", F.lit(2)), F.lit(slices)).cast("int")
    digests(docs, id_col, text_col).withColumn("slice", of).write.partitionBy("slice").parquet(path)
    rows, out = spark.read.parquet(path), None
    for k in range(slices):  # one after the other, so that one filter at a time is broadcast
        found = written(_slice_decisions(rows.where(F.col("slice") == k).drop("slice"), SLICE_ROWS), "slice")
        out = found if out is None else out.unionByName(found)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; see duplicate_decisions."""
    docs = stored(docs)
    return keep_rows(docs, written(duplicate_decisions(docs, id_col, text_col).select("file", "row", "kept"), "decisions"))
