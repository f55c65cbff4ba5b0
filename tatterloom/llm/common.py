"""What the operators of this subpackage share: shared folders, written tables, row keys."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A table of at most so many narrow rows (two longs) may be broadcast: 64 MB at most as a hash table.
BROADCAST_ROWS = 500_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: At most so many hot groups are broadcast.
HOT = 100_000
SPREAD = 2 << 20
#: A bitmap holds so many rows of a file (the size of bitmap_construct_agg's), and a broadcast so many bitmaps: 32 MB.
BITMAP_ROWS, BITMAPS = 1 << 15, 1 << 13


def shared_root(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        if existing.isDefined():
            root = existing.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            own = tempfile.mkdtemp(prefix="tatterloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            root = Path(own).as_uri()
            spark.sparkContext.setCheckpointDir(root)
    return root if "://" in root or root.startswith("file:") else Path(root).as_uri()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI; it isn't made yet."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI, for use by Python workers."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: cuts its lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # what was shuffled for this table isn't read again
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_path = path
    return found


def trim() -> None:
    """Gives back what earlier tasks of this worker freed, which the allocators keep."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def discard(df: DataFrame) -> None:
    """Deletes what written() wrote, once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(conf).delete(path, True)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; texts of ASCII alone take the fast path, which is the same for them."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def whole(name: str) -> Column:
    """A text column without nulls."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of df's size: file sizes for a scan. For partition counts only."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 1 << 30


def _scans_files(docs: DataFrame) -> bool:
    """Whether docs is one scan of files, at most filtered and projected, so that a place in a file is one row."""
    lines = [line.lstrip(" :+-") for line in docs._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    return all(line.startswith(("Project", "Filter", "Relation")) for line in lines) and sum(line.startswith("Relation") for line in lines) == 1


def stored(docs: DataFrame) -> DataFrame:
    """docs, written first unless it is a scan of Parquet files already."""
    if _scans_files(docs):
        try:
            docs.select(*place(docs))
            return docs
        except AnalysisException:
            pass
    return written(docs, "documents")


def place(docs: DataFrame) -> list[Column]:
    """(file, row): where each row of a stored table is; no two rows share one."""
    at = docs.metadataColumn("_metadata")
    return [F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("row")]


def row_key(docs: DataFrame, id_col: str) -> list[Column]:
    """The id and the place of each row of a stored table."""
    return [F.col(id_col).alias("_row_id"), *place(docs)]


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt out to all cores if they come from files too small to be split: one row group is one task's.

    Below SPREAD bytes a core this shuffles some megabytes; above it files are read where they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if input_bytes(rows) < cores * SPREAD else rows


def bounded(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its count is proven small, else df for a shuffled join."""
    return F.broadcast(df) if df.limit((rows or BROADCAST_ROWS) + 1).count() <= (rows or BROADCAST_ROWS) else df


def with_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, how: str = "left") -> DataFrame:
    """rows joined (left or inner) with groups (key, size, ...; a row per key, a written table) so that no hot key is one task's.

    Groups of over a HOT-th of all their rows are at most HOT, so they are broadcast and their rows never shuffle;
    the rows of the others do, and AQE splits what is skewed among them.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = groups.where(F.col(size) > total // HOT)
    rest = groups.where(F.col(size) <= total // HOT)
    if rest.isEmpty():
        return rows.join(F.broadcast(hot), key, how)
    keys = [key] if isinstance(key, str) else key
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(*keys)), key, "left_anti").join(rest, key, how))


def bit_of(bits: Column, at: Column) -> Column:
    """Whether a bitmap of bitmap_construct_agg has a place's bit; false for a null bitmap."""
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1, F.lit(False))


def by_bitmaps(rows: DataFrame, places: DataFrame, stay: bool) -> DataFrame:
    """The rows (file, row, ...) whose place is (stay) or isn't (not stay) among places (file, row).

    Places become bitmaps of a file's rows, and the bitmaps are broadcast, at most BITMAPS of them at a time on
    average, to the rows of the files that they are of. So rows are never shuffled, however many places there are.
    """
    bitmaps = places.groupBy("file", F.shiftright("row", 15).alias("_block")).agg(F.bitmap_construct_agg(F.col("row").bitwiseAND(BITMAP_ROWS - 1)).alias("_bits"))
    bitmaps = written(bitmaps, "bitmaps")
    groups = 2 * (bitmaps.count() // BITMAPS) or 1
    share, out = F.pmod(F.xxhash64("file"), F.lit(groups)), None
    hit = bit_of(F.col("_bits"), F.col("row").bitwiseAND(BITMAP_ROWS - 1))
    for k in range(groups):  # files are dealt into groups by hash
        some = rows.where(share == k) if groups > 1 else rows
        met = some.withColumn("_block", F.shiftright("row", 15)).join(F.broadcast(bitmaps.where(share == k) if groups > 1 else bitmaps), ["file", "_block"], "inner" if stay else "left")
        met = met.where(hit if stay else ~hit).select(rows.columns)
        out = met if out is None else out.unionByName(met)
    return out


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """The rows of a stored table that decisions (file, row, kept; a row per row of docs) keeps; no text is shuffled."""
    names = [f"_own{k}" for k in range(len(docs.columns))]
    own = [F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in zip(docs.columns, names, strict=True)]
    stay = by_bitmaps(docs.select(*own, *place(docs)), decisions.where(~F.col("kept")).select("file", "row"), False)
    return stay.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])
