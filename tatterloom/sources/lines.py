"""Lines of delimited text files: enumeration, encoding, numbering, counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tatterloom.operators.durable import durable, small

EXTENSIONS = ("csv", "tsv", "txt")
FALLBACK = "windows-1251"


def counted_lines(text: Column) -> Column:
    """Line feeds, and one more line if the last isn't ended; 0 for an empty text."""
    feeds = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(feeds + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("long")


def _glob() -> str:
    return "*.{" + ",".join(f"{e},{e.upper()}" for e in EXTENSIONS) + "}"


def input_files(spark: SparkSession, targets: Iterable[str]) -> list[str]:
    """The distinct files of some targets in order: a folder's files with known extensions, sorted, at any depth; a file whatever its extension."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found: dict[str, None] = {}
    for target in targets:
        path = jvm.org.apache.hadoop.fs.Path(target)
        fs = path.getFileSystem(conf)
        if fs.getFileStatus(path).isFile():
            found[target] = None
            continue
        files = fs.listFiles(path, True)
        inside = []
        while files.hasNext():
            name = files.next().getPath().toString()
            if name.rpartition(".")[2].lower() in EXTENSIONS:
                inside.append(name)
        found |= dict.fromkeys(sorted(inside))
    return list(found)


def raw_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_id, line_no, raw): every line of some files or folders, numbered from 0 within its file.

    The files are read in splits, as many tasks as their size asks for. Lines are counted per split, a row each; a line's
    number is its place in its split plus the counts of the splits before. Bytes are split at line feeds. A file whose
    lines aren't all UTF-8 is read as the fallback encoding, all of it.
    """
    text = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    if len(paths) == 1 and not paths[0].rpartition("/")[2].count("."):
        text = text.option("pathGlobFilter", _glob())
    read = text.text(paths)
    placed = read.select(F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("bytes"))
    placed = durable(placed)
    stats = placed.groupBy("file_id", "split").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"), F.bool_and(F.is_valid_utf8(F.col("bytes").cast("string"))).alias("utf8"))
    order = Window.partitionBy("file_id").orderBy("split")
    stats = stats.withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    stats = stats.withColumn("utf8", F.min("utf8").over(Window.partitionBy("file_id")))
    numbered = placed.join(small(durable(stats.select("file_id", "split", "first", "before", "utf8"))), ["file_id", "split"])
    raw = F.when(F.col("utf8"), F.col("bytes").cast("string")).otherwise(decoded(F.col("bytes")))
    return numbered.select("file_id", (F.col("seq") - F.col("first") + F.col("before")).alias("line_no"), raw.alias("raw"))


def decoded(data: Column) -> Column:
    """Bytes in the fallback encoding (windows-1251): its upper half by a table, as Spark's own decoders lack it."""
    codes = bytes(range(128, 256)).decode("cp1251", "replace")
    return F.translate(F.decode(data, "ISO-8859-1"), "".join(map(chr, range(128, 256))), codes)


def file_lines(lines: DataFrame) -> DataFrame:
    """(file_id, total_lines) of numbered lines."""
    return lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("total_lines"))


def quoted_cells(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """(cells): rows of a quoted CSV file, quotes and line feeds within them honoured; rows without any cell are left out."""
    df = spark.read.option("sep", delimiter).option("header", False).option("quote", '"').option("escape", '"').option("multiLine", True).option("mode", "PERMISSIVE").csv(path)
    return df.select(F.array(*[F.coalesce(c, F.lit("")) for c in df.columns]).alias("cells"))
