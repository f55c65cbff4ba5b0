"""Files that keep arriving: each batch of new files is split, aligned, validated and appended once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tatterloom.functions.scalars import split_line, strip
from tatterloom.operators import align


def arriving_lines(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """(file_id, raw) of files as they come."""
    stream = spark.readStream.option("maxFilesPerTrigger", most_files).option("lineSep", "\n").text(folder)
    return stream.select(F.col("_metadata.file_path").alias("file_id"), F.col("value").alias("raw"))


def ingest(spark: SparkSession, folder: str, dest: str, checkpoints: str, names: list[str], specs: list[align.Spec], delimiter: str = ",", header: str | None = None) -> StreamingQuery:
    """Appends the fitted rows of new files to dest as Parquet with their validation counts, then stops when all are read.

    Spark's own log makes each file count once, also after a restart. Lines equal to the header are left out.
    """
    lines = arriving_lines(spark, folder).where(strip(F.col("raw")) != "")
    lines = lines.where(strip(F.col("raw")) != header) if header else lines
    cells = lines.select("file_id", F.transform(split_line(F.col("raw"), delimiter), strip).alias("cells")).withColumn("observed", F.size("cells"))
    rows = align.validated(cells, len(names), specs)
    table = rows.select("file_id", *[F.get("cells", k).alias(n) for k, n in enumerate(names)], "is_short", "is_long", "n_missing", "n_mismatch")
    return table.writeStream.format("parquet").option("path", dest).option("checkpointLocation", checkpoints).trigger(availableNow=True).start()
