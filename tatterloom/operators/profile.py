"""Column profiles of ragged rows: type buckets, blanks, distinct values, number and date ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tatterloom.functions.scalars import kind_of, strip, to_iso_date, to_number
from tatterloom.operators.durable import durable, small

#: The accuracy of a sketch of 1,024 registers.
DISTINCT_ERROR = 0.035


def stack_columns(df: DataFrame, columns: list[str] | None = None, casts: dict[str, Column] | None = None) -> DataFrame:
    """(idx, header, value): a structured table's cells as strings, from one scan of the named columns."""
    cells = [F.struct(F.lit(i).alias("idx"), F.lit(c).alias("header"), (casts or {}).get(c, F.col(c)).cast("string").alias("value")) for i, c in enumerate(columns or df.columns)]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def distinct_values(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(header, value): each column's distinct values as strings, null too.

    Distinct values are found by columns in their own types and only those that are left become strings, so that no
    row per cell is made. Of types whose different values have different strings; others are made strings first.
    """
    out = None
    for header, column in columns.items():
        one = df.select(column.alias("value"))
        if not isinstance(one.schema["value"].dataType, (T.IntegralType, T.DecimalType, T.DateType, T.StringType)):
            one = one.select(F.col("value").cast("string").alias("value"))
        one = one.distinct().select(F.lit(header).alias("header"), F.col("value").cast("string").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def prepared(cells: DataFrame) -> DataFrame:
    """cells (…, value) with what the measures need, each found once: the stripped cell, its bucket, number and date."""
    kind = F.col("_kind")
    found = cells.withColumn("_cell", strip(F.col("value"))).withColumn("_kind", kind_of(F.col("_cell")))
    return found.withColumns({"_number": F.when(kind.isin("integer", "float"), to_number(F.col("_cell"))), "_date": F.when(kind == "date", to_iso_date(F.col("_cell")))})


def measures(times: Column | None = None) -> list[Column]:
    """The aggregates over prepared() cells; partial aggregation leaves a row per column and task to shuffle.

    With `times`, the cells are counted() ones, each of which stands for so many equal ones: distinct counts are exact.
    """
    kind = F.col("_kind")
    some = F.when(kind != "empty", F.col("_cell"))
    if times is None:
        count = lambda cond: F.count_if(cond)
    else:
        count = lambda cond: F.coalesce(F.sum(F.when(cond, times)), F.lit(0)).cast("long")
    return [
        *[count(kind == k).alias(f"n_{k}") for k in ("integer", "float", "text", "date")], count(kind == "empty").alias("n_null"),
        count(F.lit(True)).alias("total_values"), (F.approx_count_distinct(some, DISTINCT_ERROR) if times is None else F.count(some)).alias("unique_estimate"),
        F.min("_number").alias("numeric_min"), F.max("_number").alias("numeric_max"), F.min("_date").alias("date_min"), F.max("_date").alias("date_max"),
    ]


def counted(cells: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """(…keys, value, _times, …): a row per distinct stripped cell of each key, so that it is classified once and no distinct count follows."""
    return cells.withColumn("value", strip(F.col("value"))).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_times"), *more)


def profile_cells(cells: DataFrame, keys: list[str], exact: bool = False) -> DataFrame:
    """Profiles of cells (…keys, value).

    Exact distinct counts need a shuffle of distinct values anyway, so equal values are counted first and each distinct
    one is classified once. Estimates need none, and a column of distinct values would gain nothing by it.
    """
    if not exact:
        return prepared(cells).groupBy(*keys).agg(*measures())
    return prepared(counted(cells, keys)).groupBy(*keys).agg(*measures(F.col("_times")))


def profile_rows(rows: DataFrame, headers: DataFrame, exact: bool = False) -> DataFrame:
    """Profiles (file_id, idx, header, …) of rows (file_id, line_no, cells) under headers (file_id, headers).

    A row that is too short has blanks for the columns that its header names. A column beyond the header counts from
    the first row that reaches it, and is then blank wherever a row is too short. Empty rows (no cell) don't count.
    Header columns that no row reaches are there with zeros or blanks. What is found, a row per column, is kept, so
    that cells are taken apart once and the rows don't shuffle to learn from which one a column counts. With `exact`,
    distinct counts are exact.
    """
    rows = rows.where(F.size("cells") > 0)
    cells = rows.select("file_id", "line_no", F.posexplode("cells").alias("idx", "value"))
    keys = ["file_id", "idx"]
    if exact:
        found = prepared(counted(cells, keys, F.min("line_no").alias("line_no"))).groupBy(*keys).agg(*measures(F.col("_times")), F.min("line_no").alias("first_line"))
    else:
        found = prepared(cells).groupBy(*keys).agg(*measures(), F.min("line_no").alias("first_line"))
    found = durable(found)
    totals = found.where("idx = 0").select("file_id", F.col("total_values").alias("rows"))  # every row has a first cell
    named = headers.select("file_id", F.posexplode("headers").alias("idx", "name"))
    late = found.join(headers.select("file_id", F.size("headers").alias("named")), "file_id").where("idx >= named").select("file_id", "idx", "first_line")
    late = small(durable(late))
    since = rows.select("file_id", "line_no").join(late, "file_id").where("line_no >= first_line").groupBy("file_id", "idx").agg(F.count(F.lit(1)).alias("since"))
    joined = found.join(named, ["file_id", "idx"], "full").join(totals, "file_id", "left").join(since, ["file_id", "idx"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    total = F.coalesce("since", "rows", F.lit(0).cast("long"))
    header = F.coalesce(F.when(strip(F.col("name")) != "", strip(F.col("name"))), F.concat(F.lit("column_"), (F.col("idx") + 1).cast("string")))
    return joined.select(
        "file_id", "idx", header.alias("header"), *[zero(f"n_{k}").alias(f"n_{k}") for k in ("integer", "float", "text", "date")],
        (zero("n_null") + total - zero("total_values")).alias("n_null"), total.alias("total_values"), zero("unique_estimate").alias("unique_estimate"),
        "numeric_min", "numeric_max", "date_min", "date_max",
    )


def top_values(cells: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(…keys, value, n): the commonest values per key, of equals the least; a report of `most` rows a key.

    Values are counted first, so only distinct ones are ranked.
    """
    counts = cells.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "value"))
    return counts.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
