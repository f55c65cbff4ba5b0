"""Row alignment, width fit, and validation against a schema and its contract."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tatterloom.functions.scalars import is_bool, is_date, is_datetime, is_float, is_int, is_json, number_value, strip

BLANK = ""


def aligned(cells: Column, sources: Column, targets: Column) -> Column:
    """The row with the cell at sources[k] moved to targets[k].

    Of entries with one target the last counts. The other slots take the cells that no entry names, in order, then
    blanks. Null sources (a file without a mapping) leave the row as it is. A source beyond the row is blank.
    """
    # every entry's slot exists, and no cell is lost unless an entry names its source
    width = F.greatest(F.size(cells), F.coalesce(F.array_max(targets) + 1, F.lit(1)), F.lit(1))
    rest = F.filter(cells, lambda _, i: ~F.array_contains(sources, i))
    taken = F.array_distinct(targets)

    def slot(i: Column) -> Column:
        entry = F.size(targets) - F.array_position(F.reverse(targets), i).cast("int")
        cell = F.when(F.array_contains(targets, i), F.get(cells, F.get(sources, entry))).otherwise(F.get(rest, i - F.size(F.filter(taken, lambda t: t < i))))
        return F.coalesce(cell, F.lit(BLANK))

    return F.when(sources.isNull() | (F.size(sources) == 0), cells).otherwise(F.transform(F.sequence(F.lit(0), width - 1), slot))


def mapping_arrays(entries: DataFrame) -> DataFrame:
    """(file_id, sources, targets) from entries (file_id, source_index, target_index), by source; an entry without a target is left out."""
    pairs = F.array_sort(F.collect_list(F.struct("source_index", "target_index")))
    grouped = entries.where("target_index is not null").groupBy("file_id").agg(pairs.alias("p"))
    return grouped.select("file_id", F.col("p.source_index").alias("sources"), F.col("p.target_index").alias("targets"))


def align_rows(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """rows (file_id, cells, …) with `cells` aligned and `observed` widths; mappings are a row per file."""
    arrays = mapping_arrays(entries)
    return rows.join(arrays, "file_id", "left").withColumn("observed", F.size("cells")).withColumn("cells", aligned(F.col("cells"), F.col("sources"), F.col("targets"))).drop("sources", "targets")


def fitted(cells: Column, width: int) -> Column:
    """The row cut or filled with blanks to the width."""
    return F.concat(F.slice(cells, 1, width), F.array_repeat(F.lit(BLANK), F.greatest(F.lit(0), width - F.size(cells))))


@dataclass(frozen=True)
class Spec:
    """A contract's column."""

    name: str
    data_type: str = "string"
    required: bool = True
    allow_null: bool = False
    allowed_values: tuple[str, ...] = ()
    min_value: float | None = None
    max_value: float | None = None
    index: int | None = field(default=None)


def type_ok(v: Column, data_type: str) -> Column:
    """Whether a cell is of a contract's type; types it doesn't know hold for any cell."""
    checks = {"int": is_int, "integer": is_int, "bool": is_bool, "boolean": is_bool, "date": is_date, "datetime": is_datetime, "json": is_json}
    checks |= dict.fromkeys(("float", "double", "decimal", "number"), is_float)
    check = checks.get(data_type.lower())
    return check(v) if check else F.lit(True)


def check(v: Column, spec: Spec) -> tuple[Column, Column]:
    """(missing, mismatch) of a cell as 0 or 1: blanks are only missing, and a wrong value isn't also checked for type."""
    blank = v.isNull() | (strip(v) == "")
    missing = F.when(blank, 1).otherwise(0) if spec.required and not spec.allow_null else F.lit(0)
    ok = type_ok(v, spec.data_type)
    if spec.allowed_values:
        ok = v.isin(*spec.allowed_values) & ok
    if spec.data_type.lower() in ("int", "integer", "float", "double", "decimal", "number"):
        x = number_value(v)
        for bound, beyond in ((spec.min_value, lambda b: x < b), (spec.max_value, lambda b: x > b)):
            if bound is not None:
                ok = ok & (F.isnan(x) | ~F.coalesce(beyond(F.lit(float(bound))), F.lit(False)))
    return missing, F.when(blank, 0).when(F.coalesce(ok, F.lit(False)), 0).otherwise(1)


def validated(rows: DataFrame, width: int, specs: list[Spec]) -> DataFrame:
    """rows (cells, observed) fitted to the width, with is_empty, is_short, is_long, n_missing and n_mismatch.

    A contract column without an index in the schema is blank on every row.
    """
    cell = lambda s: F.lit(BLANK) if s.index is None else F.get(F.col("cells"), s.index)
    found = [check(cell(s), s) for s in specs]
    total = lambda k: sum((f[k] for f in found), F.lit(0)).cast("long")
    fit = rows.withColumn("is_empty", F.forall("cells", lambda c: strip(c) == "")).withColumn("cells", fitted(F.col("cells"), width))
    return fit.withColumns({"is_short": F.col("observed") < width, "is_long": F.col("observed") > width, "n_missing": total(0), "n_mismatch": total(1)})


def summary_columns() -> list[Column]:
    """The validation counters as aggregates; empty rows are no errors."""
    return [
        F.count(F.lit(1)).alias("total_rows"), F.count_if("is_short").alias("short_rows"), F.count_if("is_long").alias("long_rows"), F.count_if("is_empty").alias("empty_rows"),
        F.coalesce(F.sum("n_missing"), F.lit(0)).alias("missing_required"), F.coalesce(F.sum("n_mismatch"), F.lit(0)).alias("type_mismatches"),
    ]


def error_count() -> Column:
    return F.col("short_rows") + F.col("long_rows") + F.col("missing_required") + F.col("type_mismatches")


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """validated() rows that count as they are written."""
    counts = Observation(name)
    return rows.observe(counts, *summary_columns()), counts
