"""Column offsets: where a name usually stands, and how far each file's column is from there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tatterloom.operators.durable import small
from tatterloom.operators.headers import BUCKETS


def type_confidence(observed: dict[str, Column], profile: dict[str, Column]) -> Column:
    """1 less the mean difference of two type distributions, rounded; null where either has no cells."""
    p, q = sum(observed.values(), F.lit(0)), sum(profile.values(), F.lit(0))
    share = lambda c, t: c / F.when(t > 0, t)
    seen = sum((F.when((observed[b] > 0) | (profile[b] > 0), 1).otherwise(0) for b in BUCKETS), F.lit(0))
    gap = sum((F.abs(share(observed[b], p) - share(profile[b], q)) for b in BUCKETS), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), 1 - gap / F.when(seen > 0, seen)), 2)


def detect_offsets(variants: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """(file_id, source_index, canonical_name, target_index, offset_from_index, offset_reason, offset_confidence) of variants (canonical_name, file_id, idx, ord[, n_<bucket>…]).

    The target is the name's commonest index over all files; of equals, that of the variant with the least ord. With
    profiles (file_id, idx, n_<bucket>…) confidence compares the types, else it is 1 where the column is moved.
    """
    counted = variants.groupBy("canonical_name", "idx").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    target = counted.groupBy("canonical_name").agg(F.max_by("idx", F.struct("n", -F.col("first"))).alias("target_index"))
    rows = variants.alias("v").join(target, "canonical_name")
    moved = F.col("v.idx") - F.col("target_index")
    sure = F.lit(None).cast("double")
    if profiles is not None:
        rows = rows.join(profiles.alias("p"), (F.col("v.file_id") == F.col("p.file_id")) & (F.col("v.idx") == F.col("p.idx")), "left")
        sure = type_confidence({b: F.col(f"v.n_{b}") for b in BUCKETS}, {b: F.col(f"p.n_{b}") for b in BUCKETS})
    return rows.select(
        F.col("v.file_id").alias("file_id"), F.col("v.idx").alias("source_index"), "canonical_name", "target_index", F.when(moved != 0, moved).alias("offset_from_index"),
        F.when(moved != 0, "auto-detected").alias("offset_reason"), F.coalesce(sure, F.when(moved != 0, 1.0)).alias("offset_confidence"),
    )


def schema_bucket(data_type: Column) -> Column:
    t = F.lower(F.coalesce(data_type, F.lit("")))
    return F.when(t.isin("int", "integer"), "integer").when(t.isin("float", "double", "decimal", "number"), "float").when(t.contains("date") | t.contains("time"), "date").otherwise("text")


def resolve_targets(entries: DataFrame, columns: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """entries (file_id, source_index, canonical_name, target_index) with targets filled in for the schema's columns (index, name, data_type).

    A target that is set stays; else the first column with the same slug; else the first whose type bucket is the
    entry's commonest in profiles, whole and decimal numbers standing in for each other.
    """
    from tatterloom.functions.scalars import unicode_slug

    by_slug = columns.select(unicode_slug(F.col("name")).alias("slug"), "index").where("slug <> ''").groupBy("slug").agg(F.min("index").alias("by_slug"))
    found = entries.join(small(by_slug), unicode_slug(F.col("canonical_name")) == F.col("slug"), "left").drop("slug")
    by_type = F.lit(None).cast("int")
    if profiles is not None:
        kinds = ("integer", "float", "text", "date")
        most = F.greatest(*[F.col(f"n_{b}") for b in kinds])
        kind = F.lit(None).cast("string")
        for b in reversed(kinds):
            kind = F.when((most > 0) & (F.col(f"n_{b}") == most), b).otherwise(kind)
        own = profiles.select("file_id", F.col("idx").alias("source_index"), kind.alias("kind"))
        bucket = columns.groupBy(schema_bucket(F.col("data_type")).alias("kind")).agg(F.min("index").alias("at"))
        other = F.when(F.col("kind") == "integer", "float").when(F.col("kind") == "float", "integer")
        found = found.join(own, ["file_id", "source_index"], "left").withColumn("other", other)
        found = found.join(F.broadcast(bucket), "kind", "left").join(F.broadcast(bucket.select(F.col("kind").alias("other"), F.col("at").alias("at_other"))), "other", "left")
        by_type = F.coalesce("at", "at_other")
    return found.select(*[c for c in entries.columns if c != "target_index"], F.coalesce("target_index", "by_slug", by_type).alias("target_index"))


def targets_within(entries: DataFrame, founder: str) -> DataFrame:
    """(file_id, source_index, target_index): where each file's columns stand in the file that founded the schema.

    A name that either file has twice, or the founder lacks, leaves its column where it is.
    """
    names = entries.groupBy("file_id", "canonical_name").agg(F.count(F.lit(1)).alias("n"), F.min("source_index").alias("at"))
    own = names.where(F.col("file_id") == founder).select("canonical_name", F.col("n").alias("own_n"), "at")
    joined = entries.select("file_id", "source_index", "canonical_name").join(names.select("file_id", "canonical_name", "n"), ["file_id", "canonical_name"]).join(own, "canonical_name", "left")
    return joined.select("file_id", "source_index", F.when((F.col("n") == 1) & (F.col("own_n") == 1), F.col("at")).otherwise(F.col("source_index")).alias("target_index"))
