"""Schemas from block signatures, names by synonyms, and contracts."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tatterloom.functions.scalars import compact_slug, snake_slug, strip, synonym_key
from tatterloom.operators.durable import durable, small

HEADER_ALIKE = 0.85


@dataclass(frozen=True)
class Synonyms:
    """Canonical names by the key of any variant; later entries win, and a canonical name is a variant of itself."""

    lookup: Mapping[str, str]

    @classmethod
    def of(cls, groups: Mapping[str, Iterable[str]]) -> Synonyms:
        found: dict[str, str] = {}
        for name, variants in groups.items():
            for v in (name, *variants):
                if key := _key(v):
                    found[key] = name
        return cls(found)

    @classmethod
    def read(cls, path: str) -> Synonyms:
        """From a JSON file of name -> variants; a missing file has none."""
        try:
            with open(path, encoding="utf-8") as f:
                return cls.of(json.load(f))
        except FileNotFoundError:
            return cls({})

    def with_variant(self, name: str, variant: str) -> Synonyms:
        return Synonyms({**self.lookup, **({_key(variant): name} if _key(variant) else {})})

    def normalized(self, name: Column) -> Column:
        """The canonical name of a header, or its slug."""
        if not self.lookup:
            return snake_slug(name)
        table = F.create_map(*[F.lit(x) for kv in self.lookup.items() for x in kv])
        return F.coalesce(F.try_element_at(table, synonym_key(name)), snake_slug(name))

    def canonical(self, name: str) -> str:
        """normalized() of one name, on the driver."""
        if (key := _key(name)) and key in self.lookup:
            return self.lookup[key]
        kept = "".join(c for c in name.strip().lower().replace(" ", "_") if c == "_" or c.isascii() and c.isalnum())
        return kept or "column"


def _key(name: str) -> str:
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def _first_fit(blocks: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one delimiter and width: each joins the first schema whose first header is alike."""
    blocks = blocks.sort_values("ord")
    firsts: list[tuple[str, int]] = []
    owner = []
    for ord_, header in zip(blocks["ord"], blocks["names"], strict=True):
        fit = next((o for h, o in firsts if SequenceMatcher(None, h, header).ratio() >= HEADER_ALIKE), None)
        if fit is None:
            firsts.append((header, ord_))
            fit = ord_
        owner.append(fit)
    return blocks.assign(schema_ord=owner)[["ord", "schema_ord"]]


def cluster_blocks(blocks: DataFrame, synonyms: Synonyms) -> DataFrame:
    """(ord, schema_ord): the block that founds each block's schema, for blocks (ord, delimiter, column_count, header_sample).

    Blocks of different delimiters or widths never share a schema, so each such group is clustered by itself. Distinct
    headers are named and compared, not blocks: blocks with one header share a schema. Few distinct headers are
    broadcast to the blocks, which then never shuffle.
    """
    kept = ["delimiter", "column_count", "header_sample"]
    headers = blocks.groupBy(*kept).agg(F.min("ord").alias("ord"))
    names = F.array_join(F.transform(F.split(F.col("header_sample"), F.concat(F.lit(r"\Q"), "delimiter", F.lit(r"\E")), -1), lambda h: synonyms.normalized(strip(h))), "|")
    named = durable(headers.withColumn("names", names))
    distinct = named.groupBy("delimiter", "column_count", "names").agg(F.min("ord").alias("ord"))
    fitted = distinct.groupBy("delimiter", "column_count").applyInPandas(_first_fit, "ord long, schema_ord long")
    founders = distinct.join(fitted, "ord").select("delimiter", "column_count", "names", "schema_ord")
    found = durable(named.join(founders, ["delimiter", "column_count", "names"]).select(*kept, "schema_ord"))
    return blocks.join(small(found), kept).select("ord", "schema_ord")


def schema_columns(schemas: DataFrame, columns: DataFrame, synonyms: Synonyms) -> DataFrame:
    """(schema_id, index, raw_name, name, data_type) from schemas (schema_id, header_sample, delimiter) and the types (schema_id, idx, data_type) of their founding blocks."""
    cells = schemas.select("schema_id", F.posexplode(F.split("header_sample", F.concat(F.lit(r"\Q"), "delimiter", F.lit(r"\E")), -1)).alias("index", "raw"))
    named = cells.select("schema_id", "index", strip(F.col("raw")).alias("raw_name"))
    typed = named.join(columns.select("schema_id", F.col("idx").alias("index"), "data_type"), ["schema_id", "index"], "left")
    return typed.select("schema_id", "index", "raw_name", synonyms.normalized(F.col("raw_name")).alias("name"), F.coalesce("data_type", F.lit("string")).alias("data_type"))


def bind_contracts(schemas: DataFrame, contracts: DataFrame) -> DataFrame:
    """schemas (schema_id, name, contract_id, namespace) with the contract that is theirs: by namespace and id, by namespace and name, else by id in any namespace."""
    c = small(contracts.select(F.col("namespace").alias("c_ns"), F.col("contract_id").alias("c_id"), F.col("version").alias("c_version")))
    ns = F.coalesce("namespace", F.lit("default"))
    pick = lambda t: F.struct(F.col(f"{t}.c_ns").alias("namespace"), F.col(f"{t}.c_id").alias("contract_id"), F.col(f"{t}.c_version").alias("version"))
    any_ns = small(contracts.groupBy(F.col("contract_id").alias("c_id")).agg(F.min_by(F.struct(F.col("namespace").alias("c_ns"), F.col("version").alias("c_version")), "namespace").alias("x")).select("c_id", "x.*"))
    s = schemas.alias("s")
    joined = s.join(c.alias("a"), (F.col("a.c_ns") == ns) & (F.col("a.c_id") == F.col("s.contract_id")), "left")
    joined = joined.join(c.alias("b"), (F.col("b.c_ns") == ns) & (F.col("b.c_id") == F.col("s.name")), "left")
    joined = joined.join(any_ns.alias("d"), F.col("d.c_id") == F.coalesce(F.col("s.contract_id"), F.col("s.name")), "left")
    found = F.when(F.col("a.c_id").isNotNull(), pick("a")).when(F.col("b.c_id").isNotNull(), pick("b")).when(F.col("d.c_id").isNotNull(), pick("d"))
    return joined.select("s.schema_id", "s.name", found.alias("contract")).select("schema_id", "name", F.col("contract.namespace").alias("namespace"), F.col("contract.contract_id").alias("contract_id"), F.col("contract.version").alias("version"))


def contract_types(columns: DataFrame, specs: DataFrame) -> DataFrame:
    """columns (schema_id, index, name, data_type) with the types of the contract's columns (schema_id, column, spec_type) of the same slug."""
    s = specs.select("schema_id", compact_slug(F.col("column")).alias("_slug"), "spec_type")
    joined = columns.withColumn("_slug", compact_slug(F.col("name"))).join(s, ["schema_id", "_slug"], "left")
    return joined.select("schema_id", "index", "name", F.coalesce("spec_type", "data_type").alias("data_type"))


def header_groups(headers: DataFrame) -> DataFrame:
    """(slug, variants) of distinct headers (raw) by their reviewing slug."""
    from tatterloom.functions.names import review_slugs

    return headers.select(strip(F.col("raw")).alias("raw")).distinct().withColumn("slug", review_slugs("raw")).groupBy("slug").agg(F.array_sort(F.collect_list("raw")).alias("variants"))
