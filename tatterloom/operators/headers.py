"""Header clusters: names that mean one column, across spelling, script and case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tatterloom.functions.names import SYNONYMS, aliases, latin_slugs
from tatterloom.functions.scalars import BUCKETS, ngrams, similarity, skeleton, strip
from tatterloom.operators.durable import durable

LINK_AT, REVIEW_BELOW, GRAM = 0.72, 0.7, 3
MOST_SAMPLES = 32


def dominant_type(counts: dict[str, Column]) -> Column:
    """The bucket with the most cells, empties aside; of equals the first; null if all are zero."""
    kinds = [b for b in BUCKETS if b != "empty"]
    most = F.greatest(*[counts[b] for b in kinds])
    out = F.lit(None).cast("string")
    for b in reversed(kinds):
        out = F.when((most > 0) & (counts[b] == most), b).otherwise(out)
    return out


def header_nodes(variants: DataFrame, groups: tuple[tuple[str, ...], ...] = SYNONYMS) -> DataFrame:
    """A row per distinct header of variants (file_id, idx, raw, n_<bucket>…): its slug, alias, grams, tokens, skeleton, dominant type and counts."""
    name = F.when(strip(F.col("raw")) != "", strip(F.col("raw"))).otherwise(F.concat(F.lit("column_"), (F.col("idx") + 1).cast("string")))
    nodes = variants.withColumn("header", name).groupBy("header").agg(
        *[F.coalesce(F.sum(f"n_{b}"), F.lit(0)).alias(f"n_{b}") for b in BUCKETS], F.count_distinct("file_id").alias("files"), F.count_distinct("file_id", "idx").alias("sources"), F.min(F.struct("file_id", "idx")).alias("first")
    )
    slugs = nodes.withColumn("slug", latin_slugs("header"))
    table = F.create_map(*[F.lit(x) for kv in aliases(groups).items() for x in kv])
    s = F.col("slug")
    return slugs.withColumns(
        {
            "alias": F.try_element_at(table, s), "grams": F.when(s == "", F.array().cast("array<string>")).otherwise(ngrams(s, GRAM)), "tokens": F.array_distinct(F.filter(F.split(s, " "), lambda t: t != "")),
            "skeleton": skeleton(s), "joined": F.replace(s, F.lit(" "), F.lit("")), "dominant": dominant_type({b: F.col(f"n_{b}") for b in BUCKETS}),
        }
    )


def candidate_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of headers, a < b, that could link, found by equality of what a link needs.

    Without a common gram the score stays under 0.7, so links come from a common gram, alias, skeleton or de-spaced
    slug, or from a slug of at most four characters that begins the other.
    """
    tag = lambda t, c: F.concat(F.lit(t), c)
    keys = F.concat(F.transform("grams", lambda g: tag("g", g)), F.array_compact(F.array(tag("a", F.col("alias")), F.when(F.length("skeleton") >= 3, tag("s", F.col("skeleton"))), F.when(F.col("joined") != "", tag("j", F.col("joined"))))))
    keyed = nodes.select("header", F.explode(keys).alias("key"))
    same = keyed.alias("x").join(keyed.alias("y"), "key").where("x.header < y.header").select(F.col("x.header").alias("a"), F.col("y.header").alias("b"))
    short = nodes.where("length(slug) between 1 and 4").select(F.col("header").alias("short"), F.col("slug").alias("key"))
    starts = nodes.select(F.col("header").alias("long"), F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.greatest(F.length("slug"), F.lit(1)))), lambda k: F.substring("slug", F.lit(1), k))).alias("key"))
    prefix = short.join(starts, "key").where("short <> long").select(F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b"))
    return same.unionByName(prefix).distinct()


def header_links(nodes: DataFrame, link_at: float = LINK_AT) -> DataFrame:
    """(a, b, score) of the pairs that mean one column."""
    x, y = nodes.alias("x"), nodes.alias("y")
    pairs = candidate_pairs(nodes).join(x, F.col("a") == F.col("x.header")).join(y, F.col("b") == F.col("y.header"))
    side = lambda t: {k: F.col(f"{t}.{k}") for k in ("slug", "grams", "tokens")}
    left, right = F.col("x.dominant"), F.col("y.dominant")
    compatible = left.isNull() | right.isNull() | (left == right) | (left.isin("integer", "float") & right.isin("integer", "float"))
    score = similarity(side("x"), side("y"))
    short = (F.length("x.slug") <= 4) | (F.length("y.slug") <= 4)
    starts = F.startswith(F.col("x.slug"), F.col("y.slug")) | F.startswith(F.col("y.slug"), F.col("x.slug"))
    alike = (score >= link_at) | (F.col("x.joined") == F.col("y.joined")) | ((F.col("x.skeleton") == F.col("y.skeleton")) & (F.length("x.skeleton") >= 3)) | (short & starts)
    named = F.col("x.slug") != ""
    link = F.coalesce(F.col("x.alias") == F.col("y.alias"), F.lit(False)) | (named & (F.col("y.slug") != "") & compatible & alike)
    return pairs.where(link).select("a", "b", F.round(score, 6).alias("score"))


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(header, cluster): the least header reachable, by least labels over links; each round is checkpointed."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = nodes.select("header", F.col("header").alias("cluster"))
    while True:
        near = both.join(labels, both["b"] == labels["header"]).groupBy("a").agg(F.min("cluster").alias("near"))
        moved = durable(labels.join(near, labels["header"] == near["a"], "left").select("header", F.least("cluster", F.coalesce("near", "cluster")).alias("next"), "cluster"))
        labels = moved.select("header", F.col("next").alias("cluster"))
        if moved.where("next <> cluster").isEmpty():
            return labels


def confidence(purity: Column, sources: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.35), 0.35 + 0.4 * purity + 0.25 * F.least(F.lit(1.0), sources / 4))), 2)


def header_clusters(variants: DataFrame, link_at: float = LINK_AT, review_below: float = REVIEW_BELOW, groups: tuple[tuple[str, ...], ...] = SYNONYMS) -> DataFrame:
    """(canonical_name, headers, sources, confidence, needs_review): a row per cluster of headers.

    The name is the header in most files, of those an ASCII one, of those the shortest, of those the first met.
    Confidence grows with the share of the commonest type and with sources, up to four. One spelling alone is flagged.
    """
    nodes = header_nodes(variants, groups)
    nodes = durable(nodes)
    clustered = nodes.join(_components(nodes, header_links(nodes, link_at)), "header")
    ascii_name = (F.octet_length("header") == F.char_length("header")).cast("int")
    total = [F.sum(f"n_{b}") for b in BUCKETS]
    sums = clustered.groupBy("cluster").agg(
        F.min_by("header", F.struct(-F.col("files"), -ascii_name, F.char_length("header"), "first")).alias("canonical_name"), F.array_sort(F.collect_list("header")).alias("headers"),
        F.sum("sources").alias("sources"), F.greatest(*total).alias("most"), sum(total, F.lit(0)).alias("all"),
    )
    purity = F.when(F.col("all") > 0, F.col("most") / F.when(F.col("all") > 0, F.col("all"))).otherwise(1.0)
    sure = confidence(purity, F.col("sources"))
    return sums.select("canonical_name", "headers", "sources", sure.alias("confidence"), ((sure < review_below) | (F.size("headers") == 1)).alias("needs_review"))


def merge_by_name(clusters: DataFrame) -> DataFrame:
    """Clusters (canonical_name, headers) merged by lower-cased name."""
    merged = clusters.groupBy(F.lower(strip(F.col("canonical_name"))).alias("canonical_name")).agg(F.array_sort(F.flatten(F.collect_list("headers"))).alias("headers"))
    return merged.withColumns({"confidence": F.lit(1.0), "needs_review": F.lit(False)})


def type_profiles(counts: DataFrame) -> DataFrame:
    """Sums of type counts (raw_header, n_<bucket>…) per header."""
    return counts.groupBy("raw_header").agg(*[F.sum(f"n_{b}").cast("long").alias(f"n_{b}") for b in BUCKETS])
