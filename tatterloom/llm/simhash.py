"""Near-duplicates by SimHash fingerprints, linked through Gray-order hierarchical indexes.

Fingerprints are 64-bit majorities of the XXH64 values of word shingles. Two fingerprints that differ in at most
`radius` bits agree in one of radius + 1 bit blocks, so each distinct fingerprint goes to one index per block, keyed by
the block's value; keys with over MOST_IN_INDEX members are dealt again by a block of their remaining bits. Within a
key the members are sorted by Gray rank, which puts codes that differ in few bits side by side, and a tree stands
over them: a node holds the bits that all below it share, without those that its parent holds already. A search
goes down level by level, adds up the differences with the nodes' patterns and leaves a whole group when they exceed
the radius. An index gives a spanning forest of its links, at most one edge per member; the components of these
forests are the groups. Copies share a fingerprint and are one node, so no pairs within a group are ever listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tatterloom.llm.common import input_bytes, keep_rows, row_key, spread, stored, whole, with_groups, written
from tatterloom.llm.components import star_components

SHINGLE, SEED, RADIUS = 3, 42, 2
MOST_IN_INDEX = 20_000
FANOUT = 8
_PIECE = 1 << 15  # shingles at a time
ALL = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The text's fingerprint: lower-cased A-Z, words between ASCII white space, shingles with repeats.

    A text of fewer words is one shingle; one without words (also null) has fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    stops = ends[-1:] if len(words) < shingle else ends[shingle - 1 :]
    of, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n, _PIECE):
        part = [of(line[a:b], SEED) for a, b in zip(starts[i : min(i + _PIECE, n)].tolist(), stops[i : i + _PIECE].tolist(), strict=True)]
        counts += _ones(np.array(part, np.uint64))
    return _over_half(counts, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of some 64-bit hashes have."""
    return _over_half(sum(_ones(hashes[i : i + _PIECE]) for i in range(0, len(hashes), _PIECE)), len(hashes))


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def _over_half(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row_id, file, row, fp): a row per row of a stored table."""
    rows = docs.select(*row_key(docs, id_col), whole(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch["text"]), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("_row_id", "file", "row")), pa.array(fps.view(np.int64))], ["_row_id", "file", "row", "fp"])

    return spread(rows).mapInArrow(run, f"_row_id {rows.schema['_row_id'].dataType.simpleString()}, file long, row long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit code in the reflected Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        codes = codes ^ (codes >> np.uint64(shift))
    return codes


class GrayIndex:
    """A tree over distinct codes in Gray order; nodes hold bit patterns that all codes below them share."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        ones = zeros = None
        levels = []
        n = len(self.codes)
        while n > 1 or not levels:
            n = -(-n // FANOUT)
            ones = self._fold(self.codes if ones is None else ones, np.bitwise_and, n)
            zeros = self._fold(~self.codes if zeros is None else zeros, np.bitwise_and, n)
            levels.append((ones, ones | zeros))
        self.levels = []  # from the top: (pattern, mask without the parent's bits)
        above = None
        for pattern, mask in reversed(levels):
            own = mask if above is None else mask & ~above[np.arange(len(mask)) // FANOUT]
            self.levels.append((pattern, own))
            above = mask
        self.leaf_mask = ~above[np.arange(len(self.codes)) // FANOUT]

    @staticmethod
    def _fold(x: np.ndarray, f: np.ufunc, n: int) -> np.ndarray:
        return f.reduceat(x, np.arange(n) * FANOUT)

    def within(self, first: int, last: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), i < j, of places in self.codes, i from first to last, that differ in at most radius bits."""
        query = np.arange(first, last)
        node, sums = np.zeros(len(query), np.int64), np.zeros(len(query), np.uint8)
        for depth, (pattern, mask) in enumerate(self.levels):
            if depth:
                query, node, sums = self._down(query, node, sums, len(pattern), FANOUT ** (len(self.levels) - depth))
            sums = sums + np.bitwise_count((self.codes[query] ^ pattern[node]) & mask[node])
            near = sums <= radius
            query, node, sums = query[near], node[near], sums[near]
        query, leaf, sums = self._down(query, node, sums, len(self.codes), 1)
        near = sums + np.bitwise_count((self.codes[query] ^ self.codes[leaf]) & self.leaf_mask[leaf]) <= radius
        return query[near], leaf[near]

    @staticmethod
    def _down(query: np.ndarray, node: np.ndarray, sums: np.ndarray, size: int, width: int):
        """Each node's children that hold a place after the query's."""
        child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        query, sums = np.repeat(query, FANOUT), np.repeat(sums, FANOUT)
        there = (child < size) & ((child + 1) * width - 1 > query)
        return query[there], child[there], sums[there]


def forest(codes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) edges that connect just what links of at most radius bits connect among distinct codes."""
    index = GrayIndex(codes)
    root = np.arange(len(codes))
    step = 512 if radius <= RADIUS else max(16, min(512, (1 << 20) // len(codes)))  # wide searches reach many leaves
    for first in range(0, len(codes), step):
        i, j = index.within(first, min(first + step, len(codes)), radius)
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (root[root] != root).any():
                root = root[root]
            i, j = i[apart], j[apart]
    child = np.flatnonzero(root != np.arange(len(codes)))
    return index.codes[child], index.codes[root[child]]


def _parts(bits: list[int], n: int) -> list[int]:
    """Masks of n blocks of these bit places, of like sizes."""
    return [sum(1 << b for b in bits[k * len(bits) // n : (k + 1) * len(bits) // n]) for k in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """Each row once per block of the bits that its mask leaves."""
    table = F.create_map(*[F.lit(x) for m, parts in masks.items() for x in (_signed(m), [_signed(m | p) for p in parts])])
    return rows.select("fp", F.explode(table[F.col("mask")]).alias("mask"))


def links(codes: DataFrame, radius: int = RADIUS, most: int = MOST_IN_INDEX) -> DataFrame:
    """(a, b) edges among the distinct fp of codes whose components are those of all links of at most radius bits."""
    spark, blocks = codes.sparkSession, radius + 1
    level, done, rows = [0], [], codes.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        masks = {m: _parts([b for b in range(64) if not m >> b & 1], blocks) for m in level}
        rows = _deal(rows, masks).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        level = [m | p for m, parts in masks.items() for p in parts]
        hot = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        if all(bin(~m & ALL).count("1") <= 3 * blocks for m in level):
            done.append(rows)
            break
        hot = written(hot.select("mask", "key"), "hot")
        if hot.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(hot, ["mask", "key"], "left_anti"))
        rows = written(rows.join(hot, ["mask", "key"], "left_semi").select("fp", "mask"), "dealt")
    dealt = done[0]
    for more in done[1:]:
        dealt = dealt.unionByName(more)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(codes) // (8 << 20))
    keyed = dealt.select("mask", "key", "fp").repartition(n, "mask", "key").sortWithinPartitions("mask", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp")]))
            table = np.concatenate(held, axis=1)
            new = np.flatnonzero((table[:2, 1:] != table[:2, :-1]).any(axis=0)) + 1
            if not len(new):  # one key so far: at most `most` rows
                continue
            held = [table[:, new[-1] :]]
            yield _forests(table[2, : new[-1]].view(np.uint64), np.concatenate([[0], new]), radius)
        if held:
            table = np.concatenate(held, axis=1)
            yield _forests(np.ascontiguousarray(table[2]).view(np.uint64), np.array([0, table.shape[1]]), radius)

    return keyed.mapInArrow(run, "a long, b long")


def _forests(codes: np.ndarray, bounds: np.ndarray, radius: int) -> pa.RecordBatch:
    """Edges of the groups of codes between bounds."""
    codes = np.ascontiguousarray(codes)
    size = np.diff(bounds)
    pairs = bounds[:-1][size == 2]
    pairs = pairs[np.bitwise_count(codes[pairs] ^ codes[pairs + 1]) <= radius] if len(pairs) else pairs
    a, b = [codes[pairs]], [codes[pairs + 1]]
    for k in np.flatnonzero(size > 2):
        x, y = forest(codes[bounds[k] : bounds[k + 1]], radius)
        a.append(x)
        b.append(y)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_row_id, file, row, fp, component_id): a row per row of docs.

    component_id is the smallest id reachable over links, itself included; null ids are skipped, so it is null only
    where every reachable id is. Empty and null texts have fingerprint 0, which links like any other; repeated rows
    are rows of their own in one group. An empty table gives an empty result; other columns of docs are not read.
    """
    rows = written(fingerprints(stored(docs), id_col, text_col), "fingerprints")
    codes = written(rows.groupBy("fp").agg(F.min("_row_id").alias("least"), F.count(F.lit(1)).alias("n")), "codes")
    star = star_components(links(codes))
    labelled = written(codes.join(star, codes["fp"] == star["a"], "left").select("fp", "n", "least", F.coalesce("b", "fp").alias("root")), "labelled")
    linked = labelled.join(star.select(F.col("b").alias("root")).distinct(), "root", "left_semi")
    roots = written(linked.groupBy("root").agg(F.min("least").alias("component_id")), "roots")
    named = labelled.join(roots, "root", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return with_groups(rows, written(named, "named"), "fp", "n").select("_row_id", "file", "row", "fp", "component_id")


def least_rows(rows: DataFrame) -> DataFrame:
    """(file, row, kept) of rows (_row_id, file, row, group): in each group the row with the smallest id is kept.

    A null id is greater than any other; of rows with one id the first place is kept.
    """
    of = [F.col("_row_id").isNull().alias("none"), F.col("_row_id").alias("id"), F.col("file").alias("f"), F.col("row").alias("r")]
    first = written(rows.groupBy("group").agg(F.min(F.struct(*of)).alias("first"), F.count(F.lit(1)).alias("size")), "first")
    kept = (F.col("file") == F.col("first.f")) & (F.col("row") == F.col("first.r"))
    return with_groups(rows, first, "group", "size").select("file", "row", kept.alias("kept"))
