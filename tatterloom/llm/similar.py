"""The near-duplicate stage's links: pairs of texts whose word shingles have a Jaccard similarity of 0.8 or more.

This is operator 7 with the stage's shingles and an exact check. Texts with one set of shingles are one node. A node's
SimHash fingerprint goes to the Gray-order indexes of simhash.links, at RADIUS bits; what these connect are candidates.

At a similarity of 0.8 fingerprints of 64 bits differ in some 4 to 14 bits, and an index for so wide a radius prunes
almost nothing (README has the recall of narrower ones). So that no link is lost, the pairs that the indexes leave apart
have an exact way, by the rarest shingles: two sets of that similarity share one of the first n - ceil(0.8 n) + 1 of each, in any
one order of all shingles. The order here puts shingles that are common in a sample last, so a common passage or line
seldom is among the first; a sample that misses some costs time and changes no result.

Nodes of like sizes that share one of their first shingles are a bucket, and buckets of the same nodes are one.
Whole sets don't go there, only their sizes and parity bitmaps, of n to 2 n bits for n shingles: two bitmaps differ in at
most as many bits as the sets have different members, so a pair that differs in more than similarity 0.8 allows is no
link. What the indexes and the other pairs connect are components; the sets of these are compared.

Both comparisons search from each node to the nodes not reached so far, which gives a spanning forest, and among nodes
that are all alike ends after few steps, so no pairs are listed. A group of over MOST nodes is never gathered: its nodes
are compared with its first node, in any number of tasks; those that are alike to it need no comparison with each other,
and only the others, in blocks, meet the whole group, in blocks too. Components of all forests are the groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tatterloom.llm import simhash
from tatterloom.llm.common import bounded, by_bitmaps, keep_rows, row_key, spread, stored, trim, whole, with_groups, written
from tatterloom.llm.components import star_components
from tatterloom.llm.simhash import SEED, least_rows, majority

SHINGLE, SIMILARITY = 5, 0.8
RADIUS = 5  # bits within which fingerprints are linked
MOST_IN_INDEX = 5_000  # fingerprints of a key that one index holds: fewer than op7's, as wider searches prune less
SAMPLE = 5_000  # rows whose shingles are counted for the order
MOST_COMMON = 200_000  # shingles with a place of their own at the order's end: 3 MB
MOST = 2_000  # nodes of a bucket that one task holds
_EPS = 1e-9


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes, sorted; words as in simhash.fingerprint.

    A text of fewer words is one shingle, also one without words (null too): such texts are alike.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    of = xxhash.xxh64_intdigest
    found = [of(b" ".join(words[k : k + shingle]), SEED) for k in range(max(1, len(words) - shingle + 1))]
    return np.unique(np.array(found, np.uint64).view(np.int64))


def fingerprint(grams: np.ndarray) -> int:
    """A set's fingerprint; of an even number the least one decides where half have a bit, else zeros would outweigh in short texts."""
    return majority((grams if len(grams) % 2 else np.append(grams, grams[0])).view(np.uint64))


def prefix(grams: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in the order of (count, hash) that a set of this similarity must share one of."""
    n = len(grams) - math.ceil(similarity * len(grams) - _EPS) + 1
    if not len(common):
        return grams[:n]
    at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
    return grams[np.argsort(np.where(common[at] == grams, counts[at], 0), kind="stable")[:n]]


def linked(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, other) places of a spanning forest of the links among sets."""
    size, left = np.array([len(s) for s in sets]), np.ones(len(sets), bool)
    a, b, queue = [], [], []
    while left.any():
        alive = np.flatnonzero(left)  # postings of the sets not reached so far
        tokens = np.concatenate([sets[k] for k in alive])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], np.repeat(np.arange(len(alive)), size[alive])[order]
        while left.any() and (len(alive) < 8 or 2 * np.count_nonzero(left) > len(alive)):
            if not queue:
                queue.append(int(np.argmax(left)))
                left[queue[0]] = False
            x = queue.pop()
            lo, hi = np.searchsorted(tokens, sets[x]), np.searchsorted(tokens, sets[x], "right")
            n = hi - lo
            places = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            both = np.bincount(owner[places], minlength=len(alive))
            near = alive[left[alive] & (both >= similarity * (size[x] + size[alive] - both) - _EPS)]
            left[near] = False
            a.append(near)
            b.append(np.full(len(near), x))
            queue.extend(near.tolist())
    none = np.zeros(0, np.intp)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def bitmap(grams: np.ndarray) -> bytes:
    """The parity of the shingles in each of n to 2 n cells, 64 at least."""
    cells = max(64, 1 << (len(grams) - 1).bit_length())
    return np.packbits(np.bincount(grams & (cells - 1), minlength=cells) & 1, bitorder="little").astype(np.uint8).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap of fewer cells: a cell's parity is that of the cells that fall together."""
    x = np.frombuffer(bits, np.uint64)
    while 8 * len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def maybe_linked(bitmaps: list[bytes], sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, other) places of a spanning forest of the pairs whose sizes and bitmaps allow the similarity."""
    least = min(map(len, bitmaps))
    table, left = np.stack([folded(b, least) for b in bitmaps]), np.ones(len(bitmaps), bool)
    a, b, queue = [], [], []
    while left.any():
        if not queue:
            queue.append(int(np.argmax(left)))
            left[queue[0]] = False
        x, alive = queue.pop(), np.flatnonzero(left)
        n = sizes[x] + sizes[alive]
        apart = np.bitwise_count(table[alive] ^ table[x]).sum(axis=1, dtype=np.int64)
        may = (apart * (1 + similarity) <= (1 - similarity) * n + _EPS) & (np.minimum(sizes[x], sizes[alive]) >= similarity * np.maximum(sizes[x], sizes[alive]) - _EPS)
        near = alive[may]
        left[near] = False
        a.append(near)
        b.append(np.full(len(near), x))
        queue.extend(near.tolist())
    return np.concatenate(a), np.concatenate(b)


def _by_bitmaps(found: list[tuple[int, bytes]], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    return maybe_linked([d for _, d in found], np.array([n for n, _ in found]), similarity)


def _by_sets(found: list[tuple[int, bytes]], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    return linked([np.frombuffer(d, np.int64) for _, d in found], similarity)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _grams(texts: DataFrame, shingle: int) -> DataFrame:
    """(file, row, grams) of texts (file, row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingles(t.as_py(), shingle) for t in part["text"]]
                yield pa.RecordBatch.from_arrays([part["file"], part["row"], _lists(sets)], ["file", "row", "grams"])

    return texts.select("file", "row", "text").mapInArrow(run, "file long, row long, grams array<long>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(file, row, size, data) of texts (file, row, text): the sets as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingles(t.as_py(), shingle) for t in part["text"]]
                yield pa.RecordBatch.from_arrays([part["file"], part["row"], pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], ["file", "row", "size", "data"])

    return texts.select("file", "row", "text").mapInArrow(run, "file long, row long, size int, data binary")


def _common(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that repeat in the sample, sorted, and in how many of its rows they are."""
    share = max(1, rows.count() // SAMPLE)
    counts = _grams(rows.where(F.pmod(F.xxhash64("file", "row"), F.lit(share)) == 0), shingle).select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    table = counts.orderBy(F.desc("n"), "gram").limit(MOST_COMMON).toArrow()  # bounded rows
    grams, n = table["gram"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def _nodes(rows: DataFrame, common: tuple[np.ndarray, np.ndarray], shingle: int, similarity: float) -> DataFrame:
    """(_row_id, file, row, node, fp, first, size, data) of rows (_row_id, file, row, text): the set's digest and fingerprint, its first shingles, size and bitmap."""
    ordered = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        common, counts = ordered.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = [shingles(t.as_py(), shingle) for t in part["text"]]
                nodes = pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
                fps = pa.array(np.array([fingerprint(s) for s in sets], np.uint64).view(np.int64))
                first = _lists([prefix(s, common, counts, similarity) for s in sets])
                rest = [pa.array([len(s) for s in sets], pa.int32()), pa.array(list(map(bitmap, sets)), pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in ("_row_id", "file", "row")), nodes, fps, first, *rest], ["_row_id", "file", "row", "node", "fp", "first", "size", "data"])

    kind = rows.schema["_row_id"].dataType.simpleString()
    return spread(rows).mapInArrow(run, f"_row_id {kind}, file long, row long, node binary, fp long, first array<long>, size int, data binary")


def _by_fingerprints(nodes: DataFrame, radius: int, most: int = MOST_IN_INDEX) -> DataFrame:
    """(a, b): edges that connect the nodes (uid, fp) whose fingerprints are equal or connected by the indexes."""
    codes = written(nodes.groupBy("fp").agg(F.min("uid").alias("least"), F.count(F.lit(1)).alias("n")), "codes")
    equal = with_groups(nodes.select("uid", "fp"), codes.where("n > 1"), "fp", "n", "inner").where("uid <> least").select(F.col("uid").alias("a"), F.col("least").alias("b"))
    named = simhash.links(codes.select("fp"), radius, most)
    for c in ("a", "b"):
        named = named.withColumnRenamed(c, "fp").join(codes.select("fp", F.col("least").alias(c)), "fp").drop("fp")
    return equal.unionByName(named)


def _buckets(nodes: DataFrame, similarity: float) -> DataFrame:
    """(gram, uid, n): nodes (uid, first, size) of like sizes that share one of their first shingles, and how many these are.

    A node stands in its class of sizes and the next, so two nodes whose sizes allow the similarity meet in one.
    """
    each = nodes.select("uid", "size", F.explode("first").alias("gram"))
    least = written(each.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "least")
    members = with_groups(each, least, "gram", "n", "inner")
    at = F.floor(F.log("size") / F.log(F.lit(1 / similarity)) + _EPS).cast("int")
    members = written(members.select("uid", F.explode(F.array(F.xxhash64("gram", at), F.xxhash64("gram", at + 1))).alias("gram")), "members")
    shared = members.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("uid").cast("decimal(38,0)")).alias("sum")).where("n > 1")
    # buckets of the same nodes are one: of equal size, and with equal sums of 64-bit hashes
    one = written(shared.groupBy("n", "sum").agg(F.min("gram").alias("gram")).select("gram", "n"), "buckets")
    return written(with_groups(members, one, "gram", "n", "inner").select("gram", "uid", "n"), "members")


def _forests(groups: DataFrame, payload: DataFrame, find, similarity: float, most: int) -> DataFrame:
    """(a, b): the forests that `find` gives of groups (gram, uid, n), whose nodes have (uid, size, data) in payload."""
    zero, half = F.lit(0).cast("long"), max(1, most // 2)
    keyed, seen = groups.where(F.col("n") <= most).select("gram", zero.alias("i"), zero.alias("j"), "uid"), None
    hot = groups.where(F.col("n") > most)
    if not hot.isEmpty():
        first = hot.groupBy("gram").agg(F.min("uid").alias("uid"))
        first = written(first.join(payload, "uid").select("gram", F.col("uid").alias("to"), F.col("size").alias("to_size"), F.col("data").alias("to_data")), "first")
        pairs = hot.join(payload, "uid").join(bounded(first, 1_000), "gram")

        def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = zip(*(batch[c].to_pylist() for c in ("size", "data", "to_size", "to_data")), strict=True)
                near = [len(find([(n, d), (m, e)], similarity)[0]) > 0 for n, d, m, e in rows]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("gram", "n", "uid", "to")), pa.array(near, pa.bool_())], ["gram", "n", "uid", "to", "alike"])

        seen = written(pairs.select("gram", "n", "uid", "to", "size", "data", "to_size", "to_data").mapInArrow(alike, "gram long, n long, uid long, to long, alike boolean"), "seen")
        sizes = written(seen.where(~F.col("alike")).groupBy("gram").agg(F.count(F.lit(1)).alias("left")), "left")
        every = seen.join(bounded(sizes), "gram")
        count = lambda n: F.ceil(F.col(n) / F.lit(half)).cast("long")
        block = lambda n: F.pmod(F.xxhash64("uid"), count(n))
        each = lambda n: F.explode(F.sequence(zero, count(n) - 1))
        rest = every.where(~F.col("alike")).withColumn("i", block("left")).withColumn("j", each("n"))
        blocks = rest.select("gram", "i", "j", "uid").unionByName(every.withColumn("j", block("n")).withColumn("i", each("left")).select("gram", "i", "j", "uid"))
        keyed = keyed.unionByName(blocks.distinct())
    rows = keyed.join(payload, "uid").select("gram", "i", "j", "uid", "size", "data").repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        now, uids, held = None, [], []

        def edges() -> pa.RecordBatch:
            a, b = find(held, similarity)
            own = np.array(uids, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own[a]), pa.array(own[b])], ["a", "b"])

        for batch in batches:
            for gram, i, j, uid, size, data in zip(*(batch[c].to_pylist() for c in ("gram", "i", "j", "uid", "size", "data")), strict=True):
                if (gram, i, j) != now:
                    if held:
                        yield edges()
                    now, uids, held = (gram, i, j), [], []
                uids.append(uid)
                held.append((size, data))
        if held:
            yield edges()

    found = rows.mapInArrow(run, "a long, b long")
    return found if seen is None else found.unionByName(seen.where("alike and uid <> to").select(F.col("uid").alias("a"), F.col("to").alias("b")))


def links(nodes: DataFrame, texts: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, most: int = MOST, radius: int = RADIUS) -> DataFrame:
    """(a, b) edges among the uid of nodes (uid, file, row, fp, first, size, data) whose components are those of all links; texts: (file, row, text)."""
    rest = _forests(_buckets(nodes, similarity), nodes.select("uid", "size", "data"), _by_bitmaps, similarity, most)
    star = star_components(_by_fingerprints(nodes, radius).unionByName(rest))
    star = written(star.select(F.col("a").alias("uid"), F.col("b").alias("gram")).unionByName(star.select(F.col("b").alias("uid"), F.col("b").alias("gram")).distinct()), "components")
    sizes = written(star.groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "sizes")
    wanted = written(nodes.select("uid", "file", "row").join(bounded(star.select("uid")), "uid"), "wanted")
    sets = _sets(by_bitmaps(texts.select("file", "row", "text"), wanted.select("file", "row"), True), shingle)
    sets = written(sets.join(bounded(wanted), ["file", "row"]).select("uid", "size", "data"), "sets")
    return _forests(with_groups(star, sizes, "gram", "n", "inner").select("gram", "uid", "n"), sets, _by_sets, similarity, most)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, most: int = MOST) -> DataFrame:
    """(_row_id, file, row, group): a row per row of a stored table; rows of one group are connected by links.

    Null texts count as empty; texts without words are alike, and so are equal ones. Repeated rows are rows of one
    group. An empty table gives an empty result; other columns of docs are not read.
    """
    texts = docs.select(*row_key(docs, id_col), whole(text_col).alias("text"))
    rows = _nodes(texts, _common(texts, shingle), shingle, similarity)
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "nodes")
    one = written(rows.groupBy("node").agg(F.min(F.struct("uid", "file", "row")).alias("one"), F.count(F.lit(1)).alias("size")), "one")
    copies = with_groups(rows.select("node", "uid", "file", "row"), one, "node", "size").where(F.col("uid") != F.col("one.uid"))
    nodes = by_bitmaps(rows.select("uid", "file", "row", "fp", "first", "size", "data"), copies.select("file", "row"), False)
    star = star_components(links(nodes, texts.select("file", "row", "text"), shingle, similarity, most))
    named = one.join(star, one["one.uid"] == star["a"], "left").select("node", "size", F.coalesce("b", "one.uid").alias("group"))
    return with_groups(rows.select("_row_id", "file", "row", "node"), written(named, "named"), "node", "size").select("_row_id", "file", "row", "group")


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of similar texts, that with the smallest id, with all its columns; see similar_groups and simhash.least_rows."""
    docs = stored(docs)
    return keep_rows(docs, written(least_rows(similar_groups(docs, id_col, text_col, shingle, similarity)), "decisions"))
