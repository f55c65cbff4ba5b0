"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed on byte buffers, many documents at a time. The trees are grown on the driver
from at most MOST_LABELLED labelled rows (those with the least hashes of their ids, so a sample that doesn't depend
on order), over features cut into at most BINS bins. All trees have one depth and lie in three flat arrays, so a
batch goes down all trees with one gather per level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tatterloom.llm.common import spread, whole
from tatterloom.llm.textnum import Words, chunks, gram_sums, grams

MOST_LABELLED = 20_000
BINS, TREES, DEPTH, RATE, PENALTY, LEAST_IN_LEAF = 64, 80, 4, 0.15, 1.0, 10
ACCEPT = 0.7
#: Bytes whose share of the text is a feature of its own.
MARKS = b"!|%$&*#.,;:?-_/<>{}()\"'=\n"

_CLASS = np.zeros(256, np.intp)  # 0 other, 1 lower, 2 upper, 3 digit, 4 high, then MARKS
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1], _CLASS[128:] = 1, 2, 3, 4
_CLASS[list(MARKS)] = 5 + np.arange(len(MARKS))
_KINDS = 5 + len(MARKS)


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of features per text; all are finite, also for texts without words."""
    found = [_statistics(texts[a:b]) for a, b in chunks(texts)]
    return np.concatenate(found) if found else np.zeros((0, _KINDS + 16))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _top_share(keys: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, occurrences of the commonest) per document."""
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])])) if len(k) else np.zeros(0, np.intp)
    top = np.zeros(docs)
    np.maximum.at(top, d[new], np.diff(np.append(new, len(k))))
    return np.bincount(d[new], minlength=docs).astype(float), top


def _statistics(texts: list[bytes]) -> np.ndarray:
    words, n = Words(texts), len(texts)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    text = np.concatenate([np.repeat(np.arange(n), lengths + 1), [n]])[: len(words.buffer) - 1]  # of buffer[1:]
    kinds = np.bincount(text * _KINDS + _CLASS[words.buffer[1:]], minlength=n * _KINDS)[: n * _KINDS].reshape(n, _KINDS).astype(float)
    kinds[:, 5 + MARKS.index(b"\n")] -= 1  # the separator
    size = np.maximum(lengths, 1)[:, None]
    first, count = words.first, np.diff(words.first).astype(float)
    some = np.maximum(count, 1)
    doc = np.repeat(np.arange(n), np.diff(first))
    hashes, width = words.hashes(), words.ends - words.starts
    distinct, top = _top_share(hashes, doc, n)
    sums, start = gram_sums(hashes), np.arange(max(0, len(hashes) - 2))
    start = start[doc[start] == doc[start + 2]] if len(start) else start
    triples, _ = _top_share(grams(sums, start, start + 3), doc[start], n)
    same = np.zeros(len(hashes))
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    kind = _CLASS[words.buffer]
    upper = np.concatenate([[0], np.cumsum(kind == 2)])
    plain = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 4))])
    letters_up, letters_low = upper[words.ends] - upper[words.starts], plain[words.ends] - plain[words.starts]
    last = kind[words.ends - 1]
    mark = np.isin(kind, [5 + MARKS.index(c) for c in b"%$&*#|!"])
    marked = np.concatenate([[0], np.cumsum(mark)])
    shares = [
        _sums(width, first) / some, np.sqrt(np.maximum(0, _sums(width.astype(float) ** 2, first) / some - (_sums(width, first) / some) ** 2)),
        distinct / some, top / some, triples / np.maximum(count - 2, 1), _sums(same, first) / some,
        _sums((letters_up > 1) & (letters_low == 0), first) / some, _sums(letters_up + letters_low == 0, first) / some, _sums(last == 5 + MARKS.index(b"."), first) / some,
        _sums(marked[words.ends] > marked[words.starts], first) / some, _sums(width > 14, first) / some, _sums(width < 3, first) / some,
        np.log1p(count), np.log1p(lengths), kinds[:, 5 + MARKS.index(b"\n")] / some, _longest_run(same, first),
    ]
    return np.column_stack([kinds / size, *shares])


def _longest_run(same: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The most times in a row that a word follows itself, per document."""
    total = np.cumsum(same)
    run = total - np.maximum.accumulate(np.where(same == 0, total, 0)) if len(same) else total
    out = np.zeros(len(first) - 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    np.maximum.at(out, doc, run)
    return np.log1p(out)


@dataclass
class Trees:
    """feature, threshold: (trees, inner nodes) in level order; leaf: (trees, leaves)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row."""
        tree, row = np.arange(len(self.feature))[None, :], np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), np.intp)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        raw = self.base + self.leaf[tree, node - ((1 << DEPTH) - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for labels y of 0 and 1 by second-order boosting of the logistic loss; without labels every score is 0.5."""
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    feature, threshold, leaf = np.zeros((TREES, inner), np.intp), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves))
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    if not len(y):
        return Trees(feature, threshold, leaf, 0.0)
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS, method="lower")) for j in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    raw = np.full(len(y), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.intp)
        for depth in range(DEPTH):
            offset, n = (1 << depth) - 1, 1 << depth
            best = np.zeros(n)
            local = (node - offset) * BINS
            for j, cut in enumerate(cuts):
                at = local + bins[:, j]
                sums = [np.bincount(at, w, n * BINS).reshape(n, BINS) for w in (g, h, None)]
                left = [s.cumsum(axis=1)[:, :-1] for s in sums]
                both = [s.sum(axis=1, keepdims=True) for s in sums]
                right = [w - l for w, l in zip(both, left, strict=True)]
                gain = left[0] ** 2 / (left[1] + PENALTY) + right[0] ** 2 / (right[1] + PENALTY) - both[0] ** 2 / (both[1] + PENALTY)
                gain[(left[2] < LEAST_IN_LEAF) | (right[2] < LEAST_IN_LEAF)] = 0
                k = gain.argmax(axis=1)
                better = np.flatnonzero(gain[np.arange(n), k] > best + 1e-9)
                better = better[k[better] < len(cut)]
                best[better] = gain[better, k[better]]
                feature[t, offset + better], threshold[t, offset + better] = j, cut[k[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        node -= inner
        value = -RATE * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + PENALTY)
        leaf[t] = value
        raw += value[node]
    return Trees(feature, threshold, leaf, base)


def fold(id_col: str = "doc_id", folds: int = 4) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_LABELLED) -> Trees:
    """Trees from the labelled rows outside the held-out fold; of labels that repeat an id, the largest counts."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isNotNull() & (fold("_id") != 2))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(id_col).alias("_id"), whole(text_col).alias("text")).join(F.broadcast(known), "_id")  # at most `most` narrow rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics([t.as_py().encode() for t in batch["text"]])
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_y"], pa.array(list(x), pa.list_(pa.float64()))], ["_id", "_y", "x"])

    kind = rows.schema["_id"].dataType.simpleString()
    found = rows.select("_id", "_y", "text").mapInArrow(run, f"_id {kind}, _y int, x array<double>").orderBy(F.xxhash64("_id"), "_id", "x").limit(most).toArrow()
    y = found["_y"].to_numpy().astype(float)
    return fit(np.array(found["x"].to_pylist(), float).reshape(len(y), -1) if len(y) else np.zeros((0, 0)), y)


def scored(docs: DataFrame, trees: Trees, text_col: str = "text", accept: float | None = None) -> DataFrame:
    """docs with _score, or only the rows of at least `accept`, without it.

    Null counts as empty; empty texts are scored like others. Repeated rows are scored alike. All columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    at, names = docs.columns.index(text_col), docs.columns if accept is not None else [*docs.columns, "_score"]
    plain = docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))])  # names with dots don't go through mapInArrow
    schema = plain.schema if accept is not None else StructType([*plain.schema.fields, StructField("_score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0)]
            for i in range(0, batch.num_rows, 512):  # texts become Python objects a slice at a time
                texts = [(t.as_py() or "").encode() for t in batch.column(at).slice(i, 512)]
                parts.append(shared.value.score(statistics(texts)))
            score = pa.array(np.concatenate(parts))
            yield batch.filter(pc.greater_equal(score, accept)) if accept is not None else pa.RecordBatch.from_arrays([*batch.columns, score], schema.names)

    return spread(plain).mapInArrow(run, schema).toDF(*names)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): a row per row of docs; a null id is not held out.

    Null texts count as empty, and these are scored like others; repeated rows are scored alike; an empty table gives
    an empty result, and without labels every score is 0.5. Other columns aren't read.
    """
    trees = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(id_col) == 2, F.lit(False)).alias("held_out"), whole(text_col).alias("text"))
    score = F.col("_score")
    return scored(rows, trees).select("doc_id", "held_out", score.alias("score"), (score >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns; see quality_scores."""
    return scored(docs, train(docs, labels, id_col, text_col), text_col, ACCEPT)
