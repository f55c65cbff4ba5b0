"""Substring dedup over a log-structured index of window fingerprints.

A window is WINDOW words. Of the hashes of its GRAM-word grams the least (the first of equals) is its anchor, so
equal windows have equal anchors at one place in them, and windows in a row share an anchor: an occurrence is a run
of windows with one anchor, some fourteen on average. Its fingerprint is the anchor's hash, and a second hash of all
words that its windows cover verifies it.

The index is a folder: a log of batches of documents with their occurrences, and of runs, immutable tables
(anchor, cover, n) without repeats, in buckets of the anchor, each sorted. A batch becomes a run; runs of like sizes are
merge-joined into one, bucket by bucket without a shuffle, which adds up n. A manifest names what counts, so an index
can be opened again and given later batches. Occurrences of any batches are looked up in the runs, merged into one:

* its (anchor, cover) is there twice or more: all its windows repeat;
* it is there once and no other cover has its anchor: none does;
* otherwise its windows are hashed one by one and counted, with one occurrence of each other cover of the anchor.

What was found goes back to the documents without shuffling their texts: it is written in blocks by the file and row
that the documents were read from, and a scan of the documents takes its rows' blocks along.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tatterloom.llm.common import filesystem, input_bytes, place, shared_dir, spread, stored, whole, with_groups, written
from tatterloom.llm.textnum import Words, chunks, gram_sums, grams

WINDOW, GRAM = 35, 8
BATCHES = 2
BLOCK_BITS = 14  # rows of a file in a block of side data
_SPAN = 32  # a span is first window * _SPAN + (last - first); an anchor has at most WINDOW - GRAM + 1 = 28 windows


def with_places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, file, row): where each row of a stored table is."""
    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"), *place(docs))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """For each place, that of the least of h in the next `width`, the first of equals."""
    best, at, w = h, np.arange(len(h)), 1
    while w < width and len(best) > 0:
        step = min(w, width - w)
        right = best[step:] < best[: len(best) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        best = np.minimum(best[step:], best[: len(best) - step])
        w += step
    return at


def occurrences(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor, cover) of all occurrences, windows counted in their text."""
    words = Words(texts)
    n = len(words.starts)
    counts = np.diff(words.first)
    doc = np.repeat(np.arange(len(texts)), counts)
    if n < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    sums, check = gram_sums(words.hashes()), gram_sums(words.hashes(1), 1)
    place = np.arange(n - GRAM + 1)
    h = grams(sums, place, place + GRAM)
    at = _least(h, WINDOW - GRAM + 1)
    start = np.arange(n - WINDOW + 1)
    start = start[doc[start] == doc[start + WINDOW - 1]]
    anchor = at[start]
    edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.intp)
    first, last = start[edge], start[np.append(edge[1:], len(start)) - 1] if len(edge) else start
    text = doc[first]
    offset = words.first[text]
    return text, first - offset, last - offset, h[anchor[edge]], grams(check, first, last + WINDOW, 1)


def window_hashes(text: bytes, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, two hashes) of the windows of some spans of a text."""
    words = Words([text])
    first, more = spans // _SPAN, spans % _SPAN
    start = np.repeat(first, more + 1) + np.concatenate([np.arange(m + 1) for m in more.tolist()])
    return start, *(grams(gram_sums(words.hashes(f), f), start, start + WINDOW, f) for f in (0, 1))


#: Bucketed tables are joined and read as they lie: by the anchor alone, and in their order.
_AS_STORED = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.autoBroadcastJoinThreshold": "-1"}


@contextmanager
def _as_stored(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in _AS_STORED}
    for k, v in _AS_STORED.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class FingerprintIndex:
    """An index of window fingerprints in a folder; runs of like sizes are merged, so there are at most log2 of them.

    The number of buckets is fixed when an index is made: name one for the size that it will have, of some tens of
    megabytes a bucket. A change writes its tables first and then a new manifest, so a change that fails leaves the
    index as it was. The documents of a batch must stay where they are: windows that differ in part are read again.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None):
        """Opens the index of a folder, or makes one of so many buckets."""
        self.spark, self.folder = spark, folder
        self.fs, self.path = filesystem(folder)
        self.names: dict[str, str] = {}
        found = sorted(f.path for f in self.fs.get_file_info(FileSelector(self.path, allow_not_found=True)) if f.base_name.startswith("manifest-"))
        if found:
            with self.fs.open_input_file(found[-1]) as f:
                self.state = json.loads(f.read())
        else:
            self.fs.create_dir(self.path, recursive=True)
            self.state = {"version": 0, "buckets": buckets or 16, "batches": [], "runs": []}

    def _save(self) -> None:
        self.state["version"] += 1
        with self.fs.open_output_stream(f"{self.path}/manifest-{self.state['version']:09d}") as f:
            f.write(json.dumps(self.state).encode())

    def _run(self, path: str) -> DataFrame:
        """A run as a bucketed table; its name is this session's, its files are the index's."""
        if path not in self.names:
            self.names[path] = f"run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self.names[path]} (anchor BIGINT, cover BIGINT, n BIGINT) USING parquet OPTIONS (path '{path}') CLUSTERED BY (anchor) SORTED BY (anchor, cover) INTO {self.state['buckets']} BUCKETS")
        return self.spark.table(self.names[path])

    def _write_run(self, rows: DataFrame) -> dict:
        path, name = f"{self.folder}/run-{uuid.uuid4().hex}", f"run_{uuid.uuid4().hex}"
        rows.select("anchor", "cover", "n").write.format("parquet").bucketBy(self.state["buckets"], "anchor").sortBy("anchor", "cover").option("path", path).saveAsTable(name)
        self.names[path] = name
        return {"path": path, "rows": self.spark.table(name).count()}

    def add(self, docs: DataFrame, text_col: str = "text") -> int:
        """Takes a stored table's documents as a new batch and merges runs that it has grown to the size of; gives the batch's number."""
        path = f"{self.folder}/batch-{uuid.uuid4().hex}"
        rows = docs.select(whole(text_col).alias("text"), *place(docs))
        _occurrences_of(rows).write.parquet(path)
        run = self.spark.read.parquet(path).groupBy("anchor", "cover").agg(F.count(F.lit(1)).alias("n"))
        self.state["runs"].append(self._write_run(run.repartition(self.state["buckets"], "anchor")))
        self.state["batches"].append({"path": path, "files": sorted(docs.inputFiles()), "text": text_col})
        self._save()
        runs = self.state["runs"]
        while len(runs) > 1 and runs[-2]["rows"] <= 2 * runs[-1]["rows"]:
            self._merge()
        return len(self.state["batches"]) - 1

    def _merge(self) -> None:
        old, new = self.state["runs"][-2:]
        with _as_stored(self.spark):
            run = self._write_run(merged_runs(self._run(old["path"]), self._run(new["path"])))
        self.state["runs"][-2:] = [run]
        self._save()
        for gone in (old, new):
            self.spark.sql(f"DROP TABLE {self.names.pop(gone['path'])}")
            self.fs.delete_dir(filesystem(gone["path"])[1])

    def compact(self) -> None:
        """Merges all runs into one."""
        while len(self.state["runs"]) > 1:
            self._merge()

    def close(self) -> None:
        """Forgets this session's names; the files stay."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names.clear()

    def _occurrences(self, batches: list[int]) -> DataFrame:
        out = None
        for k in batches:
            rows = self.spark.read.parquet(self.state["batches"][k]["path"])
            out = rows if out is None else out.unionByName(rows)
        return out

    def repeated_spans(self, batches: list[int] | None = None) -> DataFrame:
        """(file, row, span): the windows of these batches (of all) whose words start anywhere else in the index too."""
        self.compact()
        every = list(range(len(self.state["batches"])))
        wanted = every if batches is None else sorted(batches)
        path = self.state["runs"][0]["path"]
        with _as_stored(self.spark):
            index = self._run(path)
            if wanted != every:
                index = index.join(self._occurrences(wanted).select("anchor").distinct(), "anchor", "left_semi")
            anchors = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("covers"), F.min("n").alias("least")).where("covers > 1 and least = 1").select("anchor", F.lit(True).alias("mixed"))
            status = index.join(anchors, "anchor", "left").select("anchor", "cover", "n", (F.col("n") > 1).alias("again"), F.coalesce("mixed", F.lit(False)).alias("mixed"))
            status = written(status.where("again or mixed"), "status")
        hits = written(with_groups(self._occurrences(every), status, ["anchor", "cover"], "n", "inner"), "hits")
        own = hits
        if wanted != every:
            mine = self._occurrences(wanted).select("file", "row").distinct()
            own = hits.join(mine, ["file", "row"], "left_semi")
        sure = own.where("again").select("file", "row", "span")
        one = hits.where("mixed").groupBy("anchor", "cover").agg(F.min(F.struct("file", "row", "span")).alias("o"))
        detail = _side(one.select("o.*"), "detail")
        names, windows = ["file", "row", "window", "h0", "h1"], None

        def hashed(docs: list) -> pa.RecordBatch:
            parts = [(f, r, *window_hashes(t.encode(), s)) for _, t, f, r, s in docs]
            cols = [np.concatenate([np.full(len(p[2]), p[0]) for p in parts]), np.concatenate([np.full(len(p[2]), p[1]) for p in parts]), *(np.concatenate([p[k] for p in parts]) for k in (2, 3, 4))]
            return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols], names)

        sources = {(tuple(b["files"]), b["text"]) for b in self.state["batches"]}
        for files, text_col in sorted(sources):
            docs = self.spark.read.parquet(*files)
            rows = docs.select(F.lit(0).alias("doc_id"), whole(text_col).alias("text"), *place(docs))
            found = _scan(rows, detail, "file long, row long, window long, h0 long, h1 long", hashed, True)
            windows = found if windows is None else windows.unionByName(found)
        windows = written(windows.distinct(), "windows")
        again = written(windows.groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "again")
        more = with_groups(windows, again, ["h0", "h1"], "times", "inner").select("file", "row", (F.col("window") * _SPAN).alias("span"))
        if wanted != every:
            more = more.join(mine, ["file", "row"], "left_semi")
        return written(sure.unionByName(more), "spans")


def merged_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two runs as one."""
    joined = old.hint("merge").withColumnRenamed("n", "m").join(new, ["anchor", "cover"], "full")
    return joined.select("anchor", "cover", (F.coalesce("m", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"))


def _side(found: DataFrame, name: str) -> str:
    """Writes (file, row, span) as blocks of side data; gives their folder."""
    path = shared_dir(found.sparkSession, name)
    rows = found.groupBy("file", "row").agg(F.collect_list("span").alias("spans")).withColumn("block", F.shiftright("row", BLOCK_BITS))
    rows.repartition("file", "block").write.partitionBy("file", "block").parquet(path)
    return path


class _Side:
    """A worker's view of side data; keeps the block in use."""

    def __init__(self, folder: str):
        self.fs, self.path = filesystem(folder)
        self.at, self.rows = None, {}

    def get(self, file: int, row: int) -> np.ndarray | None:
        at = (file, row >> BLOCK_BITS)
        if at != self.at:
            self.at, self.rows = at, {}
            for f in self.fs.get_file_info(FileSelector(f"{self.path}/file={at[0]}/block={at[1]}", allow_not_found=True)):
                if f.base_name.endswith(".parquet"):
                    with self.fs.open_input_file(f.path) as source:
                        table = pq.ParquetFile(source).read(["row", "spans"])
                    for r, s in zip(table["row"].to_pylist(), table["spans"], strict=True):
                        self.rows[r] = s.values.to_numpy()
        return self.rows.get(row)


def _scan(rows: DataFrame, folder: str, schema: str, make: Callable[[list[tuple[object, str, int, int, np.ndarray | None]]], pa.RecordBatch], only: bool = False) -> DataFrame:
    """make() over pieces of the documents with their side data; only: documents that have some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = _Side(folder)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                places = list(zip(part["file"].to_pylist(), part["row"].to_pylist(), strict=True))
                spans = [side.get(f, r) for f, r in places]
                some = [k for k, s in enumerate(spans) if s is not None or not only]
                if some:
                    yield make([(part["doc_id"][k].as_py(), part["text"][k].as_py(), *places[k], spans[k]) for k in some])

    return spread(rows).mapInArrow(run, schema)


def _occurrences_of(rows: DataFrame) -> DataFrame:
    """(file, row, span, anchor, cover) of all documents (text, file, row)."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts = [t.as_py().encode() for t in batch["text"]]
            file, row = (batch[c].to_numpy() for c in ("file", "row"))
            for a, b in chunks(texts):
                text, first, last, anchor, cover = occurrences(texts[a:b])
                cols = [file[a:b][text], row[a:b][text], first * _SPAN + last - first, anchor.view(np.int64), cover.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["file", "row", "span", "anchor", "cover"])

    return spread(rows.select("text", "file", "row")).mapInArrow(run, "file long, row long, span long, anchor long, cover long")


def kept_words(text: str, spans: np.ndarray | None) -> tuple[list[bytes], int]:
    """(the words that stay, how many there were)."""
    words = text.encode().split()
    if spans is None:
        return words, len(words)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, spans // _SPAN, 1)
    np.add.at(steps, spans // _SPAN + spans % _SPAN + WINDOW, -1)
    stay = np.flatnonzero(np.cumsum(steps)[:-1] == 0).tolist()
    return [words[k] for k in stay], len(words)


def _result(docs: DataFrame, id_col: str, text_col: str, batches: int, columns: dict[str, str], out: Callable[[list[bytes], int], tuple]) -> DataFrame:
    docs = stored(docs)
    spark = docs.sparkSession
    index = FingerprintIndex(spark, shared_dir(spark, "index"), max(16, input_bytes(docs) >> 24))
    share = F.pmod(F.xxhash64(*place(docs)), F.lit(batches))
    for k in range(batches):
        index.add(docs.where(share == k), text_col)
    side = _side(index.repeated_spans(), "removed")
    index.close()
    rows = with_places(docs, id_col, text_col)
    arrow = {"long": pa.int64(), "string": pa.string()}

    def make(found: list) -> pa.RecordBatch:
        made = [out(*kept_words(t, s)) for _, t, _, _, s in found]
        cols = [pa.array([m[k] for m in made], arrow[kind]) for k, kind in enumerate(columns.values())]
        return pa.RecordBatch.from_arrays([pa.array([d for d, *_ in found], ids), *cols], ["doc_id", *columns])

    ids = to_arrow_type(rows.schema["doc_id"].dataType)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return _scan(rows, side, ", ".join([f"doc_id {kind}", *(f"{c} {t}" for c, t in columns.items())]), make)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): a row per row of docs; kept holds the words that stay, joined by one space.

    Each word covered by a window whose words start anywhere else, also in the same text, is removed; windows are
    judged on the input. Null counts as empty; texts of fewer words than a window stay whole; repeated rows repeat
    each other's windows, so of theirs none stays. An empty table gives an empty result; other columns aren't read.
    """
    return _result(docs, id_col, text_col, batches, {"n_words": "long", "n_removed": "long", "kept": "string"}, lambda kept, n: (n, n - len(kept), b" ".join(kept).decode()))


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """As without_repeats(), with kept_sha256 in place of kept."""
    return _result(docs, id_col, text_col, batches, {"n_words": "long", "n_removed": "long", "kept_sha256": "string"}, lambda kept, n: (n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
