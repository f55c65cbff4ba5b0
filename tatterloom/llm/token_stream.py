"""Token ids as Arrow IPC files of equal-length sequences with masks, and reading documents back from them.

Documents are dealt by ranges of their order and sorted; each range becomes one file, encoded as it is written. A
file holds record batches of ROWS rows: `ids`, a fixed-size list of LENGTH ids, and `mask`, a fixed-size list of as many
booleans that are true for tokens and false for the filling of a file's last row. The masked-in ids of all files in
name order are the corpus's token stream in document order. As lists are of fixed size, sequence k of a file is at
a known place of a known batch: a reader maps the file and takes it without a copy. A sidecar table holds each
document's file, place in it and number of ids. A file's name carries its range and the attempt that wrote it, and
only the attempts whose sidecar rows Spark commits count, so a lost executor leaves at most an unused file.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tatterloom.llm.common import filesystem, input_bytes, shared_dir, whole, written

LENGTH, ROWS = 2048, 64
END = 1
MOST_WORDS = 800_000  # kept encodings in a worker; then it starts anew
RANGE_BYTES = 64 << 20  # of input in a file
#: Ranges grow with the input up to this, so that 100 TB have 400,000 files, of whose sizes the driver holds a row each.
MOST_RANGE_BYTES = 256 << 20


#: Letters and numbers of the texts whose pieces are found here: characters that normalising leaves alone but for case.
LETTERS, NUMBERS, SIGNS = "A-Za-zªµºÀ-ÖØ-öø-ÿĀ-įı-ſ", "0-9²³¹¼½¾", "¡-¿×÷–—‘-„…€"
USUAL = re.compile(f"[\t\n\r -~{LETTERS}{NUMBERS}{SIGNS}]*")
#: The pre-splitting pattern of the word-end kind (fixed value), for those texts in lower case.
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
WORD_END = "</w>"


class Encoder:
    """A tokenizer file's ids by the tokenizers library, a piece's kept once found.

    For tokenizers of the word-end kind, which lower-case, drop white space and mark each piece's last token: the ids of
    a text are those of its pieces, one after another. New pieces are encoded together and told apart by their last
    tokens. Texts of other characters, or that may hold special tokens, go by their parts between ASCII white space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.last[k] = token.endswith(WORD_END)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.found: dict[str, bytes] = {}

    def _one_by_one(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _together(self, pieces: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, self.type)
        ends = ((np.flatnonzero(self.last[ids]) + 1) * self.type.itemsize).tolist()
        if len(ends) != len(pieces):
            return self._one_by_one(pieces)
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, text: str) -> bytes:
        """The ids as packed numbers of self.type."""
        usual = USUAL.fullmatch(text) and not any(t in text for t in self.special)
        parts, found = PIECE.findall(text.lower()) if usual else [w.decode() for w in text.encode().split()], self.found
        if not usual:
            return b"".join(self._one_by_one(parts))
        try:
            return b"".join(map(found.__getitem__, parts))
        except KeyError:
            if len(found) + len(parts) > MOST_WORDS:
                found.clear()
            new = [w for w in dict.fromkeys(parts) if w not in found]
            found.update(zip(new, self._together(new), strict=True))
            return b"".join(map(found.__getitem__, parts))


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def schema(kind: np.dtype, length: int = LENGTH) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind.newbyteorder("=")), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Takes ids in pieces and writes full record batches as they come."""

    def __init__(self, sink, kind: np.dtype, length: int = LENGTH, rows: int = ROWS):
        self.kind, self.length, self.rows, self.schema = kind, length, rows, schema(kind, length)
        self.file = pa.ipc.new_file(sink, self.schema)
        self.held: list[bytes] = []
        self.size = self.total = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        self.total += len(ids) // self.kind.itemsize
        if self.size >= 16 * (full := self.rows * self.length * self.kind.itemsize):
            data = b"".join(self.held)
            cut = len(data) - len(data) % full
            self._write(np.frombuffer(data[:cut], self.kind))
            self.held, self.size = [data[cut:]], len(data) - cut

    def _write(self, ids: np.ndarray) -> None:
        for start in range(0, len(ids), self.rows * self.length):
            part = ids[start : start + self.rows * self.length]
            n = -(-len(part) // self.length) * self.length
            values = np.zeros(n, self.kind)
            values[: len(part)] = part
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (values, np.arange(n) < len(part))]
            self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        self._write(np.frombuffer(b"".join(self.held), self.kind))
        self.file.close()


class SequenceReader:
    """Random access to a file's sequences; a mapped file's are not copied."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.source = pa.memory_map(path) if urlparse(uri).scheme in ("", "file") else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.last: tuple[int, pa.RecordBatch | None] = (-1, None)
        self.rows = len(self._batch(0)) if self.file.num_record_batches else 1

    def _batch(self, k: int) -> pa.RecordBatch:
        if self.last[0] != k:
            self.last = (k, self.file.get_batch(k))
        return self.last[1]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence k."""
        batch, row = self._batch(k // self.rows), k % self.rows
        return tuple(batch[c].flatten()[row * self.length : (row + 1) * self.length].to_numpy(zero_copy_only=c == "ids") for c in ("ids", "mask"))

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """ids start to start + n of the file's stream, in pieces."""
        size = self.rows * self.length
        while n > 0:
            ids = self._batch(start // size)["ids"].flatten().to_numpy()
            part = ids[start % size : start % size + n]
            if not len(part):
                raise ValueError("the file ends before the span")
            yield part
            start, n = start + len(part), n - len(part)


def write_stream(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Writes the files; returns the sidecar (file, part, doc_id, place, n_tokens), a row per row of docs.

    Null texts count as empty: their only id is the end id. Documents with one id, also null, stand in the order of
    their texts' hashes. Other columns aren't read; an empty table gives no sequences and an empty sidecar.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession, "tokens")
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    text = whole(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("uid"))
    size = input_bytes(docs)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // min(MOST_RANGE_BYTES, max(RANGE_BYTES, size >> 12))))
    rows = rows.repartitionByRange(n, "doc_id", "hash", "uid").sortWithinPartitions("doc_id", "hash", "uid").withColumn("part", F.spark_partition_id()).drop("hash", "uid")
    names = ["file", "part", "doc_id", "place", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer, sink, name = _encoder(tokenizer), None, None, ""
        closing = np.array([end], own.type).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                name = f"{batch['part'][0].as_py():08d}-{uuid.uuid4().hex}.arrow"
                sink = fs.open_output_stream(f"{path}/{name}")
                writer = SequenceWriter(sink, own.type)
            places, sizes = [], []
            for t in batch["text"]:
                places.append(writer.total)
                writer.add(own.encode(t.as_py()) + closing)
                sizes.append(writer.total - places[-1])
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * len(places)), batch["part"], batch["doc_id"], pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], names)
        if writer is not None:
            writer.close()
            sink.close()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(run, f"file string, part int, doc_id {kind}, place long, n_tokens long"), "sidecar")


def read_stream(sidecar: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): per document, from the files; start counts the ids before it in all files."""
    spark = sidecar.sparkSession
    sizes = sidecar.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per file
    before = accumulate((r["n"] for r in sizes), initial=0)
    starts = spark.createDataFrame([(r["part"], b) for r, b in zip(sizes, before, strict=False)], "part int, before long")
    files = sidecar.join(F.broadcast(starts), "part").select("file", "doc_id", "place", "n_tokens", (F.col("before") + F.col("place")).alias("start"))
    files = files.repartition(max(1, len(sizes)), "file").sortWithinPartitions("file", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            sums = []
            for f, place, n in zip(batch["file"].to_pylist(), batch["place"].to_pylist(), batch["n_tokens"].to_pylist(), strict=True):
                if f != name:
                    name, reader = f, SequenceReader(f)
                crc = 0
                for part in reader.span(place, n):
                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], batch["n_tokens"], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    kind = sidecar.schema["doc_id"].dataType.simpleString()
    return files.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
