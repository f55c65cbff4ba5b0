"""Byte-level BPE by a deterministic tokenization automaton, and decoding by its arc labels.

The automaton reads token ids and accepts just the id sequences that BPE gives. It starts with one state that all
base tokens lead back to. For each merge (u, v) -> w, in order, a gadget is built in: the arcs of u now lead to a copy
of their state that has no arc for v, and wherever u had an arc to a state with an arc for v, an arc for w leads to
where v led. All arcs of a token lead to one state, so the automaton is that target of each token, and for each token
a bit set of the states that have no arc for it: at most (tokens x states / 8) bytes, whatever the data. Each prefix
of a word has one tokenization, so a word is encoded in one run over its bytes with one state per place: of the labels
that end at a place, which a trie with failure links gives, just one has an arc from the state where it starts. Decoding concatenates labels.

The table is compiled once on the driver, written to the shared folder, and mapped or read there by the workers.
"""

from __future__ import annotations

import hashlib
import json
import mmap
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain
from urllib.parse import urlparse

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tatterloom.llm.common import filesystem, shared_dir, spread, trim, whole

#: Letters, numbers and other signs of the texts that are pre-split here; others are by the tokenizers library.
LETTERS, NUMBERS, SIGNS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", "¡-¿×÷–—‘-„…€"
USUAL = re.compile(f"[\t\n\r -~{LETTERS}{NUMBERS}{SIGNS}]*")
#: The pre-splitting pattern of byte-level BPE (fixed value), for those texts.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
MOST_WORDS = 100_000  # kept encodings in a worker, in two generations; the older one then goes


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, and its byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def compile_merges(vocab: dict[str, int], merges: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(target, closed, live): the state that each token leads to; closed[t]'s bit s: state s has no arc for t; tokens that have arcs."""
    n = max(vocab.values()) + 1
    target = np.zeros(n, np.int32)
    live = np.zeros(n, bool)
    made = {a + b for a, b in merges}
    base = [i for t, i in vocab.items() if t not in made]
    live[base] = True
    order = np.array([*base, *(vocab[a + b] for a, b in merges)])  # rows in order of making, so that scans are short
    row = np.empty(n, np.int64)
    row[order] = np.arange(len(order))
    closed = np.zeros((len(order), 256), np.uint8)
    leads = [len(base) + 1]  # tokens that lead to each state; the start is one more
    there = len(base)
    for a, b in merges:
        u, v, w = vocab[a], vocab[b], vocab[a + b]
        there += 1
        state = old = int(target[u])
        if not (live[u] and live[v]) or closed[row[v], old >> 3] >> (old & 7) & 1:
            continue  # the two never stand side by side, so nothing changes and w has no arcs
        if leads[old] > 1 or u == v:
            state = len(leads)
            if state >> 3 >= closed.shape[1]:
                closed = np.concatenate([closed, np.zeros_like(closed[:, : max(256, closed.shape[1] // 2)])], axis=1)
            copied = (closed[:there, old >> 3] >> (old & 7) & 1) << (state & 7)
            closed[:there, state >> 3] |= copied.astype(np.uint8)
            leads.append(1)
            leads[old] -= 1
            target[u] = state
        closed[row[v], state >> 3] |= 1 << (state & 7)
        closed[row[w]] = closed[row[u]]
        target[w] = old if u == v else target[v]
        leads[target[w]] += 1
        live[w] = True
    closed = closed[:, : (len(leads) + 7) >> 3]
    full = np.full((n, closed.shape[1]), 0xFF, np.uint8)
    full[order] = closed
    return target, full, live


class Encodings(dict):
    """The ids of words, made by `make` when first asked for; of half of MOST_WORDS and more only those asked for again stay."""

    def __init__(self, make: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MOST_WORDS // 2:
            self.old = self.copy()
            self.clear()
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        self[word] = ids
        return ids


class Automaton:
    """The compiled tables in a worker, with encoding and decoding."""

    def __init__(self, spec: dict, closed: memoryview | bytes):
        self.closed, width, target = closed, spec["width"], spec["target"].tolist()
        self.labels: list[bytes] = spec["labels"]
        self.special: dict[str, int] = spec["special"]
        self.arcs = ahocorasick.Automaton()
        for i in np.flatnonzero(spec["live"]).tolist():
            self.arcs.add_word(self.labels[i].decode("latin-1"), (i, len(self.labels[i]), i * width, target[i]))
        self.arcs.make_automaton()
        self.found = Encodings(lambda w: self.word(w.encode()))
        self.at_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.chars = byte_chars()
        self.slow = None

    def word(self, data: bytes) -> tuple[int, ...]:
        """The ids of a pre-split word: of the labels that end at a place, one has an arc from the state where it starts."""
        n, closed = len(data), self.closed
        state, last = [-1] * n + [0], [None] * n  # after each place; the start's is at -1
        for end, token in self.arcs.iter(data.decode("latin-1")):
            if state[end] < 0:
                _, size, row, to = token
                s = state[end - size]
                if s >= 0 and not closed[row + (s >> 3)] >> (s & 7) & 1:
                    state[end], last[end] = to, token
        if n and state[n - 1] < 0:
            raise ValueError(f"the vocabulary has no tokens for {data!r}")
        ids, at = [], n - 1
        while at >= 0:
            t, size, _, _ = last[at]
            ids.append(t)
            at -= size
        return tuple(ids[::-1])

    def pre_split(self, text: str) -> list[str]:
        if USUAL.fullmatch(text):
            return SPLIT.findall(text)
        if self.slow is None:
            from tokenizers import pre_tokenizers

            self.slow = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        back = self.chars
        return [bytes(back[c] for c in w).decode() for w, _ in self.slow.pre_tokenize_str(text)]

    def encode(self, text: str) -> list[int]:
        """The ids of a text; special tokens in it are their own ids."""
        if self.at_special and any(t in text for t in self.special):
            return list(chain.from_iterable([self.special[p]] if p in self.special else self.encode(p) for p in self.at_special.split(text) if p))
        return list(chain.from_iterable(map(self.found.__getitem__, self.pre_split(text))))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


@cache
def _compiled(path: str) -> tuple[dict, bytes]:
    """The tables of a tokenizer file, by its merges alone; the bits are packed, as the driver keeps them."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model["type"] != "BPE" or model.get("ignore_merges"):
        raise ValueError(f"{path} isn't a plain byte-level BPE")
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} has added tokens of another kind")
    vocab = model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    target, closed, live = compile_merges({t: i for t, i in vocab.items() if t not in added}, merges)
    chars = byte_chars()
    labels = [b""] * (max([*vocab.values(), *added.values()]) + 1)
    for t, i in vocab.items():
        labels[i] = bytes(chars[c] for c in t) if t not in added else t.encode()
    for t, i in added.items():
        labels[i] = t.encode()
    return {"width": closed.shape[1], "target": target, "labels": labels, "special": added, "live": live}, zlib.compress(closed, 1)


def local_automaton(path: str) -> Automaton:
    """For use on one machine."""
    spec, packed = _compiled(path)
    return Automaton(spec, zlib.decompress(packed))


HELD: dict[str, Automaton] = {}  # a worker's last one


def _worker(uri: str, spec) -> Automaton:
    """A worker's automaton; spec is the broadcast variable."""
    if uri not in HELD:
        HELD.clear()
        trim()
        HELD[uri] = _opened(uri, spec.value)
    return HELD[uri]


def _opened(uri: str, spec: dict) -> Automaton:
    fs, path = filesystem(uri)
    if urlparse(uri).scheme in ("", "file"):
        with open(path, "rb") as f:
            return Automaton(spec, memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))
    with fs.open_input_file(path) as f:
        return Automaton(spec, memoryview(f.read_buffer()))


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string): a row per row of docs.

    ids are what BPE with the tokenizer file at `tokenizer` gives for the whole text, without added ones; null counts
    as empty, and an empty text has no ids. Repeated rows give repeated rows, an empty table an empty result; other
    columns aren't read. A character that the vocabulary lacks a byte for raises ValueError.
    """
    return _mapped(docs, tokenizer, id_col, text_col, "ids array<int>, decoded string", lambda ids, text: (ids, text))


def encoded_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encoded(), with n_tokens, ids_sha256 (decimal ids joined by commas) and decoded_sha256 in place of the lists."""

    def digest(ids: list[int], text: str) -> tuple:
        line = ",".join(map(str, ids))
        return len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _mapped(docs, tokenizer, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


def tokenized(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encoded_digests(), with the ids too."""

    def both(ids: list[int], text: str) -> tuple:
        line = ",".join(map(str, ids))
        return ids, len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _mapped(docs, tokenizer, id_col, text_col, "ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string", both)


def _mapped(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, columns: str, out) -> DataFrame:
    spark = docs.sparkSession
    spec, packed = _compiled(tokenizer)
    uri = shared_dir(spark, "automaton")
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path) as f:
        bits = zlib.decompressobj()
        while packed:
            f.write(bits.decompress(packed, 1 << 20))
            packed = bits.unconsumed_tail
        f.write(bits.flush())
    shared = spark.sparkContext.broadcast(spec)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {columns}"
    names = [c.strip().split(" ")[0] for c in columns.split(", ")]
    types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _worker(uri, shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                made = []
                for t in part["text"]:
                    ids = own.encode(t.as_py())
                    made.append(out(ids, own.decode(ids)))
                cols = [pa.array(list(c), types.get(n, pa.string())) for n, c in zip(names, zip(*made, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *cols], ["doc_id", *names])

    return spread(rows).mapInArrow(run, schema)
