"""An interpolated modified Kneser-Ney model of word sequences, counted in Spark and mapped by the workers that score.

A pass over the training texts per order. The first counts words by 64-bit hashes: each task sorts and combines what
it has and deals it out by hash range, so the buckets' sorted arrays are one sorted array, and a word's place in it is
its number. Pass k counts sequences of k words as (context, word): the number of the k - 1 words before, and the
word's. Buckets are ranges of (context, word) that hold like numbers of tokens, so a context that precedes a third of
all words is spread over many. A bucket's file holds the words after each context, sorted, and where each context's
words begin; a sequence's place in these is its number, which the next order's contexts are. The longest sequences
keep their counts; shorter ones get the number of different words before them, counted from the next order, and
those that begin a text, which have none, keep their counts.

Scoring maps these files and looks up each piece's distinct words and sequences, in the buckets that occur, by binary
search. Everything that is gathered is on disk and grows with the corpus; files are named by their bucket's number,
and the driver holds a few numbers per bucket. A bucket grows with the input from LEAST_BYTES to MOST_BYTES of text,
so 100 TB have some three million. Each piece of text meets all buckets, so there are few of them: from 2 to 16 GB some
500 an order, and buckets that would hold few tokens are one.
"""

from __future__ import annotations

import mmap
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tatterloom.llm.common import discard, filesystem, input_bytes, shared_dir, spread, trim, whole, written
from tatterloom.llm.textnum import Words

END = np.uint64(0x0E0D0E0D0E0D0E0D)  # the end's hash
ORDER = 3
LEAST_BYTES, MOST_BYTES, LEAST_BUCKETS = 4 << 20, 32 << 20, 16
HELD = 1_000_000  # entries that a task holds before it combines them
PIECE = 2 << 20  # of text that is looked up at once
MANY = 32  # words after a context; if there are more, its sums are stored
MERGED = 8  # words of a context per pair that is looked up; if there are more, the pairs are searched one by one
SMOOTH = 0.1  # of the base score


def held_out(id_col: str = "doc_id", folds: int = 10) -> Column:
    """Whether crc32 of the id as text, modulo folds, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


MAPS: dict[str, mmap.mmap] = {}


def mapped(uri: str) -> memoryview:
    """A file's bytes: mapped if it is in a mounted folder, else read."""
    fs, path = filesystem(uri)
    if urlparse(uri).scheme in ("", "file"):
        with open(path, "rb") as f:
            MAPS[uri] = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            return memoryview(MAPS[uri])
    with fs.open_input_file(path) as f:
        return memoryview(f.read_buffer())


def let_go() -> None:
    """Gives the mapped pages back, so that a worker's memory doesn't grow to the model's size; the system still caches them."""
    for m in MAPS.values():
        m.madvise(mmap.MADV_DONTNEED)


def pieces(column: pa.Array, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, lower-cased texts) of pieces of about `most` bytes, one of which is held at a time; a longer text stands alone."""
    start, texts, size = 0, [], 0
    for k, t in enumerate(column):
        x = t.as_py().encode().lower()
        if size and size + len(x) > most:
            yield start, texts
            start, texts, size = k, [], 0
        texts.append(x)
        size += len(x) + 1
    if texts:
        yield start, texts


def store(uri: str, *data: np.ndarray) -> None:
    """Writes some arrays as one file, which replaces one of that name: a task that runs again writes the same."""
    head = ",".join(f"{a.dtype.str}:{len(a)}" for a in data).encode()
    fs, path = filesystem(uri)
    aside = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as f:
        f.write(len(head).to_bytes(8, "little") + head + bytes(-len(head) % 8))
        for a in data:
            f.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))
    fs.move(aside, path)


@lru_cache(None)  # views of what is mapped
def arrays(uri: str) -> tuple[np.ndarray, ...]:
    """What store() wrote."""
    data = mapped(uri)
    n = int.from_bytes(data[:8], "little")
    out, at = [], 8 + -(-n // 8) * 8
    for kind, size in (x.split(":") for x in bytes(data[8 : 8 + n]).decode().split(",")):
        out.append(np.frombuffer(data, kind, int(size), at))
        at += -(-out[-1].nbytes // 8) * 8
    return tuple(out)


def packed(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts as bytes; where a byte is 0, the places and counts of those that need more."""
    large = np.flatnonzero((counts > 255) | (counts == 0))
    return np.where((counts > 255) | (counts == 0), 0, counts).astype(np.uint8), large, counts[large]


def unpacked(small: np.ndarray, large_at: np.ndarray, large: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = small[places].astype(np.int64)
    big = np.flatnonzero(out == 0)
    if len(big):
        out[big] = large[np.searchsorted(large_at, places[big])]
    return out


def sorting(hi: np.ndarray, lo: np.ndarray, kind: str | None = None) -> np.ndarray:
    """The order of pairs of uint64, by one key if they fit in it; kind "stable" is the faster one for sorted runs."""
    if not len(hi):
        return np.zeros(0, np.intp)
    bits = int(lo.max()).bit_length()
    if int(hi.max()).bit_length() + bits <= 64 and bits < 64:
        return np.argsort((hi << np.uint64(bits)) | lo, kind=kind)  # equal pairs are alike, so any order of them does
    return np.lexsort((lo, hi))


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where a sorted sequence of keys changes."""
    if not len(keys[0]):
        return np.zeros(0, np.intp)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def counted(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs and how often they occur; sorts one key if they fit in it, which is faster than an order."""
    bits = int(lo.max()).bit_length() if len(lo) else 64
    if bits == 64 or int(hi.max()).bit_length() + bits > 64:
        return combined(hi, lo, np.ones(len(hi), np.int64))
    key = np.sort((hi << np.uint64(bits)) | lo)
    first = firsts(key)
    key, times = key[first], np.diff(np.append(first, len(key)))
    return key >> np.uint64(bits), key & np.uint64((1 << bits) - 1), times


def combined(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct pairs and their summed counts, of pairs in sorted runs."""
    order = sorting(hi, lo, "stable")
    hi, lo, counts = hi[order], lo[order], counts[order]
    first = firsts(hi, lo)
    return hi[first], lo[first], np.add.reduceat(counts, first) if len(first) else counts


def planes(x: np.ndarray, ascending: bool = False) -> bytes:
    """All first bytes, then all second ones ... of 64-bit numbers, or of their steps: most planes are zeros, which shuffles squeeze."""
    x = x.astype(np.uint64)
    return (np.diff(x, prepend=np.uint64(0)) if ascending else x).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(data: bytes, ascending: bool = False) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    x = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if ascending else x


class Counter:
    """A task's counts of pairs, combined when there are many and given out when they still are."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0
        self.most = HELD

    def add(self, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray | None = None) -> bool:
        """Whether take() is due."""
        if counts is None:
            hi, lo, counts = counted(hi, lo)
        self.held.append((hi, lo, counts))
        self.size += len(hi)
        if self.size > self.most:
            self.held = [combined(*map(np.concatenate, zip(*self.held, strict=True)))]
            self.size = len(self.held[0][0])
            self.most = max(HELD, self.size + self.size // 2)  # else over HELD different pairs are sorted again for each few that come
        return self.size > HELD * 0.75

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        found = combined(*map(np.concatenate, zip(none, *self.held, strict=True)))
        self.held, self.size, self.most = [], 0, HELD
        return found


@dataclass
class Bounds:
    """The least (context, word) of each bucket, ascending; a context may have several, which share its words."""

    hi: np.ndarray
    lo: np.ndarray

    def bucket(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        a, b = np.searchsorted(self.hi, hi), np.searchsorted(self.hi, hi, "right")
        out = a - 1 + ((b > a) & (self.lo[np.minimum(a, len(self.lo) - 1)] <= lo))
        many = np.flatnonzero(b > a + 1)
        cut = np.append(firsts(a[many]), len(many)).tolist()
        for x, y in zip(cut[:-1], cut[1:], strict=True):  # runs of one context, whose buckets are the same
            at = many[x:y]
            out[at] = a[at] - 1 + np.searchsorted(self.lo[a[at[0]] : b[at[0]]], lo[at], "right")
        return out


def dealt(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, bounds: Bounds) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, hi, lo, counts) of sorted pairs."""
    if len(hi):
        bucket = bounds.bucket(hi, lo)
        cut = np.append(firsts(bucket), len(hi))
        parts = [(int(bucket[a]), planes(hi[a:b], True), planes(lo[a:b]), planes(counts[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in parts], pa.binary() if k else pa.int32()) for k in range(4)], ["bucket", "hi", "lo", "counts"])


DEALT = "bucket int, hi binary, lo binary, counts binary"


def _counted(rows: DataFrame, count: Callable[[list[bytes], Counter], bool], bounds: Bounds) -> DataFrame:
    """DEALT rows of what `count` adds to a counter for pieces of the texts of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        counter = Counter()
        for batch in batches:
            for _, texts in pieces(batch["text"], PIECE):
                if count(texts, counter):
                    yield from dealt(*counter.take(), bounds)
                let_go()
        yield from dealt(*counter.take(), bounds)

    return spread(rows).mapInArrow(run, DEALT)


MADE = "bucket int, hi binary, lo binary, counts binary, about array<long>"
_TYPES = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]


def _reduced(rows: DataFrame, buckets: int, make: Callable[..., Iterator[tuple]], name: str) -> DataFrame:
    """A written table of the MADE rows of make(bucket, hi, lo, counts) over each bucket's combined pairs, a bucket at a time."""

    def done(bucket: int, counter: Counter) -> Iterator[pa.RecordBatch]:
        for row in make(bucket, *counter.take()):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES, strict=True)], ["bucket", "hi", "lo", "counts", "about"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        at, counter = None, Counter()
        for batch in batches:
            for bucket, hi, lo, counts in zip(batch["bucket"].to_pylist(), batch["hi"], batch["lo"], batch["counts"], strict=True):
                if bucket != at and at is not None:
                    yield from done(at, counter)
                at = bucket
                counter.add(unplaned(hi.as_py(), True), unplaned(lo.as_py()), unplaned(counts.as_py()).astype(np.int64))
        if at is not None:
            yield from done(at, counter)

    return written(rows.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, MADE), name)


def _about(made: DataFrame) -> list[tuple[int, list[int]]]:
    """(bucket, about) of the rows that have it: one per bucket."""
    return sorted((r["bucket"], r["about"]) for r in made.where("about is not null").select("bucket", "about").collect())


@dataclass
class Order:
    """Sequences of one length: their buckets, the first number of each, how many there are, and where those that begin a text start."""

    bounds: Bounds
    offset: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    size: int = 0
    opening: int = 0
    discount: tuple[float, ...] = (0.5, 1.0, 1.5)
    split: dict[int, list[int]] = field(default_factory=dict)  # contexts in several buckets: total, and words that follow once, twice, oftener


@dataclass
class Model:
    """Where the files are, and the few numbers that scoring needs."""

    folder: str
    order: int
    word_bounds: np.ndarray
    word_offset: np.ndarray
    tokens: int
    distinct: int
    orders: dict[int, Order] = field(default_factory=dict)  # from 2
    word_discount: tuple[float, ...] = (0.5, 1.0, 1.5)
    spare: float = 1.0  # the words' share that goes to the uniform distribution
    pairs: int = 0

    def file(self, kind: str, order: int, bucket: int) -> tuple[np.ndarray, ...]:
        return arrays(f"{self.folder}/{kind}-{order}-{bucket}")

    def words(self, hashes: np.ndarray, counts: bool = False) -> tuple[np.ndarray, ...]:
        """(number,) of each hash, -1 for unknown words; with counts, (number, count, how many contexts it follows)."""
        keys, back = np.unique(hashes, return_inverse=True)
        number, count, before = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for k, part in _by_bucket(np.searchsorted(self.word_bounds, keys, "right") - 1):
            if self.word_offset[k + 1] > self.word_offset[k]:
                known, *n = self.file("words", 1, k)
                place = np.minimum(np.searchsorted(known, keys[part]), len(known) - 1)
                hit = known[place] == keys[part]
                number[part] = np.where(hit, self.word_offset[k] + place, -1)
                if counts:
                    count[part] = np.where(hit, unpacked(*n, place), 0)
                    if self.pairs:
                        before[part] = np.where(hit, unpacked(*self.file("before", 1, k), place), 0)
        return (number[back], count[back], before[back]) if counts else (number[back],)

    def find(self, n: int, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The numbers of the n-word sequences of ascending pairs (context, word); -1 for those that don't occur."""
        of, out = self.orders[n], np.full(len(hi), -1, np.int64)
        if of.size:
            for k, part in _by_bucket(of.bounds.bucket(hi, lo)):
                if of.offset[k + 1] > of.offset[k]:
                    words, *begin = self.file("next", n, k)
                    place = _places(words, begin, hi[part], lo[part])[0]
                    out[part] = np.where(place >= 0, of.offset[k] + place, -1)
        return out

    def shares(self, n: int, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, share, rest) of the n-word sequences of ascending pairs: find(), what the word has of its context, and what order n - 1 gets."""
        of, number = self.orders[n], np.full(len(hi), -1, np.int64)
        own, total, spare = np.zeros(len(hi)), np.zeros(len(hi)), np.zeros(len(hi))
        d = np.array([0.0, *of.discount])
        for k, part in _by_bucket(of.bounds.bucket(hi, lo)) if of.size else ():
            if of.offset[k + 1] == of.offset[k]:
                continue
            words, *begin = self.file("next", n, k)
            small, large_at, large, many, kept = self.file("counts", n, k)
            place, new, asked, a, b = _places(words, begin, hi[part], lo[part])
            hit = np.flatnonzero(place >= 0)
            c = unpacked(small, large_at, large, place[hit])
            at = np.arange(part.start, part.stop)[hit] if isinstance(part, slice) else part[hit]
            number[at], own[at] = of.offset[k] + place[hit], c - d[np.minimum(c, 3)]
            sums, short = np.zeros((len(new), 4), np.int64), b - a <= MANY
            sums[short] = _sums(unpacked(small, large_at, large, _spread(a[short], b[short])), (b - a)[short])
            if not short.all():
                sums[~short] = kept.reshape(-1, 4)[np.searchsorted(many, hi[part][new[~short]])]
            total[part], spare[part] = np.repeat(sums[:, 0], asked), np.repeat(sums[:, 1:] @ d[1:], asked)
        if of.split:
            ids = np.array(sorted(of.split), np.uint64)
            a, b = np.searchsorted(hi, ids), np.searchsorted(hi, ids, "right")
            for k in np.flatnonzero(b > a).tolist():
                total[a[k] : b[k]], *follow = of.split[int(ids[k])]
                spare[a[k] : b[k]] = np.dot(follow, d[1:])
        safe = np.where(total > 0, total, 1)
        return number, np.maximum(own, 0) / safe, np.where(total > 0, spare / safe, 1)

    def numbers(self, found: np.ndarray, text: np.ndarray, upto: int) -> np.ndarray:
        """The number of the `upto`-word sequence that ends at each token, of known numbers, of training texts, or -1 if it would begin before its text."""
        last = found
        for n in range(2, upto + 1):
            context = self.contexts(n, last, text)
            some = np.flatnonzero(context >= 0)
            last = np.full(len(found), -1, np.int64)
            last[some] = self._found(n, context[some], found[some])
        return last

    def contexts(self, n: int, last: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Contexts of order n: what `last` has for the token before; the number after the last word's where a text begins, of order 2 only."""
        out = np.concatenate([[-1], last[:-1]]) if len(last) else last.copy()
        if len(out):
            first = firsts(text)
            out[first] = self.distinct if n == 2 else -1
        return out

    def _found(self, n: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """find() of each distinct pair once."""
        order, pair, hi, lo = _distinct(context, word)
        out = np.empty(len(order), np.int64)
        out[order] = self.find(n, hi, lo)[pair]
        return out

    def spelled(self, n: int, numbers: np.ndarray) -> np.ndarray:
        """The words of the n-word sequences of these numbers, a row each; a text's begin is the number after the last word's."""
        if n == 1:
            return numbers[:, None]
        of = self.orders[n]
        word, context = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        for k, part in _by_bucket(np.searchsorted(of.offset, numbers, "right") - 1):
            words, first, base, step = self.file("next", n, k)
            place = numbers[part] - of.offset[k]
            word[part] = words[place]
            context[part] = first[0] + np.searchsorted(_starts(base, step), place, "right") - 1
        return np.column_stack([self.spelled(n - 1, context), word])

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(tokens, known tokens, base score, score) of lower-cased texts."""
        hashes, text = token_hashes(texts)
        word, count, before = self.words(hashes, True)
        known = word >= 0
        size = len(texts)
        sums = lambda x: np.bincount(text, x, size)
        totals = np.bincount(text, minlength=size), sums(known).astype(np.int64), sums(np.log10((count + SMOOTH) / (self.tokens + SMOOTH * (self.distinct + 1))))
        p = np.full(len(hashes), 1 / (self.distinct + 1))
        if self.pairs:
            d = np.array([0.0, *self.word_discount])
            p = self.spare * p + np.maximum(before - d[np.minimum(before, 3)], 0) / self.pairs
        del count, before
        last = word
        for n in range(2, self.order + 1):
            if not self.tokens:
                break
            context = self.contexts(n, last, text)
            ask = np.flatnonzero(context >= 0)
            last = np.full(len(hashes), -1, np.int64)
            if not len(ask):
                continue
            # distinct pairs in order, so contexts and numbers ascend too and are sorted once
            order, pair, hi, lo = _distinct(context[ask], np.where(known, word, self.distinct + 1)[ask])
            number, own, rest = self.shares(n, hi, lo)
            at = ask[order]
            p[at] = own[pair] + rest[pair] * p[at]
            last[at] = number[pair]
        return *totals, sums(np.log10(p))


def _distinct(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    """(order, pair, hi, lo): the order that sorts the pairs, of each in that order its distinct pair's place, and the distinct pairs."""
    hi, lo = context.astype(np.uint64), word.astype(np.uint64)
    order = sorting(hi, lo)
    hi, lo = hi[order], lo[order]
    first = firsts(hi, lo)
    return order, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order)))), hi[first], lo[first]


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray | slice]]:
    """(bucket, places) of the buckets that occur."""
    if (bucket[1:] >= bucket[:-1]).all():
        cut = np.append(firsts(bucket), len(bucket))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield int(bucket[a]), slice(a, b)
        return
    order = np.argsort(bucket, kind="stable")
    cut = np.append(firsts(bucket[order]), len(order))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _steps(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending starts as (base of every 256, steps from it)."""
    base = starts[::256]
    step = starts - np.repeat(base, 256)[: len(starts)]
    return base, step.astype(np.uint16 if not len(step) or step.max() < 1 << 16 else np.int64)


def _starts(base: np.ndarray, step: np.ndarray) -> np.ndarray:
    return np.repeat(base, 256)[: len(step)] + step


def _range(begin: list[np.ndarray], contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words after each context begin and end; an empty range for other contexts."""
    first, base, step = begin
    rel = contexts.astype(np.int64) - first[0]
    there = (rel >= 0) & (rel < len(step) - 1)
    rel = np.where(there, rel, 0)
    a, b = (base[r >> 8].astype(np.int64) + step[r] for r in (rel, rel + 1))
    return a, np.where(there, b, a)


def _places(words: np.ndarray, begin: list[np.ndarray], hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, ...]:
    """(place, new, asked, a, b): where ascending pairs (context, word) are in a bucket's words, -1 for those that aren't there;
    where each context begins among the pairs, how many pairs it has, and the range of its words.

    Ranges that aren't much longer than what is asked of them are met with the pairs all at once, those of which much
    is asked are searched one by one, and the others side by side.
    """
    new = firsts(hi)
    asked = np.diff(np.append(new, len(hi)))
    a, b = _range(begin, hi[new])
    of, place, bits = np.repeat(np.arange(len(new)), asked), np.full(len(hi), -1, np.int64), np.uint64(64 - len(new).bit_length())
    few = b - a <= MERGED * asked
    end = np.where(few, b, a)
    at = _spread(a, end)
    if len(at):  # words' numbers have over 40 bits unless a bucket's pairs have over 16 million contexts
        have = (np.repeat(np.arange(len(new), dtype=np.uint64), end - a) << bits) | words[at]
        want = (of.astype(np.uint64) << bits) | lo
        k = np.minimum(np.searchsorted(have, want), len(have) - 1)
        place = np.where(have[k] == want, at[k], -1)
    word = lo.astype(words.dtype)
    hot = ~few & (asked >= MANY)
    for k in np.flatnonzero(hot).tolist():
        own, want = words[a[k] : b[k]], word[new[k] : new[k] + asked[k]]
        there = np.minimum(own.searchsorted(want), len(own) - 1)
        place[new[k] : new[k] + asked[k]] = np.where(own[there] == want, a[k] + there, -1)
    some = np.flatnonzero(~(few | hot)[of])
    if len(some):
        place[some] = _search(words, a[of[some]], b[of[some]], word[some])
    return place, new, asked, a, b


def _search(words: np.ndarray, a: np.ndarray, b: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The place of each word in its ascending range of words, which has some, or -1."""
    size = b - a
    for _ in range(int(size.max() - 1).bit_length()):  # the word is among `size` words from a, if anywhere
        half = size >> 1
        mid = a + half
        a = np.where(words[mid] <= word, mid, a)
        size = size - half
    return np.where(words[a] == word, a, -1)


def _spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All places of some ranges, one range after the other."""
    n = b - a
    return np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())


def _sums(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(total, ones, twos, more) of n[i] counts each, one after the other."""
    out = np.zeros((len(n), 4), np.int64)
    some = np.flatnonzero(n > 0)
    if len(some):
        at = (np.cumsum(n) - n)[some]
        for k, x in enumerate((counts, counts == 1, counts == 2, counts > 2)):
            out[some, k] = np.add.reduceat(x.astype(np.int64), at)
    return out


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each token: a text's words, then the end."""
    words = Words(texts)
    at = words.first[1:]
    hashes = np.insert(words.hashes(), at, END)
    return hashes, np.repeat(np.arange(len(texts)), np.diff(words.first) + 1)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of things that occur once to four times; kept within 0 to 1, 2 and 3."""
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    ratio = lambda a, b: a / b if b else 0.0
    return tuple(float(np.clip(k - (k + 1) * y * ratio(b, a), 0.1 * k, 0.95 * k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def _times(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _cuts(counts: np.ndarray, step: int) -> np.ndarray:
    """Where a running total of counts passes each multiple of step, and the share of that count which lies before."""
    total = np.cumsum(counts)
    at = np.arange(step, total[-1] if len(total) else 0, step)
    place = np.searchsorted(total, at)
    return np.column_stack([place, (at - (total[place] - counts[place])) * 1_000_000 // np.maximum(counts[place], 1)])


def _joined_cuts(buckets: list[tuple[int, int, list[int]]], step: int) -> list[tuple[int, int]]:
    """The cuts that are needed for at most `step` tokens a bucket, of (first number, tokens, what _cuts() gave) of an order's buckets."""
    found, held = [], 0
    for first, tokens, cuts in buckets:
        at = [(first, 0), *((first + c, share) for c, share in zip(cuts[::2], cuts[1::2], strict=True))]
        for k, cut in enumerate(at):
            own = step if k + 1 < len(at) else tokens - k * step
            if held + own > step:
                found.append(cut)
                held = 0
            held += own
    return found


def _next_bounds(cuts: list[tuple[int, int]], words: int) -> Bounds:
    """Buckets of the next order: contexts' shares of a million become shares of the words' numbers, spread evenly by their hashes."""
    pairs = sorted({(0, 0), *((c, share * words // 1_000_000 if share else 0) for c, share in cuts)})
    return Bounds(*(np.array(x, np.uint64) for x in zip(*pairs, strict=True)))


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> Model:
    """A model of all texts of docs, of sequences of up to `order` (2 at least) words; without texts, one that knows no word."""
    spark, rows = docs.sparkSession, docs.select(whole(text_col).alias("text"))
    folder = shared_dir(spark, "model")
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    size = input_bytes(docs)
    bucket_bytes = min(MOST_BYTES, max(LEAST_BYTES, size >> 9))
    buckets, step = max(LEAST_BUCKETS, 1 << (size // (4 * bucket_bytes)).bit_length()), bucket_bytes // 4  # words repeat, so their buckets hold less
    word_bounds = np.arange(buckets, dtype=np.uint64) << np.uint64(65 - buckets.bit_length())

    def words_of(bucket: int, hashes: np.ndarray, _: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        store(f"{folder}/words-1-{bucket}", hashes, *packed(counts))
        yield bucket, None, None, None, [len(hashes), int(counts.sum()), *_cuts(counts, step).ravel().tolist()]

    def words_in(texts: list[bytes], counter: Counter) -> bool:
        hashes, _ = token_hashes(texts)
        return counter.add(hashes, np.zeros(len(hashes), np.uint64))

    about = _about(_reduced(_counted(rows, words_in, Bounds(word_bounds, np.zeros(buckets, np.uint64))), buckets, words_of, "words"))
    sizes = np.zeros(buckets, np.int64)
    for k, found in about:
        sizes[k] = found[0]
    offset = np.concatenate([[0], np.cumsum(sizes)])
    model = Model(folder, order, word_bounds, offset, sum(x[1] for _, x in about), int(offset[-1]))
    if not model.tokens:
        return model
    cuts = _joined_cuts([(int(offset[k]), x[1], x[2:]) for k, x in about], step)
    for n in range(2, order + 1):
        cuts = _add_order(rows, model, n, _next_bounds([*cuts, (model.distinct, 0)] if n == 2 else cuts, model.distinct), step)
    return model


def _add_order(rows: DataFrame, model: Model, n: int, bounds: Bounds, step: int) -> list[tuple[int, int]]:
    """Counts the sequences of n words, and from them what the order before needs; gives the cuts for the next order's buckets."""
    folder, last = model.folder, n == model.order
    opening = model.distinct if n == 2 else model.orders[n - 1].opening
    shared = rows.sparkSession.sparkContext.broadcast(model)
    word_type = np.uint32 if model.distinct + 1 < 1 << 32 else np.uint64  # unknown words are that number plus one

    def sequences_in(texts: list[bytes], counter: Counter) -> bool:
        own = shared.value
        hashes, text = token_hashes(texts)
        (word,) = own.words(hashes)
        context = own.contexts(n, own.numbers(word, text, n - 1), text)
        some = np.flatnonzero(context >= 0)
        return counter.add(context[some].astype(np.uint64), word[some].astype(np.uint64))

    def sequences_of(bucket: int, hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        own = shared.value
        first = int(hi[0])
        begin = np.searchsorted(hi, np.arange(first, int(hi[-1]) + 2, dtype=np.uint64))
        store(f"{folder}/next-{n}-{bucket}", lo.astype(word_type), np.array([first]), *_steps(begin))
        opened = counts[hi >= opening]
        if last:
            done = _keep_counts(folder, n, bucket, counts, first, begin)
        else:  # the others get the number of words before them
            store(f"{folder}/raw-{n}-{bucket}", *packed(opened))
            done = []
        yield bucket, None, None, None, [len(hi), len(opened), len(done), *done, int(counts.sum()), *_cuts(counts, step).ravel().tolist()]
        if n == 2:
            keys, times = np.unique(lo, return_counts=True)
        else:
            new = firsts(hi)
            words = own.spelled(n - 1, hi[new].astype(np.int64))[:, 1:]
            context = words[:, 0]
            for k in range(2, n - 1):
                context = own._found(k, context, words[:, k - 1])
            context = np.repeat(context, np.diff(np.append(new, len(hi))))
            context, word, times = counted(context.astype(np.uint64), lo)
            keys = own.find(n - 1, context, word).astype(np.uint64)
        before = own.word_offset if n == 2 else own.orders[n - 1].offset
        for part in dealt(keys, np.zeros(len(keys), np.uint64), times, Bounds(before[:-1].astype(np.uint64), np.zeros(len(before) - 1, np.uint64))):
            for k in range(part.num_rows):
                yield *(part[c][k].as_py() for c in ("bucket", "hi", "lo", "counts")), None

    buckets = len(bounds.hi)
    made = _reduced(_counted(rows, sequences_in, bounds), buckets, sequences_of, "sequences")
    sizes, opened = np.zeros(buckets, np.int64), 0
    about = _about(made)
    for k, x in about:
        sizes[k], opened = x[0], opened + x[1]
    offset = np.concatenate([[0], np.cumsum(sizes)])
    cuts = _joined_cuts([(int(offset[k]), x[3 + x[2]], x[4 + x[2] :]) for k, x in about], step)
    model.orders[n] = Order(bounds, offset, int(offset[-1]), int(offset[-1]) - opened)
    if n == 2:
        model.pairs = model.orders[2].size
        _words_before(made, model)
    else:
        _settle(model.orders[n - 1], _adjusted(made, model, n - 1))
    if last:
        _settle(model.orders[n], [x[3 : 3 + x[2]] for _, x in about])
    discard(made)
    return cuts


def _words_before(made: DataFrame, model: Model) -> None:
    offset, folder = model.word_offset, model.folder

    def words_of(bucket: int, hi: np.ndarray, _: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        dense = np.zeros(int(offset[bucket + 1] - offset[bucket]), np.int64)
        dense[hi.astype(np.int64) - offset[bucket]] = counts
        store(f"{folder}/before-1-{bucket}", *packed(dense))
        yield bucket, None, None, None, _times(dense)

    found = _about(_reduced(made.where("hi is not null").drop("about"), len(offset) - 1, words_of, "before"))
    ones = [sum(x[k] for _, x in found) for k in range(4)]
    model.word_discount = d = discounts(ones)
    model.spare = (d[0] * ones[0] + d[1] * ones[1] + d[2] * (model.distinct - ones[0] - ones[1])) / model.pairs


def _keep_counts(folder: str, n: int, bucket: int, counts: np.ndarray, first: int, starts: np.ndarray) -> list[int]:
    """Writes a bucket's counts and the sums of its contexts with many words; gives how many counts are 1 to 4, and the outer contexts with their sums."""
    follow = np.diff(starts)
    sums = _sums(counts, follow)
    many = np.flatnonzero(follow > MANY)
    store(f"{folder}/counts-{n}-{bucket}", *packed(counts), (first + many).astype(np.uint64), sums[many].ravel())
    return [*_times(counts), *(x for k in sorted({0, len(follow) - 1}) for x in (first + k, *sums[k].tolist()))]


def _adjusted(made: DataFrame, model: Model, n: int) -> list[list[int]]:
    """Gives the sequences of order n the numbers of words that precede them, which made has; what _keep_counts() gave."""
    of, folder = model.orders[n], model.folder
    offset = of.offset

    def counts_of(bucket: int, hi: np.ndarray, _: np.ndarray, times: np.ndarray) -> Iterator[tuple]:
        counts = np.zeros(int(offset[bucket + 1] - offset[bucket]), np.int64)
        if len(counts):
            counts[hi.astype(np.int64) - offset[bucket]] = times
            raw = arrays(f"{folder}/raw-{n}-{bucket}")
            opened = unpacked(*raw, np.arange(len(raw[0])))
            counts[len(counts) - len(opened) :] = opened  # they come last
            _, first, *begin = arrays(f"{folder}/next-{n}-{bucket}")
            yield bucket, None, None, None, _keep_counts(folder, n, bucket, counts, int(first[0]), _starts(*begin).astype(np.int64))

    # a bucket whose sequences all begin a text has no other rows
    every = made.sparkSession.range(len(of.bounds.hi)).select(F.col("id").cast("int").alias("bucket"), *(F.lit(b"").alias(c) for c in ("hi", "lo", "counts")))
    rows = every.unionByName(made.where("hi is not null").drop("about"))
    return [x for _, x in _about(_reduced(rows, len(of.bounds.hi), counts_of, "counts"))]


def _settle(of: Order, done: list[list[int]]) -> None:
    """Discounts, and the sums of contexts whose words are in several buckets: those with a bound among them."""
    seen: dict[int, list[list[int]]] = {}
    for x in done:
        for k in range(4, len(x), 5):
            seen.setdefault(x[k], []).append(x[k + 1 : k + 5])
    cut = {int(c) for c in of.bounds.hi}
    of.discount = discounts([sum(x[k] for x in done) for k in range(4)])
    of.split = {c: [sum(x) for x in zip(*parts, strict=True)] for c, parts in seen.items() if len(parts) > 1 or c in cut}


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score): a row per row of docs; scores are log10 probabilities."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text"))
    names = ["n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in batches:
            for a, texts in pieces(batch["text"], PIECE):
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, len(texts)), *map(pa.array, shared.value.score(texts))], ["doc_id", *names])
                let_go()

    return spread(rows).mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_known long, base_score double, score double")


def language_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row per row of docs.

    The model learns from the rows that aren't held out. Tokens are lower-cased (A-Z) words between ASCII white
    space and an end; null counts as empty, whose only token is the end. Repeated rows count and are scored each;
    a null id is never held out. An empty table gives an empty result; if all rows are held out, every word is
    unknown. Other columns aren't read.
    """
    model = train(docs.where(~held_out(id_col)), text_col, order)
    found = scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
