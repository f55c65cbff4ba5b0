"""Benchmark decontamination by winnowing, with DataFrame functions only.

Words become 64-bit hashes, and runs of words are hashed by doubling: the hash of 2n words comes from the two of n
words, so each length takes one pass over an array. Of every WINDOWS consecutive hashes of GRAM words the least (the
last of equals) is a fingerprint, so any shared span of GRAM + WINDOWS - 1 = 10 words has one at the same place in
both texts. Items of fewer than ten words are one window each and are looked up among all document runs of their
length; such lengths cost nothing where no item has them. The fingerprints of documents meet those of the benchmark by
a broadcast if these are few; otherwise a bitmap of the benchmark's fingerprints is broadcast, of at most MAX_CELLS
bits, and only what it lets through shuffles. A shared fingerprint gives the windows that could hold it; only texts
with such windows are read again, and their windows' words themselves are joined with the benchmark's, so no hash
decides a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tatterloom.llm.common import BROADCAST_ROWS, ascii_lower, bit_of, bounded, by_bitmaps, keep_rows, place, row_key, spread, stored, whole, written

WINDOW = 10
GRAM = 8
WINDOWS = WINDOW - GRAM + 1
#: Fingerprints of the benchmark that are broadcast; beyond, their bitmap of CELLS_PER_KEY cells each is.
MOST_KEYS = 200_000
CELLS_PER_KEY, MAX_CELLS = 16, 1 << 30
#: What isn't part of a word, after lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), SEPARATORS), lambda w: w != "")


def _shift(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def _pair(a: Column, b: Column, by: int) -> Column:
    """Hashes of a[i] with b[i + by], as far as b goes."""
    n = F.greatest(F.size(b) - by, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), _shift(b, by), lambda x, y: F.xxhash64(x, y))


def with_runs(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """rows with w1 (word hashes) and, for each length n, wn: the hash of the n words from each place.

    A length is its largest power of two and the rest: wn pairs wp at the place with w(n - p) p words later.
    """
    need = set(lengths)
    todo = list(lengths)
    while todo:
        n = todo.pop()
        if n > 1:
            p = 1 << (n - 1).bit_length() - 1
            for m in (p, n - p):
                if m not in need:
                    need.add(m)
                    todo.append(m)
    for n in sorted(need - {1}):
        p = 1 << (n - 1).bit_length() - 1
        rows = rows.withColumn(f"w{n}", _pair(F.col(f"w{p}"), F.col(f"w{n - p}"), p))
    return rows


def _places(grams: Column) -> Column:
    """Places of the fingerprints among grams: the least of each WINDOWS in a row, the last of equals."""

    def last_least(i: Column) -> Column:
        at = [F.get(grams, i + j) for j in range(WINDOWS)]
        least = F.least(*at)
        found = i
        for j in range(1, WINDOWS):
            found = F.when(at[j] == least, i + j).otherwise(found)
        return found

    n = F.size(grams) - (WINDOWS - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), last_least))).otherwise(F.array().cast("array<int>"))


def _marks(short: list[int]) -> Column:
    """Structs (place, length, key): the fingerprints, and all runs of the short lengths."""

    def run_of(n: int):
        return lambda h, i: F.struct(i.alias("place"), F.lit(n).alias("length"), F.xxhash64(h, F.lit(n)).alias("key"))

    marks = F.transform("places", lambda p: F.struct(p.alias("place"), F.lit(WINDOW).alias("length"), F.get(F.col(f"w{GRAM}"), p).alias("key")))
    for n in short:
        marks = F.concat(marks, F.transform(f"w{n}", run_of(n)))
    return marks


def _prepared(rows: DataFrame, short: list[int]) -> DataFrame:
    """rows (with `text`) with w<n> and the places of fingerprints."""
    rows = rows.withColumn("w1", F.transform(words_of(F.col("text")), lambda w: F.xxhash64(w))).drop("text")
    return with_runs(rows, [GRAM, *short]).withColumn("places", _places(F.col(f"w{GRAM}")))


def _line(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start + 1, length), " ")


def _index(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, list[int]]:
    """((class, item) of items, a class having one sequence of words; its (line, class) windows; the fingerprints; the lengths under WINDOW that occur)."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.array_join(words_of(whole(text_col)), " ").alias("text")).where("text <> ''")
    classes = written(items.select("text").distinct().select("text", F.monotonically_increasing_id().alias("class")), "classes")
    words = classes.select("class", "text", F.split("text", " ").alias("w")).withColumn("n", F.size("w"))
    short = sorted(r[0] for r in words.where(F.col("n") < WINDOW).select("n").distinct().collect())  # under ten numbers
    length = F.least("n", F.lit(WINDOW))
    windows = words.select("class", "w", length.alias("length"), F.explode(F.sequence(F.lit(0), F.col("n") - length)).alias("start"))
    windows = written(windows.select(_line(F.col("w"), F.col("start"), F.col("length")).alias("line"), "class").distinct(), "windows")
    marks = _prepared(words.select("n", "text"), short).select("n", F.explode(_marks(short)).alias("m")).where(F.col("m.length") == length)
    return items.join(classes, "text").select("class", "item"), windows, written(marks.select("m.key", "m.length").distinct(), "keys"), short


def _known(marks: DataFrame, keys: DataFrame) -> DataFrame:
    """The marks with a key and length of keys, and those of place -1."""
    own = F.col("place") < 0
    if keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS:
        met = marks.join(F.broadcast(keys.withColumn("known", F.lit(True))), ["key", "length"], "left")
        return written(met.where(own | F.col("known")).drop("known"), "met")
    cells = min(MAX_CELLS, 1 << (CELLS_PER_KEY * keys.count() - 1).bit_length())
    cell, least = F.pmod(F.xxhash64("key", "length"), F.lit(cells)), (1 << 15) - 1
    bitmaps = written(keys.groupBy(F.shiftright(cell, 15).alias("bucket")).agg(F.bitmap_construct_agg(cell.bitwiseAND(least)).alias("bits")), "bitmaps")
    met = marks.withColumn("bucket", F.shiftright(cell, 15)).join(F.broadcast(bitmaps), "bucket", "left").where(own | bit_of(F.col("bits"), cell.bitwiseAND(least)))
    met = written(met.select(marks.columns), "met")
    return met.where(own).unionByName(written(met.where(~own).join(keys, ["key", "length"]).select(met.columns), "known"))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(_row_id, file, row, n_words, n_hit, items): a row per row of docs.

    A document word is hit if it lies in an occurrence of a window: ten consecutive words of an item, or all words of
    a shorter item. items are the ids, as sorted strings, of the items with such windows; null ids are left out. Null
    texts have no words; items without words have no window. An empty benchmark hits nothing; an empty table gives an
    empty result. Repeated rows are rows of their own; other columns are not read.
    """
    docs = stored(docs)
    items, windows, keys, short = _index(benchmark, item_col, item_text_col)
    rows = _prepared(spread(docs.select(*row_key(docs, id_col), whole(text_col).alias("text"))), short)
    first = F.struct(F.lit(-1).alias("place"), F.size("w1").alias("length"), F.lit(None).cast("long").alias("key"))
    marks = rows.select("_row_id", "file", "row", F.size("w1").alias("n"), F.explode(F.concat(F.array(first), _marks(short))).alias("m")).select("_row_id", "file", "row", "n", "m.*")
    met = _known(marks, keys)
    starts = F.when(F.col("length") < WINDOW, F.array("place")).otherwise(F.sequence(F.greatest(F.col("place") - (WINDOWS - 1), F.lit(0)), F.least("place", F.col("n") - WINDOW)))
    maybe = met.where("place >= 0").groupBy("file", "row").agg(F.array_distinct(F.flatten(F.collect_list(F.transform(starts, lambda s: F.struct(s.alias("start"), F.col("length").alias("length")))))).alias("spans"))
    maybe = written(maybe, "maybe")
    again = docs.select(*place(docs), whole(text_col).alias("text"))
    if maybe.limit(BROADCAST_ROWS // 10 + 1).count() <= BROADCAST_ROWS // 10:
        maybe = F.broadcast(maybe)
    else:  # texts without a candidate don't shuffle
        again = by_bitmaps(again, maybe.select("file", "row"), True)
    texts = again.join(maybe, ["file", "row"]).select("file", "row", "spans", words_of(F.col("text")).alias("w"))
    of_span = lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"), _line(F.col("w"), s["start"], s["length"]).alias("line"))
    lines = texts.select("file", "row", F.explode(F.transform("spans", of_span)).alias("s")).select("file", "row", "s.*")
    found = written(lines.join(bounded(windows, MOST_KEYS), "line").select("file", "row", "start", "length", "class"), "hits")
    hit = found.groupBy("file", "row").agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1))))).alias("n_hit"))
    of = found.select("file", "row", "class").distinct().join(bounded(items, MOST_KEYS), "class").where("item is not null")
    of = of.groupBy("file", "row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    base = met.where("place < 0").select("_row_id", "file", "row", F.col("n").cast("long").alias("n_words"))
    all_rows = base.join(hit, ["file", "row"], "left").join(of, ["file", "row"], "left")
    none = F.array().cast("array<string>")
    return all_rows.select("_row_id", "file", "row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that no window of the benchmark occurs in, with all their columns."""
    docs = stored(docs)
    found = contamination(docs, benchmark, id_col, text_col)
    return keep_rows(docs, written(found.select("file", "row", (F.col("n_hit") == 0).alias("kept")), "decisions"))
