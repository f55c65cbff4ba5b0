import collections
import random
import time
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tatterloom.llm import bpe_automaton, decontaminate, html_text, kneser_ney, quality, substring_dedup, token_stream, warc

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "EEEEEEE!!!!!!!........", "a<|endoftext|> b<|endoftext|>", " x\n\n  y\t z  ", "don't WE'LL 's", "日本語 😀 \x1c \x85 ﬁ Σας ½ ٣", "é ́e"]


def odd_texts(n=400):
    rng = random.Random(0)
    return ODD + ["".join(rng.choice(rng.choice(["eE", "aehtin ", "!.-= ", "0123", "abc ABC", "éàñ本\U0001f600\x00　 ", "=_\n\n \t"])) for _ in range(rng.randint(1, 50))) for _ in range(n)]


def reference(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def test_automaton_is_the_tokenizer():
    own, other = bpe_automaton.local_automaton(BYTE), reference(BYTE)
    for text in odd_texts():
        ids = other.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == other.decode(ids, skip_special_tokens=False)


def test_merge_gadgets_by_hand():
    vocab = {t: k for k, t in enumerate(["a", "b", "aa", "ab", "aab"])}
    target, closed, live = bpe_automaton.compile_merges(vocab, [("a", "a"), ("a", "b"), ("aa", "b")])
    own = bpe_automaton.Automaton({"width": closed.shape[1], "target": target, "labels": [b"a", b"b", b"aa", b"ab", b"aab"], "special": {}, "live": live}, closed.tobytes())
    assert own.word(b"aaa") == (2, 0) and own.word(b"aaaa") == (2, 2)
    assert own.word(b"ab") == (3,) and own.word(b"aab") == (4,) and own.word(b"aaab") == (2, 3)


def test_numbers_take_the_words_that_were_looked_up(monkeypatch):
    word = np.array([2, 0, 1], np.int64)
    model = kneser_ney.Model("", 3, np.zeros(1, np.uint64), np.zeros(2, np.int64), 3, 3)
    monkeypatch.setattr(kneser_ney.Model, "words", lambda *_: pytest.fail("words were looked up again"))
    assert model.numbers(word, np.zeros(3, np.int64), 1).tolist() == [2, 0, 1]


def test_words_that_return_are_encoded_once(monkeypatch):
    monkeypatch.setattr(bpe_automaton, "MOST_WORDS", 8)
    own, other, asked = bpe_automaton.local_automaton(BYTE), reference(BYTE), []
    word = own.word
    monkeypatch.setattr(own, "word", lambda data: asked.append(data) or word(data))
    for k in range(50):
        text = f"frequent qx{k}zv"
        assert own.encode(text) == other.encode(text, add_special_tokens=False).ids
    assert asked.count(b"frequent") == 1
    assert len(own.found) + len(own.found.old) <= 8


def test_encoded_rows(docs, rows, empty):
    other = reference(BYTE)
    found = {(r.doc_id, tuple(r.ids), r.decoded) for r in bpe_automaton.encoded(docs, BYTE).collect()}
    assert found == {(d, tuple(other.encode(t or "", add_special_tokens=False).ids), t or "") for d, t in rows}
    assert bpe_automaton.encoded_digests(empty, BYTE).count() == 0


def test_word_encoder_is_the_tokenizer():
    own, other = token_stream.Encoder(WORD), reference(WORD)
    for text in odd_texts():
        assert np.frombuffer(own.encode(text), own.type).tolist() == other.encode(text, add_special_tokens=False).ids, text


def test_stream_round_trip(docs, rows, empty):
    other = reference(WORD)
    ids = {t or "": [*other.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows}
    found = sorted(token_stream.read_stream(token_stream.write_stream(docs, WORD)).collect(), key=lambda r: r.start)
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    order = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert order == sorted(order)
    crc = lambda t: (len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes()))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in found), key=str) == sorted(((d, *crc(t or "")) for d, t in rows), key=str)
    assert token_stream.read_stream(token_stream.write_stream(empty, WORD)).count() == 0


def test_sequences_are_mapped(tmp_path):
    path, kind = tmp_path / "x.arrow", np.dtype("<u2")
    writer = token_stream.SequenceWriter(str(path), kind, length=8, rows=3)
    for k in range(100):
        writer.add(np.full(k % 5, k, kind).tobytes())
    writer.close()
    reader = token_stream.SequenceReader(path.as_uri())
    stream = [k for k in range(100) for _ in range(k % 5)]
    assert np.concatenate(list(reader.span(3, 150))).tolist() == stream[3:153]
    parts = [reader.sequence(k) for k in range(25)]
    assert np.concatenate([i[m] for i, m in parts]).tolist() == stream
    assert not parts[0][0].flags.owndata


def test_decontamination(docs, rows, empty, spark):
    items = [(k, t) for k, t in enumerate([rows[0][1], rows[3][1][:200], rows[6][1], "x1 b e", "one", "", None, "f g h the of x1 b e f g h"])]
    items += [(90, items[0][1]), (91, items[0][1] + " more words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [(r._row_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(docs, bench).collect()]
    want = list(brute.contamination(rows, items))
    assert sorted(found, key=str) == sorted(want, key=str)
    assert sorted(r.doc_id or -1 for r in decontaminate.decontaminate(docs, bench).collect()) == sorted(d or -1 for d, _, hit, _ in want if not hit)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_decontamination_of_dense_repeats(spark, letters):
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice(letters) for _ in range(n))
    docs, items = [(k, line(rng.randint(0, 60))) for k in range(60)], [(k, line(rng.randint(1, 14))) for k in range(30)]
    items += [(100 + k, docs[k][1][10:60]) for k in range(10)]
    found = [(r._row_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(found) == sorted(brute.contamination(docs, items))


@pytest.mark.parametrize("order", [2, 3])
def test_kneser_ney(docs, rows, empty, order):
    found = {(r.doc_id, r.n_tokens, r.n_known): r for r in kneser_ney.language_scores(docs, order=order).collect()}
    for doc_id, n, known, total, base, score in brute.kneser_ney(rows, order):
        r = found[doc_id, n, known]
        assert r.train_tokens == total and r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    assert kneser_ney.language_scores(empty, order=order).count() == 0


@pytest.mark.parametrize("order", [3, 4])
def test_kneser_ney_in_many_buckets(spark, monkeypatch, order):
    for name, value in (("LEAST_BUCKETS", 8), ("LEAST_BYTES", 400), ("MOST_BYTES", 400), ("MANY", 3), ("input_bytes", lambda _: 3_000)):
        monkeypatch.setattr(kneser_ney, name, value)
    rng = random.Random(1)
    rows = [(k, " ".join("hot" if rng.random() < 0.4 else f"w{rng.randint(0, 30)}" for _ in range(40))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = kneser_ney.train(docs, order=order)
    assert any(len(of.split) > 1 and len(set(of.bounds.hi.tolist())) < len(of.bounds.hi) for of in model.orders.values())
    found = {r.doc_id: r.score for r in kneser_ney.language_scores(docs, order=order).collect()}
    assert all(found[d] == pytest.approx(score) for d, *_, score in brute.kneser_ney(rows, order))


def test_kneser_ney_ranges():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 9, 300)
    sizes[[3, 50, 51, 200]] = 5_000, 900, 40, 2_000  # words after each of contexts 7, 8 ...
    ranges = [np.sort(rng.choice(20_000, n, replace=False)) for n in sizes]
    words, starts = np.concatenate(ranges).astype(np.uint32), np.concatenate([[0], np.cumsum(sizes)])
    have = {(7 + c, w): starts[c] + k for c, own in enumerate(ranges) for k, w in enumerate(own.tolist())}
    pairs = {(7 + c, int(w)) for c in range(-2, 303) for w in rng.integers(0, 20_001, 200 if c in (3, 51) else 4)} | {x for x in have if rng.random() < 0.2 and x[0] != 57}
    hi, lo = np.array(sorted(pairs), np.uint64).T
    place = kneser_ney._places(words, [np.array([7]), *kneser_ney._steps(starts)], hi, lo)[0]
    assert place.tolist() == [have.get(x, -1) for x in sorted(pairs)]
    hi, lo = np.repeat(hi, 3), np.repeat(lo, 3)
    for a, b in zip(kneser_ney.counted(hi, lo), kneser_ney.combined(hi, lo, np.ones(len(hi), np.int64)), strict=True):
        assert a.tolist() == b.tolist()


def test_kneser_ney_reads_a_bucket_once_a_piece(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"a b c{k % 7} d e{k % 5}") for k in range(40)], "doc_id long, text string")
    model, seen, file = kneser_ney.train(docs), [], kneser_ney.Model.file
    monkeypatch.setattr(kneser_ney.Model, "file", lambda self, *of: seen.append(of) or file(self, *of))
    model.score([b"a b c1 d e2", b"b c9 d a"])
    assert {of[0] for of in seen} == {"words", "before", "next", "counts"} and len(seen) == len(set(seen))


def colliding_words():
    """Two words that every polynomial modulo 2**64 takes for one: the Thue-Morse string and its complement."""
    word = b"a"
    for _ in range(10):
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    return word.decode(), word.translate(bytes.maketrans(b"ab", b"ba")).decode()


def test_kneser_ney_buckets_with_few_tokens_are_one(spark, monkeypatch):
    monkeypatch.setattr(kneser_ney, "LEAST_BYTES", 4000)
    docs = spark.createDataFrame([(k, " ".join(f"w{(k * i) % 97}" for i in range(60))) for k in range(100)], "doc_id long, text string")
    model = kneser_ney.train(docs)
    assert all(len(of.bounds.hi) <= 2 * -(-model.tokens // 1000) + 2 for of in model.orders.values())


def test_many_pairs_are_not_combined_again_for_each_few(monkeypatch):
    calls, combined = [], kneser_ney.combined
    monkeypatch.setattr(kneser_ney, "HELD", 100)
    monkeypatch.setattr(kneser_ney, "combined", lambda *a: calls.append(len(a[0])) or combined(*a))
    counter, pairs = kneser_ney.Counter(), np.arange(5000, dtype=np.uint64)
    for part in np.split(pairs, 1000):
        counter.add(part, part % 7, np.ones(5, np.int64))
    hi, lo, counts = counter.take()
    assert hi.tolist() == pairs.tolist() and (lo == pairs % 7).all() and (counts == 1).all()
    assert sum(calls) < 10 * len(pairs)


def test_words_that_polynomials_take_for_one(spark):
    a, b = colliding_words()
    rows = [(1, f"{a} x"), (2, f"{b} x"), (3, f"{a} {a}"), (4, "y")]
    found = {r.doc_id: r for r in kneser_ney.language_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[d].base_score == pytest.approx(base) and found[d].score == pytest.approx(score) for d, *_, base, score in brute.kneser_ney(rows))
    rest = " ".join(f"w{k}" for k in range(34))
    found = substring_dedup.without_repeats(spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}")], "doc_id long, text string"))
    assert [r.n_removed for r in found.collect()] == [0, 0]


def test_kneser_ney_all_held_out(spark):
    out = [d for d in range(200) if zlib.crc32(str(d).encode()) % 10 == 0][:3]
    found = kneser_ney.language_scores(spark.createDataFrame([(d, "a b") for d in out], "doc_id long, text string")).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(0) for r in found)


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "down", "on", "a", "mat."]) for _ in range(60))
    bad = lambda: "!! ".join(rng.choice(["BUY", "NOW", "CHEAP"]) for _ in range(60))
    rows = [(k, good() if k % 3 else bad()) for k in range(600)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, good())], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k, _ in rows] + [(5, None), (7, 0)], "doc_id long, quality int")
    found = quality.quality_scores(docs, labels).collect()
    assert len(found) == 603 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    held = [r for r in found if r.held_out and r.doc_id < 600]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found if r.doc_id is not None)
    assert all(r.predicted == (r.doc_id % 3 > 0) for r in held)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in found)


def test_quality_edges(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_scores(empty, labels).count() == 0
    one = quality.quality_scores(spark.createDataFrame([(1, "a")], "doc_id long, text string"), labels).first()
    assert one.score == 0.5
    x = quality.statistics([b"", b" ", b"a", b"a a a a", b"\n\n", "é É".encode()])
    assert np.isfinite(x).all()
    assert (quality.statistics([b"B b. b"] * 3)[1] == quality.statistics([b"B b. b"])[0]).all()


def test_trees_are_walked_as_one_by_one():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] ** 2 + 0.3 * rng.normal(size=400) > 0.8).astype(float)
    trees = quality.fit(x, y)
    for row, score in zip(x[:50], trees.score(x[:50]), strict=True):
        total = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))
    assert np.mean((trees.score(x) >= 0.5) == y) > 0.9


def test_first_split_is_the_best_of_all():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 20, (300, 3)).astype(float), rng.integers(0, 2, 300).astype(float)
    y[x[:, 1] > 12] = 1
    trees, p = quality.fit(x, y), (y.sum() + 0.5) / (len(y) + 1)
    gains = {}
    for j in range(3):
        for cut in np.unique(x[:, j]):
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) >= quality.LEAST_IN_LEAF:
                part = lambda m: (p - y[m]).sum() ** 2 / (m.sum() * p * (1 - p) + quality.PENALTY)
                gains[j, cut] = part(left) + part(~left)
    assert gains[trees.feature[0, 0], trees.threshold[0, 0]] == pytest.approx(max(gains.values()))


def test_statistics_by_plain_counts(rows):
    for text in [t for _, t in rows if t][:40] + ["", "A!! the the THE 12 $x. (y)\n\nend."]:
        got = quality.statistics([text.encode()])[0]
        words, size = text.encode().split(), max(1, len(text.encode()))
        some = max(1, len(words))
        counts = collections.Counter(words)
        assert got[2] == pytest.approx(sum(65 <= c <= 90 for c in text.encode()) / size)
        assert got[3] == pytest.approx(sum(48 <= c <= 57 for c in text.encode()) / size)
        for k, mark in enumerate(quality.MARKS):
            assert got[5 + k] == pytest.approx(text.encode().count(mark) / size)
        rest = got[5 + len(quality.MARKS) :]
        assert rest[0] == pytest.approx(sum(map(len, words)) / some)
        assert rest[2] == pytest.approx(len(counts) / some) and rest[3] == pytest.approx(max(counts.values(), default=0) / some)
        assert rest[4] == pytest.approx(len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2))
        assert rest[5] == pytest.approx(sum(a == b for a, b in zip(words, words[1:], strict=False)) / some)
        assert rest[10] == pytest.approx(sum(len(w) > 14 for w in words) / some) and rest[12] == pytest.approx(np.log1p(len(words)))


def test_quality_of_rows_of_all_kinds(docs, rows, spark):
    labels = spark.createDataFrame([(d, d % 2) for d, _ in rows if d is not None], "doc_id long, quality int")
    found = quality.quality_scores(docs, labels).collect()
    assert sorted((r.doc_id for r in found), key=str) == sorted((d for d, _ in rows), key=str)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in found)


def test_statistics_do_not_depend_on_neighbours(rows):
    texts = [(t or "").encode() for _, t in rows]
    together = quality.statistics(texts)
    assert np.allclose(together, np.concatenate([quality.statistics([t]) for t in texts]))


PARAGRAPH = "<p>" + "Some words of a long and dull paragraph, as pages have. " * 4 + "</p>"
TEXT = " ".join(("Some words of a long and dull paragraph, as pages have. " * 4).split())


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        (f"<nav><ul><li><a>x</a></ul></nav><article><h1>A &lt; B</h1>{PARAGRAPH}<p>Hi<br>you</article><footer>f</footer>", f"A < B\n\n{TEXT}\n\nHi you"),
        (f"<body><div id=menu><a>m</a></div><h1>T</h1>{PARAGRAPH}<p>s</p>{PARAGRAPH}<div class='comments'>{PARAGRAPH}</div></body>", f"T\n\n{TEXT}\n\ns\n\n{TEXT}"),
        (f"<form><header>H</header><main>{PARAGRAPH}<aside>{PARAGRAPH}</aside><ul><li>one<li>two</ul></main></form>", f"{TEXT}\n\none\n\ntwo"),
        (f"<div class=page><div class=sidebar>{PARAGRAPH * 3}</div><div class=text>{PARAGRAPH}<p>x</p>{PARAGRAPH}</div><div class=cookie-notice>{PARAGRAPH}</div></div>", f"{TEXT}\n\nx\n\n{TEXT}"),
        ("<article><p>a<script>var x='</p><p>bad'</script>b <!-- c --><b>d</b></article>", "ab d"),
        (f"<nav><ul><article>{PARAGRAPH}</article>", TEXT),
        (f"<article>{PARAGRAPH}<section class=comments><article class=comment>{PARAGRAPH}</article></section></article>", TEXT),
        ("<article><p>cut off <a hre", "cut off"),
        (f"<main><h1>T</h1><div class=ad>buy</div><article>{PARAGRAPH}</article></main>", f"T\n\n{TEXT}"),
        (f"<h1>Site</h1><nav>n</nav><div><h1>T</h1>{PARAGRAPH}<p class='promo-box'>p</p><span class=ad>x</span>{PARAGRAPH}</div>", f"T\n\n{TEXT}\n\n{TEXT}"),
    ],
)
def test_main_text(html, want):
    assert html_text.main_text(html) == want


def test_extracted_rows(spark):
    schema = "page_id long, url string, html string, text int"
    pages = [(1, "u", f"<article>{PARAGRAPH}</article>", 1), (1, "u", f"<article>{PARAGRAPH}</article>", 1), (None, None, None, None), (2, "v", "<p>" + "word " * 200_000, 3)]
    found = html_text.extracted(spark.createDataFrame(pages, schema)).collect()
    assert sorted((r.n_chars for r in found)) == [0, len(TEXT), len(TEXT), 999_999]
    assert html_text.extracted(spark.createDataFrame([], schema)).count() == 0


def test_warc_round_trip(spark):
    schema = "page_id long, url string, html string, digest string"
    pages = [(1, "http://a b/\n", "<p>é"), (2, None, "<p>é"), (3, "u", None), (4, "u", ""), (4, "u", ""), (None, "u", "<p>é"), (5, "u", "x" * 700_000), (6, "ü", "\r\n\r\nWARC/1.1\r\n")]
    docs = spark.createDataFrame([(*p, "d") for p in pages], schema).repartition(3)
    found = [tuple(r) for r in warc.archived(docs).collect()]
    top = {}
    for p, _, h in pages:
        top[h or ""] = max((x for x in (top.get(h or ""), p) if x is not None), default=None)
    want = []
    for p, _, h in pages:
        data, first = (h or "").encode(), top[h or ""]
        want.append((p, len(data), warc.payload_digest(data), "response" if p == first else "revisit", None if p == first else first))
    assert sorted(found, key=str) == sorted(want, key=str)
    assert warc.archived(docs.limit(0)).count() == 0


def test_warc_members_stand_alone(tmp_path):
    records = [warc.record("response", k, "u", b"z" * (k * 50_000), "D", k) for k in range(8)]
    z = zlib.compressobj(9, zlib.DEFLATED, 31)
    (tmp_path / "a").write_bytes(b"".join(map(z.compress, records)) + z.flush())
    with open(tmp_path / "a", "rb") as source, open(tmp_path / "b", "wb") as sink:
        places = [(o, n) for o, n, _ in warc.normalise(source, sink)]
    data = (tmp_path / "b").read_bytes()
    assert [zlib.decompress(data[o : o + n], 31) for o, n in places] == records
    with pytest.raises(ValueError, match="within a record"):
        list(warc.records([records[1][:-3]]))


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("<p>Before icon <svg><path/><g><text>x</text></g></svg> after icon.</p>", "Before icon after icon."),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be.</p>", "Let x=1 be."),
        ("<p>See <button><div>k</div></button> now.</p>", "See now."),
        ("<p>Open <select><option>a<option>b</p><p>next</p>", "Open\n\nnext"),
    ],
)
def test_no_text_is_lost_around_what_stands_within_a_block(inner, want):
    assert html_text.main_text(f"<html><body><article>{inner}</article></body></html>") == want


def test_sibling_sections_without_an_article():
    first, second = "First part of the text. " * 13, "Second part. " * 11
    page = f"<body><div id=post><div><p>{first}</p></div><section><p>{second}</p></section></div><div class=sidebar>Links</div></body>"
    assert html_text.main_text(page) == f"{first.strip()}\n\n{second.strip()}"
    both = f"<main><article><p>{first}</p></article><div><p>{second}</p></div></main>"
    assert html_text.main_text(f"<body><nav>Menu</nav>{both}</body>") == f"{first.strip()}\n\n{second.strip()}"


def test_deep_pages_take_linear_time():
    start = time.monotonic()
    assert html_text.main_text("<div>x" * 100_000).count("x") >= html_text.HOLDS * 100_000
    html_text.main_text("<div>x" * 30_000 + "</p>" * 30_000 + "<aside>" * 30_000 + "<article>y" * 30_000)
    assert time.monotonic() - start < 30
