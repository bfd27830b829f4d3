"""The corpus operators against brute force, round trips and edge cases on small tables."""

import datetime
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomline.llm import bpe, components, decontaminate, embedding, html_extract, jaccard_join, line_dedup, quality, sharding, token_files, warc

DOCS = "doc_id long, text string, source string"
RANDOM = random.Random(5)
WORDS = ["the", "and", "ration", "ersh", "Ünder", "öde", "ting", "a", "o'clock", "99", "naïve", "end."]


def text(n):
    return " ".join(RANDOM.choice(WORDS) + RANDOM.choice(["", "", "er", "ly,", "\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = [text(RANDOM.randint(1, 60)) for _ in range(40)]
    rows = [(i, t, "s") for i, t in enumerate([*base, base[0], base[0], base[1], None, "", "   ", "x", "long " * 3000, text(400)])]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_bpe_is_the_library(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = by_id(bpe.encode_decode(docs, path))
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].source == "s"
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(empty, path).count() == 0


def test_bpe_odd_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.TextEncoder(path)
    letters = "aabcdeéthing' ʼ\n\t.,!<|>/Σς中🙂́\x1c\x85\xa0 01½Ⅷİ"
    texts = ["".join(RANDOM.choice(letters) for _ in range(RANDOM.randint(0, 50))) for _ in range(4000)]
    texts += ["a" * 5000, "<|endoftext|>x<|startoftext|>", "the" * 2000, "ΑΣ"]
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_warc_round_trip(spark, tmp_path):
    payloads = [b"x" * 300, b"x" * 300, b"short", b"short", b"", None, b"y" * 5000, b"x" * 300, "é\r\n\r\n".encode() * 60]
    df = spark.createDataFrame([(i * 7, f"http://a/{i}", p) for i, p in enumerate(payloads)], "key long, url string, payload binary")
    runs = []
    for k in range(2):
        uri = f"file://{tmp_path}/w{k}"
        files = warc.write_warc(df, uri, file_bytes=150, shard_bytes=2000, date=datetime.datetime(2020, 1, 1))
        runs.append(sorted(map(tuple, files.collect())))
        got = by_id(warc.read_warc(spark, uri), "record_key")
    assert runs[0] == runs[1] and len(runs[0]) > 2 and not [p for p in (tmp_path / "w0").iterdir() if p.name.startswith("_tmp")]
    for i, p in enumerate(payloads):
        r, p = got[i * 7], p or b""
        first = payloads.index(p) if len(p) >= 100 else i
        assert (r.payload_bytes, r.payload_digest) == (len(p), hashlib.sha256(p).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first * 7))
        assert first != i or bytes(r.payload) == p
    none = warc.write_warc(df.limit(0), f"file://{tmp_path}/none")
    assert none.count() == 0 and warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_sharding(spark, docs, empty):
    many = spark.createDataFrame([(i, ("same text " * 9) if i % 3 == 0 else text(RANDOM.randint(1, 40))) for i in range(3000)], "doc_id long, text string")
    for df, n in ((docs, 3), (many, 24)):
        rows, raw = by_id(sharding.shard_rows(df, n)), by_id(df)
        assert rows.keys() == raw.keys()
        load, slots = {}, {}
        for i, r in rows.items():
            data = (raw[i].text or "").encode()
            assert (r["size"], r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "bytes")
            load[r.shard] = load.get(r.shard, 0) + r["size"]
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len(load) == 24 and max(load.values()) < 1.05 * sum(load.values()) / 24
    assert sharding.shard_rows(empty, 4).count() == 0


def test_sharding_places_repeated_and_null_ids_once(spark):
    rows = [(1, "a b", "x"), (1, "a b", "y"), (None, "c", "z"), (None, None, "w"), (2, "long " * 500, "v"), (2, "long " * 500, "u"), (3, "", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string").withColumn("__key", F.lit(1))
    for carry in (True, False):
        got = sharding.shard_rows(df, shards=3, carry=carry).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
        for shard in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
        if carry:
            assert sorted(r["__id"] for r in got) == sorted(r[2] for r in rows) and {r["__key"] for r in got} == {1}


def test_line_dedup(spark, empty):
    line = "A Line that is Long enough"
    rows = [(1, f"{line}\nown\n{line}"), (2, f"  {line.upper()}\t\nb"), (3, f"x\n{line}"), (4, line), (5, "tiny\ntiny"), (6, None), (7, ""), (8, "tiny"), (9, "tiny\n" + "z" * 25), (10, "z" * 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = by_id(line_dedup.dedup_lines(df, batches=3, fanout=2))
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, []).append(i)
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == i]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_runs(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for k in range(5):
        lines = line_dedup.keyed_lines(spark.createDataFrame([(k, f"line number {k} of all of them\na line that all of them hold")], "doc_id long, text string"))
        assert runs.unseen(lines).count() == (2 if k == 0 else 1)
        runs.add(lines)
    assert runs.merges >= 2 and runs.compact().count() == 6 and runs.compact().agg(F.max("n_docs")).first()[0] == 5


def test_line_dedup_anti_joins_each_batch_with_the_runs(spark, monkeypatch):
    made, joined = [], []

    class Seen(line_dedup.LineRuns):
        def __init__(self, *args):
            super().__init__(*args)
            made.append(self)

        def unseen(self, lines):
            joined.append(len(self.runs()))
            return super().unseen(lines)

    monkeypatch.setattr(line_dedup, "LineRuns", Seen)
    rows = [(i, f"line number {i} of all of them\na line that all of them hold\nline of one in seven: {i % 7}") for i in range(40)]
    got = by_id(line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")))
    assert [got[i].n_dropped for i in range(40)] == [int(i < 39) + int(i < 33) for i in range(40)]
    assert joined == [1, 2, 1]
    runs = made[0]
    assert sum(r.count() for r in runs.runs()) == runs.compact().count() == 48  # each key in one run
    assert runs.compact().agg(F.max("n_docs"), F.sum("n_docs")).first()[:] == (40, 120)


def brute_components(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("options", [{}, {"max_docs": 3}, {"max_docs": 3, "rounds": 3}])
def test_jaccard_join(spark, options):
    r = random.Random(2)
    base = [[f"w{r.randint(0, 400)}" for _ in range(r.choice([2, 5, 9, 30, 120]))] for _ in range(14)]
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for b in base:
        for _ in range(r.choice([1, 2, 5])):
            c = list(b)
            for _ in range(r.randint(0, max(1, len(c) // 60))):
                c[r.randrange(len(c))] = f"n{r.randint(0, 9999)}"
            texts.append(" ".join(c).upper() if r.random() < 0.3 else "\t".join(c))
    texts += [" ".join([*passage, *(f"q{i}_{j}" for j in range(12))]) for i in range(12)] + [None, "", " \n", "one", "ONE", texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = [grams(t) for t in texts]
    want = brute_components(len(sets), lambda i, j: bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]))
    got = by_id(jaccard_join.near_duplicates(df, **options))
    assert [got[i].n_shingles for i in range(len(sets))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(sets))] == want
    assert jaccard_join.near_duplicates(df.limit(0)).count() == 0


def test_routes_miss_no_link():
    r, routes = np.random.default_rng(0), jaccard_join.Routes(85)
    # no shingle is common, one in four is, of which one in four is very common
    none, some = jaccard_join.CommonLevels([]), jaccard_join.CommonLevels([r.integers(0, 256, 1 << 13, dtype=np.uint8).tobytes(), bytes([17]) * (1 << 10)])
    for n in [7, 8, 10, 13, 20, 33, 60, 150, 400] * 30:
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        cut = int(r.integers(0, n * 15 // 185 + 2))
        b = np.unique(np.r_[r.permutation(a)[cut:], r.integers(0, 1 << 63, int(r.integers(0, cut + 1)), dtype=np.uint64)])
        o = len(np.intersect1d(a, b))
        if 100 * o >= 85 * (len(a) + len(b) - o) and len(a) != o:
            for levels in (none, some):
                assert len(np.intersect1d(routes.keys(a, levels), routes.keys(b, levels)))


@pytest.mark.parametrize("options", [{}, {"block": 16, "chunk": 8}])
def test_embeddings(spark, options):
    r = np.random.default_rng(4)
    x = r.normal(size=(90, 8))
    x[30:60] = x[:30] + r.normal(scale=0.25, size=(30, 8))
    x[60:80] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, []), (92, [0.0] * 8), (93, [float("nan")] * 8), (94, [1.0, None]), (95, x[0][:3].tolist()), (96, (x[0] * 2).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    ok = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    linked = lambda i, j: i in ok and j in ok and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= 0.9
    want, got = brute_components(97, linked), by_id(embedding.near_duplicates(df, **options), "vec_id")
    for i in range(97):
        assert got[i].n_links == sum(linked(i, j) for j in range(97) if j != i)
        assert got[i].component_id == want[i] and got[i].kept == (want[i] == i)
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 if i <= 60 else 100 if i < 140 else 200 for i in [*range(61), *range(100, 140), 200, 201]}


def test_decontamination(spark, empty):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    items = [" ".join(word() for _ in range(40)) for _ in range(5)] + ["a short one, just so", None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows, want = [], set()
    for k, item in enumerate(items[:6]):
        for edits in (0, 3):
            t = list(item)
            for _ in range(edits if k < 5 else 0):
                t[r.randrange(len(t))] = "z"
            rows.append("lead in words  " + "".join(t).upper().replace(" ", "\n  ") + " and out")
            want.add((len(rows) - 1, k))
    rows += ["clean " + " ".join(word() for _ in range(300)), None, "", items[0][:40]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumn("item_id", F.lit(-1))
    for options in ({}, {"max_index": 300}):
        assert {(x.doc_id, x.item_id) for x in decontaminate.find_leaks(df, bench, **options).collect()} == want
    assert {x.doc_id for x in decontaminate.clean(df, bench).collect()} == set(range(len(rows))) - {d for d, _ in want}
    assert decontaminate.find_leaks(empty, bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def sellers(p, t):
    row = list(range(len(p) + 1))
    best = row[-1]
    for c in t:
        last, row = row, [0]
        for i, x in enumerate(p):
            row.append(min(last[i] + (x != c), last[i + 1] + 1, row[i] + 1))
        best = min(best, row[-1])
    return best


def test_fewest_edits_is_edit_distance():
    r = random.Random(8)
    for _ in range(300):
        p, t = ("".join(r.choice("abc") for _ in range(r.randint(lo, 90))) for lo in (1, 0))
        assert decontaminate.fewest_edits(decontaminate.codes_of(p), decontaminate.codes_of(t)) == sellers(p, t)


def test_decontamination_finds_windows_edited_at_their_start():
    r = random.Random(4)
    item = "".join(r.choice("abcdefghij ") for _ in range(130)).replace("  ", "xy").strip()
    index = decontaminate.Index.build([(7, item)], decontaminate.Q, decontaminate.WINDOW, decontaminate.EDIT_SHARE)
    clean = lambda n: "".join(r.choice("klmnopqr") for _ in range(n))
    shifts = [(3, 11, 19), (0, 1, 2, 3, 4, 5), (72,), ()] + [tuple(r.sample(range(80), r.randint(1, 9))) for _ in range(12)]
    found = 0
    for places in shifts:
        for s in (0, 20, len(item) - 80):
            passage = list(item[s : s + 80])
            for x in places:
                passage[x] = r.choice(["", passage[x] + "z", "z"]) if len(places) > 3 else "z"
            doc = clean(60) + "".join(passage) + clean(60)
            want = min(sellers(item[h : h + 80], doc) for h in range(len(item) - 79))
            got = index.search(decontaminate.codes_of(doc))
            assert [(i, e) for i, e, *_ in got] == ([(7, want)] if want <= 6 else []), (places, s)
            for _, e, a, b in got:
                assert min(sellers(item[h : h + 80], doc[a:b]) for h in range(len(item) - 79)) == e
                found += 1
    assert 15 < found < 3 * len(shifts)


def test_decontamination_finds_items_shorter_than_a_gram(spark):
    items = ["é", "Oui!", "seven c", "eight ch", "no", "Oui!", "", None, "a  b"]
    texts = ["x OUI! y", "oui!", "é", "e", "", None, "it is seven  Characters", "with eight chars", "nope", "A\nB"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = decontaminate.plain
    want = {(d, i, 0, plain(t).find(plain(x)), plain(t).find(plain(x)) + len(plain(x))) for d, t in enumerate(texts) for i, x in enumerate(items) if plain(x) and plain(x) in plain(t)}
    assert {(0, 1, 0, 2, 6), (6, 2, 0, 6, 13), (7, 3, 0, 5, 13)} <= want
    for options in ({}, {"max_index": 5}):
        assert {tuple(r) for r in decontaminate.find_leaks(df, bench, **options).collect()} == want


def test_banded_edits_is_edit_distance():
    r = random.Random(1)
    for _ in range(60):
        p, t = ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(2)]
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p):
            new = [i + 1]
            for j, d in enumerate(t):
                new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
            row = new
        edits, s, e = decontaminate.banded_edits(decontaminate.codes_of(p), decontaminate.codes_of(t), 99)
        assert edits == min(min(row), len(p)) if edits <= 99 else True
        assert 0 <= s <= e <= len(t)


def test_token_files(docs, empty, spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, at = Tokenizer.from_file(path), 0
    token_files.write_token_files(docs, f"file://{tmp_path}/t", path, 0, parts=4, file_ids=300)
    got = by_id(token_files.read_token_files(spark, f"file://{tmp_path}/t"))
    for r in docs.orderBy("doc_id").collect():
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(got[r.doc_id]) == (r.doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    token_files.write_token_files(empty, f"file://{tmp_path}/e", path, 0, parts=4)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


def test_huffman():
    r = np.random.default_rng(0)
    for width, n in ((1, 5), (2, 700), (300, 1025), (60000, 90000)):
        ids = (r.zipf(1.2, n) % width).astype(np.uint32)
        counts = np.bincount(ids, minlength=width)
        lengths = token_files.code_lengths(counts)
        assert lengths.max() <= token_files.MAX_BITS and (0.5 ** lengths[lengths > 0].astype(float)).sum() <= 1
        data = token_files.file_bytes(np.array([4]), np.array([n]), ids, 9, lengths, token_files.canonical_codes(lengths))
        assert (token_files.parse_file(data)[2] == ids).all()
    skewed = token_files.code_lengths(np.array([1 << k for k in range(40)]), limit=8)
    assert skewed.max() == 8


def test_quality(spark, empty):
    rows = [(i, ("junk### more%%% of$$$ this&&& " * 8) if i % 3 == 0 else text(60).replace("99", "so")) for i in range(400)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(400)], "doc_id long, quality int")
    forest = quality.train(df, labels)
    got = by_id(quality.score(df, forest))
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert np.mean([got[i].predicted == (i % 3 != 0) for i in range(400) if got[i].held_out]) > 0.95
    assert {r.score for r in quality.score(df, quality.train(df, labels.limit(0))).collect()} == {0.5}
    assert quality.score(empty, forest).count() == 0


def test_commonest_word_of_texts_of_any_length():
    at = quality.FEATURES.index("commonest_word")
    for n in (0, 1, 63, 64, 65, 1000):
        words = [x for i in range(n) for x in (f"w{i}", "same")]
        assert quality.statistics([" ".join(words)])[0, at] == (0.5 if n else 0)
    assert quality.statistics(["   \n "])[0, at] == 0


def test_html(spark):
    good = "<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>More</a></li></ul></nav><div class='ad'>Buy now</div><article><h1>A &amp; B</h1><p>First  line<br>goes\non.</p><p>Second one.</p></article><footer>&copy; me</footer></body></html>"
    rows = [(1, "u", good), (2, "u", None), (3, "u", ""), (4, "u", "<nav>x</nav>"), (5, "u", good[:-20]), (6, "u", good.replace("<p>Second one.</p>", "<p>" + "Many words here. " * 20000 + "</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))
    got = by_id(html_extract.extract(df), "page_id")
    want = "A & B\nFirst line goes on.\nSecond one."
    assert got[1].text == got[5].text == want and got[1].n_chars == len(want)
    assert [got[i].text for i in (2, 3, 4)] == ["", "", ""] and got[6].n_chars > 300000
    assert html_extract.extract(df.limit(0)).count() == 0


def test_block_vector_has_all_words():
    part = slice(html_extract.PATH_DIM, html_extract.PATH_DIM + html_extract.WORD_DIM)
    for n in (1, 5, 32, 50, 64, 200, 20_000):
        words = [f"Wörd{i % 97}" if i % 2 else f"other{i}" for i in range(n)]
        want = np.zeros(html_extract.WORD_DIM)
        for w in words:
            want[html_extract._slot("w:" + w.lower(), html_extract.WORD_DIM)] += 1 / n
        assert np.allclose(html_extract.block_vector(("p",), " ".join(words), 0, 0, 1)[part], want, atol=1e-5)


def test_html_keeps_formulas_and_what_follows_unclosed_elements():
    texts = lambda page: [b[1] for b in html_extract.blocks_of(page)]
    page = "<article><p>area <math><mi>x</mi><mo>=</mo><mn>2</mn></math> end</p><object data=f><p>fallback</p></object><noscript>no <b>script</b></noscript><svg><title>t</title><text>drawn</text></svg></article>"
    assert texts(page) == ["area x=2 end", "fallback", "no script", "drawn"]
    for name in ("script", "style", "title", "textarea", "template", "iframe"):
        assert texts(f"<div><p>a <{name}>hidden</{name}></p><p>b</p></div>") == ["a", "b"]
        for page in ("<div><p>a</p><{}>x<div>y</div>z</div><p>b</p>", "<div><p>a<{}>x</p><p>b</p></div>", "<ul><li>a<{}>x<li>b</ul>", "<div><p>a<{}>x</div>b<p>"):
            assert texts(page.format(name)) == ["a", "b"], (name, page)
        assert texts(f"a<{name}>x y") == ["a"]


def test_html_unclosed_quotes_and_tags():
    texts = lambda page: [b[1] for b in html_extract.blocks_of(page)]
    assert texts('<p title="abc>hello world</p><p>x</p>') == ["hello world", "x"]
    assert texts('<p title="a>b" class=x>he < llo</p><p>end <a href="y') == ["he < llo", "end"]
    for piece in ("<a 'x\"", "<div>x", "<p", '<p title="', "<script>", "<!--", "<p>a<b", "<div><script>"):
        start = time.time()
        html_extract.blocks_of(piece * (1_000_000 // len(piece)))
        assert time.time() - start < 20, piece
    start = time.time()
    html_extract.blocks_of("<div>" * 80_000 + "</p>" * 80_000)
    assert time.time() - start < 20


def test_lstm_is_the_plain_recurrence():
    r = np.random.default_rng(3)
    m = html_extract.BlockLabeller(seed=2, dim=5, hidden=3)
    pages = [r.normal(size=(n, 5)).astype(np.float32) for n in (4, 1, 7)]
    x, mask, _ = html_extract.padded(pages)
    got = m.score(x, mask)
    sig = lambda v: 1 / (1 + np.exp(-v))
    for p, page in enumerate(pages):
        states = {}
        for d in "fb":
            h, c = np.zeros(3), np.zeros(3)
            for t in range(len(page)) if d == "f" else reversed(range(len(page))):
                z = page[t] @ m.p[f"w{d}"] + m.p[f"b{d}"] + h @ m.p[f"u{d}"]
                i, f, o, g = sig(z[:3]), sig(z[3:6]), sig(z[6:9]), np.tanh(z[9:])
                c = f * c + i * g
                h = o * np.tanh(c)
                states[d, t] = h
        want = [sig(np.r_[states["f", t], states["b", t]] @ m.p["o"] + m.p["c"][0]) for t in range(len(page))]
        assert np.allclose(got[p, : len(page)], want, atol=1e-5)


def test_forest_is_the_plain_boosting():
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(300, 4)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    forest = quality.fit(x, y, trees=3, depth=2, bins=16)
    # one row at a time, through all trees
    for row, s in zip(x[:50], forest.score(x[:50])):
        total = forest.base
        for f, c, leaf in zip(forest.feature, forest.cut, forest.leaf):
            node = 0
            for _ in range(2):
                node = 2 * node + 1 + (row[f[node]] > c[node])
            total += leaf[node - 3]
        assert abs(s - 1 / (1 + np.exp(-total))) < 1e-12
    # the first split has the largest gain of all cuts at quantiles of all features
    p = np.full(len(y), y.mean())
    grad, hess = p - y, p * (1 - p)
    best = (0.0, None)
    for f in range(4):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1])):
            left = x[:, f] <= cut
            if min(hess[left].sum(), hess[~left].sum()) < quality.LEAST / 4:
                continue
            gain = sum(grad[m].sum() ** 2 / (hess[m].sum() + quality.L2) for m in (left, ~left)) - grad.sum() ** 2 / (hess.sum() + quality.L2)
            if gain > best[0] + 1e-9:
                best = (gain, (f, cut))
    assert (forest.feature[0, 0], forest.cut[0, 0]) == best[1]


def test_html_held_out():
    model, site, wrong, n = html_extract.trained(), html_extract.SitePages(321), 0, 0
    for _ in range(150):
        blocks, y = site.labelled()
        if blocks:
            x, mask, _ = html_extract.padded([html_extract.page_matrix(blocks)])
            wrong += int(((model.score(x, mask)[0] >= 0.5) != (y > 0.5)).sum())
            n += len(y)
    assert wrong < 0.02 * n


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(3)
    word = lambda: "".join(r.choice("aeiourstlnm") for _ in range(r.randint(2, 7)))
    clean = [" ".join(word() for _ in range(80)) for _ in range(60)]
    item = " ".join(word() for _ in range(40))
    rows = [(i, t) for i, t in enumerate(clean)] + [(100, clean[3]), (101, clean[4] + " tail"), (102, clean[5][:100] + " " + item)] + [(200 + i, "junk### of%%% all$$$ kinds&&& " * 9) for i in range(30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200)) for i, _ in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = by_id(corpus_pipeline.run(spark, str(tmp_path)))
    assert set(got) == set(range(60))
    assert re.fullmatch("[0-9a-f]{64}", got[0].ids_sha256)


def test_columns_of_any_name_pass_through(spark):
    names = ["__text", "__id", "__gone", "__hash", "__y", "line_no", "h1"]
    df = spark.createDataFrame([(i, "a line of more than twenty characters\nown line %d" % i) for i in range(5)], "doc_id long, text string").select("*", *[F.lit(n).alias(n) for n in names])
    forest = quality.fit(np.random.default_rng(1).normal(size=(40, len(quality.FEATURES))), np.arange(40) % 2.0)
    for out in (bpe.encode_decode(df, public_tokenizers.path("word_bpe_49k.json")), quality.score(df, forest), line_dedup.dedup_lines(df)):
        rows = out.collect()
        assert len(rows) == 5 and all(r[n] == n for r in rows for n in names)


def test_line_dedup_of_repeated_and_null_ids(spark):
    long = ["common line number %d, which is long enough" % i for i in range(3)]
    rows = [(1, f"{long[0]}\nx"), (1, f"y\n{long[0]}\n\n"), (2, long[0]), (3, f"{long[0]}\n{long[0]}"), (None, long[0]), (2, None), (4, f"\n{long[1]}"), (4, f"\n{long[1]}"), (5, long[1])]
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(1, "x", 2, 1), (1, "y\n\n", 4, 1), (2, "", 1, 1), (3, f"{long[0]}\n{long[0]}", 2, 0), (None, long[0], 1, 0), (2, "", 1, 0), (4, f"\n{long[1]}", 2, 0), (4, f"\n{long[1]}", 2, 0), (5, long[1], 1, 0)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_lines_cut_between_gaps(spark):
    texts = [("a\nb\nc", [0]), ("a\nb\nc", [1]), ("a\nb\nc", [2]), ("a\nb\nc", [0, 1, 2]), ("", [0]), ("a\n\n", [1]), ("\n".join(map(str, range(500))), list(range(0, 500, 2)))]
    df = spark.createDataFrame(texts, "t string, g array<int>").select(line_dedup.without(F.col("t"), F.col("g")).alias("kept"))
    assert [r.kept for r in df.collect()] == ["\n".join(x for i, x in enumerate(t.split("\n")) if i not in g) for t, g in texts]


def test_rows_less_ids(spark):
    df = spark.createDataFrame([(i if i % 9 else None, f"t{i}") for i in range(300)], "doc_id long, text string")
    gone = spark.createDataFrame([(i,) for i in range(0, 300, 4)], "doc_id long")
    got = sorted(r.text for r in jaccard_join.less(df, gone).collect())
    assert got == sorted(f"t{i}" for i in range(300) if i % 9 == 0 or i % 4)
    assert jaccard_join.less(df, gone.limit(0)).count() == 300 and jaccard_join.less(df.limit(0), gone).count() == 0


def test_leaks_in_repetitive_texts():
    import tracemalloc

    phrase = "the same forty characters again and yes, "
    item = (phrase * 75)[:3000]
    index = decontaminate.Index.build([(1, item), (2, "0" * 2000), (3, "ab " * 400)], decontaminate.Q, decontaminate.WINDOW, decontaminate.EDIT_SHARE)
    changed = list(phrase * 200)
    for i in range(0, len(changed), 9):
        changed[i] = "#"
    texts = {"copy": phrase * 25000, "changed": "".join(changed), "zeros": "0" * 200000, "abs": "xyz " + "ab " * 20000}
    tracemalloc.start()
    began = time.time()
    got = {n: {h[0]: h[1] for h in index.search(decontaminate.codes_of(t))} for n, t in texts.items()}
    assert time.time() - began < 60 and tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()
    assert got["copy"] == {1: 0} and got["changed"] == {} and got["zeros"] == {2: 0} and got["abs"] == {3: 0}


def test_stretches_find_what_a_whole_text_does(monkeypatch):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    r = random.Random(31)
    items = [(i, " ".join(r.choice(words) for _ in range(40))) for i in range(6)]
    for _ in range(10):
        parts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(3)]
        for _, t in r.sample(items, 2):
            at = r.randrange(len(t) - 90)
            own = list(t[at : at + 90])
            for _ in range(r.randint(0, 7)):
                own[r.randrange(len(own))] = r.choice("qx")
            parts.append("".join(own))
        r.shuffle(parts)
        codes, found = decontaminate.codes_of(" ".join(parts)), []
        for pairs in (1_000_000, 50):
            monkeypatch.setattr(decontaminate, "PAIRS", pairs)
            found.append(sorted((h[0], h[1]) for h in decontaminate.Index.build(items, 8, 80, 0.08).search(codes)))
        assert found[0] == found[1]
