"""Each stage of the pipeline on what the one before kept, against brute force, with edge rows among the documents."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from loomline.llm import decontaminate, quality

SF = "/root/testdata/sf0.001"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def key(r):
    return (r.doc_id is None, r.doc_id or 0, r.text or "", r.source or "")


def without_common_lines(rows):
    keys = {}
    for r in rows:
        for line in (r.text or "").split("\n"):
            k = lower(line.strip(SPACES))
            if len(k) >= 20:
                keys.setdefault(k, set()).add(r.doc_id)
    often = {k: max((i for i in ids if i is not None), default=None) for k, ids in keys.items() if len(ids) >= 3}

    def kept(r):
        return "\n".join(x for x in (r.text or "").split("\n") if r.doc_id is None or often.get(lower(x.strip(SPACES)), r.doc_id) == r.doc_id)

    return sorted((r.doc_id is None, r.doc_id or 0, kept(r)) for r in rows)


def first_of_each_group(rows):
    sets = {}
    for r in rows:
        words = re.findall(f"[^{SPACES}]+", lower(r.text or ""))
        sets[r.doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if i is not None and sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if i is None or find(i) == i}


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    text = max((r.text for r in base.limit(40).collect()), key=len)
    rows = [(9001, None, "en", "s", None), (9002, "", None, None, 0), (9003, " \t\n", "en", "s", 3), (9004, text, "en", "s", len(text)), (9005, text + " more", "en", "s", 1), (None, text, "en", "s", 1), (9006, text * 20, "en", "s", 1)]
    return base.unionByName(spark.createDataFrame(rows, base.schema)).cache()


def test_stages_are_brute_force(spark, docs):
    named = dict(pipeline.STAGES)
    kept = named["quality_classifier"](spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    scored = quality.score(docs, quality.train(docs, labels))
    assert kept.columns == docs.columns and sorted(map(key, kept.collect())) == sorted(map(key, scored.where("score >= 0.3").select(*docs.columns).collect()))

    # the other stages work on all documents here, as the classifier may leave no edge rows
    cut = named["line_dedup"](spark, docs, SF).cache()
    found = cut.collect()
    assert cut.columns == docs.columns and sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in found) == without_common_lines(docs.collect())
    assert all(r.n_chars == len(r.text) for r in found)

    near = named["jaccard_near_duplicates"](spark, cut, SF).cache()
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == first_of_each_group(found)

    clean = named["benchmark_decontamination"](spark, near, SF).cache()
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id for r in clean.collect()}
    for r in near.where("doc_id IS NOT NULL").collect():
        t = decontaminate.plain(r.text)
        exact = any(i and i[: decontaminate.WINDOW] in t for i in items)
        assert not (exact and r.doc_id in left)
        if not any(t[a : a + 24] and t[a : a + 24] in i for i in items for a in range(0, max(1, len(t) - 23), 1) if len(t) >= 24):
            assert r.doc_id in left  # shares no 24 characters with an item: at most 6 edits in 80 leave some

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = named["bpe"](spark, clean, SF).collect()
    texts = {r.doc_id: r.text or "" for r in clean.collect()}
    assert len(out) == clean.count()
    for r in out:
        ids = np.array(lib.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())


def test_stages_of_no_documents(spark, docs):
    rows = docs.limit(0)
    for name, stage in pipeline.STAGES:
        rows = stage(spark, rows, SF)
        assert rows.count() == 0, name
    assert rows.where(F.col("n_tokens") > 0).count() == 0
