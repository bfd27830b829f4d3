"""Token alignment against brute force over the libraries' own tokens."""

import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomline.llm import alignment

PATHS = (P.path("byte_bpe_50k.json"), P.PATTERN, P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    letters = ["the ", "token", "izers", " über", "naïve", "日本", "🙂", "\n", "  ", "\x00", "99", "'s", "é", "<s>", "<|endoftext|>", "​"]
    some = ["".join(r.choice(letters) for _ in range(r.randint(1, 30))) for _ in range(150)]
    return [*some, some[0], None, "", " ", "with ▁ mark", "▁", "a" * 3000, "<unk>", "word " * 4000, "éﬁ"]


def brute(texts):
    a_lib, b_lib = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[2])
    a_lib.encode_special_tokens = True
    shown = alignment.byte_chars()
    docs, count = [], {}
    for t in texts:
        spans = []
        if t:
            a, b = a_lib.encode(" " + t, add_special_tokens=False).ids, b_lib.encode(t)
            a_bytes = [bytes(map(shown.index, a_lib.id_to_token(i))) for i in a]
            b_bytes = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_lib.id_to_piece(i)) for i in b)]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode():
                for ids, parts in ((a, a_bytes), (b, b_bytes)):
                    at, span = 0, []
                    for i, x in zip(ids, parts):
                        span.append((at, at + len(x), i))
                        at += len(x)
                    spans.append(span)
        if not spans:
            docs.append(([], [], [], ""))
            continue
        links, j = [], 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in span if low <= s and e <= c) for span in spans))
            low = c
        docs.append((spans[0], spans[1], links, ";".join(groups)))
        for p in set(links):
            count[p] = count.get(p, 0) + 1
    most = {}
    for (i, _), n in count.items():
        most[i] = max(most.get(i, 0), n)
    rows = [(len(a), len(b), g.count(";") + bool(g), len(ls), sum(count[p] == most[p[0]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(g.encode()).hexdigest() if g else "") for a, b, ls, g in docs]
    return rows, count


@pytest.mark.parametrize("most", [alignment.MOST_PAIRS, 0])
def test_alignment_is_brute_force(spark, texts, most):
    df = spark.createDataFrame([(i if i % 7 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, rid int").repartition(5).withColumn("pairs", F.lit("x"))
    out, pairs = alignment.align_tokens(df, *PATHS, most=most)
    assert out.columns == ["doc_id", "text", "rid", "pairs", *alignment._RESULTS]
    want, count = brute(texts)
    got = {r.rid: tuple(r[c] for c in alignment._RESULTS) for r in out.collect()}
    assert got == dict(enumerate(want))
    assert {(r.a_id, r.b_id): r.docs for r in pairs.collect()} == count
    top = {r.a_id: r.docs for r in pairs.where("best").collect()}
    assert all(n <= top[a] for (a, _), n in count.items()) and sum(want[i][0] == 0 for i in range(len(texts))) >= 4


def test_no_documents(spark):
    out, pairs = alignment.align_tokens(spark.createDataFrame([], "doc_id long, text string"), *PATHS)
    assert out.count() == pairs.count() == 0
