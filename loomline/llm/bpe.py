"""BPE encoding and decoding by speculation and verification.

A word is first cut by greedy longest match. The cut is the BPE result exactly when every pair
of neighbouring tokens is compatible, that is when BPE would never merge across their border;
this is tested for all pairs of many words at once in numpy. Only words with an incompatible
pair go through exact merging.

Tokenizer files are those of the tokenizers library with a BPE model and an end-of-word suffix;
normalisation and word pattern are those of such a file: NFC, white space to one space, lower
case, words by pattern, bytes as printable characters.

Defined results: a null text is the empty text and has no tokens; the texts of special tokens
within a text become those tokens; very long words are merged with a heap; repeated rows and
ties need no care as each text is encoded by itself; an empty table gives an empty result;
other columns are passed through unless they bear a result's name.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Stands for the end-of-word suffix within a word; a private-use character that no byte maps to.
_END = "\ue000"
#: Control characters that str.split() takes for white space but the tokenizer does not.
_ODD = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"\p{White_Space}+")
#: Characters of text that are handled at once, words and pieces that are remembered (of pieces twice as many), the longest of them, and pieces kept between tasks.
_CHUNK, _CACHE, _LONG, _KEPT = 1 << 20, 300_000, 200, 150_000


def byte_chars() -> list[str]:
    """The printable character of each byte: itself where it is visible Latin-1, else the next from 256 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class BpeTable:
    """Tokens in the order of their merges, with what the compatibility test needs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        self.suffix = suffix
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        short = (lambda s: s[: -len(suffix)] + _END if suffix and s.endswith(suffix) and len(s) > len(suffix) else s)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made, merged = {}, []
        for a, b in merges:
            merged.append((short(a), short(b)))
            made.setdefault(merged[-1][0] + merged[-1][1], len(made))
        base = [s for s in map(short, vocab) if s not in made]
        names = base + list(made)
        self.index = {s: i for i, s in enumerate(names)}
        n = len(names)
        self.left, self.right = np.arange(n), np.arange(n)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        often = set()
        for r, (a, b) in enumerate(merged):
            x, y, z = self.index[a], self.index[b], self.index[a + b]
            if self.left[z] != z:
                often.add(z)
            else:
                self.left[z], self.right[z] = x, y
            self.rank.setdefault((x, y), (r, z))
        keys = np.array([x * n + y for x, y in self.rank], dtype=np.int64)
        order = np.argsort(keys)
        self.n, self.pair_keys = n, keys[order]
        self.pair_token = np.array([z for _, z in self.rank.values()], dtype=np.int64)[order]
        self.vocab_id = np.array([vocab[s[:-1] + suffix if s.endswith(_END) else s] for s in names], dtype=np.uint32)
        own = np.flatnonzero(self.left != np.arange(n))
        whole = np.ones(n, dtype=bool)
        whole[own] = self._compatible(self.left[own], self.right[own], own)
        whole[list(often)] = False
        self.greedy = {s: i for s, i in self.index.items() if whole[i]}
        self.size = np.array([len(t) for t in names], dtype=np.int64)
        #: finds the longest token at each place in turn
        self.cutter = ahocorasick.Automaton()
        for t, i in self.greedy.items():
            self.cutter.add_word(t, i)
        self.cutter.make_automaton()
        self.strings = dict(zip(self.vocab_id.tolist(), (s[:-1] + suffix if s.endswith(_END) else s for s in names)))
        self.strings |= {i: s for s, i in self.special.items()}

    def _compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens: no merge across their border comes before the merges that made them.

        ``limit``: merges from this token on do not count. The younger of the two tokens is undone
        step by step, as only merges older than what is undone could have come before it.
        """
        a, b = a.astype(np.int64).copy(), b.astype(np.int64).copy()
        limit = np.full(len(a), self.n, dtype=np.int64) if limit is None else limit.astype(np.int64).copy()
        good, live = np.ones(len(a), dtype=bool), np.arange(len(a))
        while len(live):
            x, y, top = a[live], b[live], limit[live]
            key = x * self.n + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[at] == key) & (self.pair_token[at] < top)
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            x_whole, y_whole = self.left[x] == x, self.left[y] == y
            undo_x = ~x_whole & ((x > y) | y_whole)
            undo_y = ~undo_x & ~y_whole
            limit[live] = np.where(undo_x, x, y + 1)
            a[live] = np.where(undo_x, self.right[x], x)
            b[live] = np.where(undo_y, self.left[y], y)
            live = live[undo_x | undo_y]
        return good

    def _speculate(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all words, number of each word's tokens) by greedy longest match; none of a word that it does not cover."""
        found = np.array(list(self.cutter.iter_long("\n".join(words))), dtype=np.int64).reshape(-1, 2)
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        owner = np.searchsorted(np.cumsum(length + 1), found[:, 0], "right")
        whole = np.bincount(owner, self.size[found[:, 1]], minlength=len(words)) == length
        some = whole[owner]
        return found[some, 1], np.bincount(owner[some], minlength=len(words))

    def _merge(self, word: str) -> list[int]:
        """Exact merging: always the oldest merge, leftmost first, by a heap over a linked list."""
        toks = [self.index[c] for c in (word if not word.endswith(_END) else [*word[:-2], word[-2:]])]
        n, rank = len(toks), self.rank
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p][0], i, p) for i in range(n - 1) if (p := (toks[i], toks[i + 1])) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = nxt[i] if toks[i] >= 0 else n
            if j >= n or (toks[i], toks[j]) != p:
                continue
            toks[i], toks[j] = rank[p][1], -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (q := (toks[i], toks[nxt[i]])) in rank:
                    heapq.heappush(heap, (rank[q][0], i, q))
            if prv[i] >= 0 and (q := (toks[prv[i]], toks[i])) in rank:
                heapq.heappush(heap, (rank[q][0], prv[i], q))
        return [t for t in toks if t >= 0]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Vocabulary ids of words in byte characters, each with the end mark if the file has a suffix, as little-endian unsigned 32-bit integers."""
        flat, sizes = self._speculate(words)
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = owner[1:] == owner[:-1]
        pairs, back = np.unique(flat[:-1][inner] * self.n + flat[1:][inner], return_inverse=True)
        good = self._compatible(pairs // self.n, pairs % self.n)
        bad = sizes == 0
        bad[owner[:-1][inner][~good[back]]] = True
        raw, ends = self.vocab_id[flat].astype("<u4").tobytes(), (np.cumsum(sizes) * 4).tolist()
        out = [raw[a:b] for a, b in zip([0, *ends], ends)]
        for i in np.flatnonzero(bad).tolist():
            out[i] = self.vocab_id[self._merge(words[i])].astype("<u4").tobytes() if words[i] else b""
        return out

    def decode(self, ids: np.ndarray) -> str:
        """As the library without a decoder: the tokens' strings with one space between."""
        return " ".join(map(self.strings.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=4)
def load_table(path: str) -> BpeTable:
    return BpeTable(path)


class TextEncoder:
    """Encodes whole texts; pieces between white space are remembered as they recur."""

    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"

    def __init__(self, path: str):
        self.table = load_table(path)
        self.words = regex.compile(self.WORDS)
        self.chars = byte_chars()
        #: pieces seen; full, it starts anew beside its old self, from which pieces that recur are taken over
        self.seen: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.table.special)) + ")") if self.table.special else None

    def _to_words(self, piece: str) -> list[str | int]:
        """Words of a piece, normalised; special tokens as their ids."""
        if piece.isascii():
            if piece.isalpha():
                return [piece.lower()]
            if piece[-1] in ".,;:!?" and piece[:-1].isalpha():
                return [piece[:-1].lower(), piece[-1]]
        out: list[str | int] = []
        for part in self.split.split(piece) if self.split and "<" in piece else [piece]:
            if part in self.table.special:
                out.append(self.table.special[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # each letter by itself, without the rule for a last sigma
            out += self.words.findall(part.lower())
        return out

    def byte_word(self, word: str) -> str:
        end = _END if self.table.suffix else ""
        # visible ASCII stands for itself
        return word + end if word.isascii() and word.isprintable() else "".join([self.chars[b] for b in word.encode("utf-8")]) + end

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of each piece; pieces and words of moderate length are remembered."""
        if not pieces:
            return {}
        cut = [self._to_words(p) for p in pieces]
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        fresh = list({w for c in cut for w in c if w not in known and isinstance(w, str)})
        got = dict(zip(fresh, self.table.encode_words([self.byte_word(w) for w in fresh])))
        known.update(got if max(map(len, fresh), default=0) <= _LONG else {w: i for w, i in got.items() if len(w) <= _LONG})
        ids = lambda w: w.to_bytes(4, "little") if isinstance(w, int) else known[w] if w in known else got[w]
        made = {p: ids(c[0]) if len(c) == 1 else b"".join(map(ids, c)) for p, c in zip(pieces, cut)}
        self.seen.update(made if max(map(len, pieces), default=0) <= _LONG else {p: i for p, i in made.items() if len(p) <= _LONG})
        return made

    def trim(self) -> None:
        """Between tasks a process, which may go on to other work, keeps words and a moderate number of pieces only."""
        self.old = {}
        if len(self.seen) > _KEPT:
            self.seen = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            cut, size = [], 0
            while at < len(texts) and size < _CHUNK:
                t = texts[at]
                cut.append(t.split() if not _ODD.search(t) else [p for p in _SPACE.split(t) if p])
                size += len(t)
                at += 1
            get = self.seen.get
            got = [list(map(get, c)) for c in cut]
            fresh = {p for c, g in zip(cut, got) if None in g for p, i in zip(c, g) if i is None}
            if fresh:
                if len(self.seen) + len(fresh) > _CACHE:
                    self.old, self.seen = self.seen, {}
                made = {p: self.old[p] for p in fresh if p in self.old}
                self.seen.update(made)
                made |= self._learn([p for p in fresh if p not in made])
                got = [[made[p] if i is None else i for p, i in zip(c, g)] if None in g else g for c, g in zip(cut, got)]
            out += map(b"".join, got)
        return out


@functools.lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256 in place of the text; ids as binary if asked for."""
    taken = ["n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    extra = [c for c in docs.columns if c != text_col and c not in taken]
    (own,) = common.unused(docs, "__text")
    schema = T.StructType([docs.schema[c] for c in extra] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] + ([T.StructField("ids", T.BinaryType())] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = text_encoder(path)
        for batch in batches:
            ids = enc.encode(batch.column(own).to_pylist())
            decoded = [hashlib.sha256(enc.table.decode(np.frombuffer(i, "<u4")).encode("utf-8")).hexdigest() for i in ids]
            cols = [batch.column(c) for c in extra] + [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.binary())] if with_ids else []), names=schema.names)
        enc.trim()
        common.give_back()

    return docs.select(*extra, common.text_of(F.col(text_col)).alias(own)).mapInArrow(run, schema)


def op1_bpe_speculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
