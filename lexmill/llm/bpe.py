"""BPE encoding by dynamic programming over prefixes, and decoding.

A sequence of tokens is the encoding of its text exactly if each two neighbours are the encoding of theirs.
So each prefix of a word has one last token: the token that ends there, among those the automaton reports as
suffixes of the prefix, that is compatible with the last token of what precedes it. Back-pointers from the
word's end give the ids; no merge is ever carried out. A word of n letters takes time in proportion to n.

Words don't depend on what stands around them, so each task encodes a word once, in a cache of bounded size.
The vocabulary file is read by the driver (its path is a parameter), its 2 MB go to the executors.

Null or empty text: no tokens, decoded to the empty text. Null ids are kept; repeated rows are encoded each by itself. Very
long texts are encoded whole, words of any length too. Other columns don't matter, whatever their names. Empty table: empty result. Strings of special tokens in a text become those tokens, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import workers

#: White space of the vocabulary's patterns; str.split() would also part at \x1c to \x1f.
_SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
_ODD = re.compile("[\\x1c-\\x1f]")
_END = 0xE000
_NEVER = 1 << 60


def _byte_chars() -> list[str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    more = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(more)) for b in range(256)]


class _Recent:
    """ids of words, packed, in about `most` bytes: what wasn't asked for while half of that came anew is forgotten."""

    def __init__(self, most: int):
        self.most, self.size, self.young, self.old = most, 0, {}, {}

    def get(self, key: str) -> list[int] | None:
        out = self.young.get(key)
        if out is None and (out := self.old.get(key)) is not None:
            self._put(key, out)
        return None if out is None else memoryview(out).cast("I").tolist()

    def put(self, key: str, value: list[int]) -> None:
        self._put(key, array("I", value).tobytes())

    def _put(self, key: str, value: bytes) -> None:
        if self.size > self.most // 2:
            self.size, self.old, self.young = 0, self.young, {}
        self.size += 180 + len(key) + len(value)
        self.young[key] = value


class Codec(dict):
    """Maps a piece of text without white space to (number of ids, ids as text, decoded text), in about `most` bytes."""

    most, most_words, most_pairs = 64 << 20, 48 << 20, 200_000

    def __init__(self, spec: str):
        super().__init__()
        self.size = 0
        spec = json.loads(spec)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: t for t, i in self.special.items()})
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self._word = regex.compile(split.replace(r"[^\s", "[^" + _SPACE[1:-1]))
        self._space = re.compile(_SPACE + "+")
        self._bytes = _byte_chars()
        # A token's letters; the one that ends a word is another letter than the same one within.
        letters = lambda t: t[: -len(end) - 1] + chr(_END + ord(t[-len(end) - 1])) if t.endswith(end) and len(t) > len(end) else t
        vocab = model["vocab"]
        self._parts: dict[int, tuple[int, int, int]] = {}
        self._rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pair = (vocab[a], vocab[b])
            self._rank[pair] = rank
            self._parts.setdefault(vocab[a + b], (*pair, rank))
        self._ok: dict[int, bool] = {}
        self._words = _Recent(self.most_words)
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._tokens = ahocorasick.Automaton()
        reached: set[int] = set()
        for t, i in sorted(vocab.items(), key=lambda x: self._parts.get(x[1], (0, 0, -1))[2]):
            # Of a merged token's string the encoding may be another one; such a token ends no prefix.
            if (p := self._parts.get(i)) is None and len(letters(t)) == 1 or p and p[0] in reached and p[1] in reached and self._meet(p[0], p[1], p[2]):
                reached.add(i)
                self._tokens.add_word(letters(t), (len(letters(t)), i))
        self._tokens.make_automaton()

    def _spine(self, token: int, side: int, known: dict[int, list[tuple[int, int]]]) -> list[tuple[int, int]]:
        """Tokens at one edge of a token while it forms, each with the rank of the merge that makes it."""
        if (out := known.get(token)) is None:
            p = self._parts.get(token)
            out = known[token] = [(token, -1)] if p is None else [*self._spine(p[side], side, known), (token, p[2])]
        return out

    def _meet(self, a: int, b: int, own: int = _NEVER) -> bool:
        """No merge takes a letter from both sides before both tokens (then merge `own`) have formed."""
        x, y = self._spine(a, 1, self._right), self._spine(b, 0, self._left)
        i = j = 0
        while True:
            nx = x[i + 1][1] if i + 1 < len(x) else own
            ny = y[j + 1][1] if j + 1 < len(y) else own
            r = self._rank.get((x[i][0], y[j][0]), _NEVER)
            if r < nx and r <= ny:  # of equal pairs the left one merges first
                return False
            if nx == ny == own:
                return True
            if nx <= ny:
                i += 1
            else:
                j += 1

    def word(self, letters: str) -> list[int]:
        """ids of a word given by its letters."""
        n = len(letters)
        last, back, known = [-1] * (n + 1), [0] * (n + 1), self._ok
        for at, (size, token) in self._tokens.iter(letters):
            at += 1
            if last[at] >= 0:
                continue
            start = at - size
            if start:
                before = last[start]
                if before < 0:
                    continue
                pair = before << 32 | token
                ok = known.get(pair)
                if ok is None:
                    if len(known) >= self.most_pairs:
                        known.clear()
                    ok = known[pair] = self._meet(before, token)
                if not ok:
                    continue
            last[at], back[at] = token, start
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()  # letter by letter, so no final sigma

    def _word_ids(self, word: str) -> list[int]:
        """ids of one word of the split pattern, normalised; words that differ only in what stands around them share it."""
        if (out := self._words.get(word)) is None:
            letters = word if word.isascii() and word.isalpha() else "".join([self._bytes[b] for b in word.encode()])
            out = self.word(letters[:-1] + chr(_END + ord(letters[-1])))
            if len(word) <= 64:
                self._words.put(word, out)
        return out

    def ids(self, piece: str) -> list[int]:
        if piece.isascii() and piece.isalpha():
            return self._word_ids(piece.lower())
        out, at = [], 0
        for m in [*(self._special.finditer(piece) if self._special else ()), None]:
            for w in self._word.findall(self._normal(piece[at : m.start() if m else None])):
                out += self._word_ids(w)
            if m:
                out.append(self.special[m.group()])
                at = m.end()
        return out

    def text(self, ids: list[int]) -> str:
        """Tokens joined by one space: the vocabulary names no decoder."""
        return " ".join([self.names[i] for i in ids])

    def __missing__(self, piece: str) -> tuple[int, str, str]:
        ids = self.ids(piece)
        out = (len(ids), " ".join(map(str, ids)), self.text(ids))
        if len(piece) <= 64:
            if self.size > self.most:  # pieces that are frequent come back at once, from the words they share
                self.clear()
                self.size = 0
            self.size += 330 + len(piece) + len(out[1]) + len(out[2])
            self[piece] = out
        return out

    def pieces(self, text: str) -> list[tuple[int, str, str]]:
        parts = text.split() if not _ODD.search(text) else self._space.split(text)
        return [x for x in map(self.__getitem__, filter(None, parts)) if x[0]]

    def encode(self, text: str) -> list[int]:
        return [int(i) for x in self.pieces(text) for i in x[1].split(" ")]


_codecs: dict[str, Codec] = {}
workers.cache("bpe", _codecs.clear)


def codec(spec: str) -> Codec:
    """The codec of a vocabulary; one to a worker process, which later tasks use again."""
    workers.begin("bpe")
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def load(path: str | None = None) -> str:
    """Content of a vocabulary file; without a path that of the public tokenizers' word_bpe_49k.json."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def _mapped(df: DataFrame, columns: list[str], schema: str, kinds: pa.Schema, spec: str, row) -> DataFrame:
    workers.ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(spec)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value)
        for batch in it:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                out = [row(coder, *x) for x in zip(*(c.to_pylist() for c in part.columns), strict=True)]
                yield pa.RecordBatch.from_pylist(out, kinds)

    return df.select(*columns).mapInArrow(batches, schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>."""

    def row(coder: Codec, doc_id: int | None, text: str | None) -> dict:
        return {"doc_id": doc_id, "ids": coder.encode(text or "")}

    return _mapped(docs, ["doc_id", "text"], "doc_id long, ids array<int>", pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]), load(path), row)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text."""

    def row(coder: Codec, doc_id: int | None, ids: list[int] | None) -> dict:
        return {"doc_id": doc_id, "text": coder.text(ids or [])}

    return _mapped(encoded, ["doc_id", "ids"], "doc_id long, text string", pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), load(path), row)


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, without ids of every document in the plan."""
    workers.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    sha = lambda parts: hashlib.sha256(" ".join(parts).encode()).hexdigest()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(shared.value)
        for batch in it:
            if not batch.num_rows:
                continue
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            rows = []
            for i, text in zip(ids, texts, strict=True):
                found = coder.pieces(text.as_py() or "")
                rows.append((i, sum([x[0] for x in found]), sha([x[1] for x in found]), sha([x[2] for x in found])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _DIGESTS, strict=True)], schema=_DIGESTS)

    return docs.select("doc_id", "text").mapInArrow(batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
