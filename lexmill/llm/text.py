"""Word hashing shared by the operators on word sequences (executor side, numpy)."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_A = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: The bytes of [ \t-\r]; what bytes.split() parts at.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(rb"[\t-\r ]")
_LETTER = mix(np.arange(1, 257, dtype=U64) * _A)
_LETTER[_SPACE] = 0
_BASE = 0xD6E8FEB86659FD93
_PIECE, _LONG = 1 << 18, 1 << 22


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n; kept for the next call."""
    up, down = _powers.get(base, (np.empty(0, U64),) * 2)
    if len(up) < n:
        room = max(n, 2 * len(up))
        up, down = np.full(room, U64(base)), np.full(room, U64(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        up, down = _powers[base] = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    return up[:n], down[:n]


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _sum(data: bytes) -> int:
    """Polynomial of a word of any length, a piece at a time."""
    out, factor, step = 0, 1, pow(_BASE, _PIECE, 1 << 64)
    for at in range(0, len(data), _PIECE):
        x = _LETTER[np.frombuffer(data[at : at + _PIECE], np.uint8)]
        out += int((x * powers(_PIECE)[0][: len(x)]).sum(dtype=U64)) * factor
        factor = factor * step % (1 << 64)
    return out % (1 << 64)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words, and the count of spaces before each byte."""
    buffer = np.frombuffer(data, np.uint8)
    space = _SPACE[buffer]
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(data) > _LONG:  # one word is that long
        total = np.array([_sum(data[s:e]) for s, e in zip(start, end, strict=True)], U64)
    else:
        up, down = powers(max(len(data), _PIECE))
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_LETTER[buffer] * up[: len(data)], dtype=U64, out=sums[1:])
        total = (sums[end] - sums[start]) * down[start]
    return start, end, mix(total + (end - start).astype(U64) * _A), np.concatenate(([0], np.cumsum(space)))


def _pieces(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + _PIECE) if at + _PIECE < len(data) else None
        end = gap.end() if gap else len(data)
        yield data[at:end]
        at = end


@dataclass(frozen=True)
class Group:
    """Some texts, one after another. Text d has words bounds[d] to bounds[d + 1] - 1 of h."""

    texts: list[bytes]
    h: np.ndarray
    bounds: np.ndarray
    single: np.ndarray  # whether single blanks part the text's words, with none around them

    def joined(self, d: int) -> bytes:
        """The words of a text with one blank between."""
        return self.texts[d] if self.single[d] else b" ".join(self.texts[d].split())


def groups(all_texts: Iterable[bytes | None], lower: bool = False) -> Iterator[Group]:
    """Texts in order (null as empty), in groups of about 256 KB, or one longer text. bytes.split() tells words."""
    some, size = [], 0
    for text in all_texts:
        text = (text.lower() if lower else text) if text else b""
        if some and size + len(text) > _PIECE:
            yield _group(some)
            some, size = [], 0
        some.append(text)
        size += len(text) + 1
    if some:
        yield _group(some)


def _group(some: list[bytes]) -> Group:
    length = np.array([len(t) for t in some])
    if len(some) == 1 and length[0] > _PIECE:
        h = [_words(piece)[2] for piece in _pieces(some[0])]
        h = np.concatenate(h) if h else np.empty(0, U64)
        return Group(some, h, np.array([0, len(h)]), np.array([False]))
    data = b" ".join(some)
    at = np.concatenate(([0], np.cumsum(length + 1)))
    start, _, h, spaces = _words(data)
    bounds = start.searchsorted(at)
    gaps = spaces[at[:-1] + length] - spaces[at[:-1]]
    blanks = np.array([t.count(b" ") for t in some])
    return Group(some, h, bounds, (gaps == np.diff(bounds) - 1) & (blanks == gaps))


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive words; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.full(n, U64(seed * 2 + 1))
    for i in range(k):
        out = out * _A + h[i : i + n]
    return mix(out)


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def shingle_sets(all_texts: Iterable[bytes | None], k: int = 4) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of the k-word shingles of its words, A-Z lower-cased."""
    for group in groups(all_texts, lower=True):
        every = grams(group.h, k, seed=k)
        for a, b in itertools.pairwise(group.bounds.tolist()):
            if b - a >= k:
                yield _distinct(every[a : b - k + 1])
            else:
                yield grams(group.h[a:b], b - a, seed=b - a) if b > a else np.empty(0, U64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def shingles(text: bytes | None, k: int = 4) -> np.ndarray:
    return next(shingle_sets([text], k))
