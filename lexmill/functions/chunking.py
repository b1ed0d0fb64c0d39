"""Text in pieces of bounded length with the pause after each."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column

from lexmill.functions.outcomes import TextError, outcome

#: Milliseconds after a piece, by the break that follows it.
PAUSES = {"none": 0, "word": 60, "clause": 180, "sentence": 380, "paragraph": 700}
Piece = tuple[str, str]
_LETTER = re.compile("[A-Za-zഅ-ഌഎ-ഐഒ-ഔക-ഺൟ]")
_STOP = re.compile(r"(?<=[.!?।॥])\s+")
_CLAUSE = re.compile(r"(?<=[,;:—-])\s+")


@dataclass(frozen=True)
class Chunking:
    """most: characters of a piece, but a longer word stays whole. least: a shorter piece joins the next."""

    most: int = 220
    least: int = 40
    pack: bool = True

    def __post_init__(self):
        if self.most < 1 or self.least >= self.most:
            raise TextError("a piece holds 1 character or more, and least is under most")


def ends_in_initial(text: str) -> bool:
    """Whether the word before the final stop is one letter with its signs, as in names."""
    words = text.removesuffix(".").split()
    return bool(words) and len(_LETTER.findall(words[-1])) == 1


def sentences(paragraph: str) -> list[str]:
    out, held = [], 0
    for gap in _STOP.finditer(paragraph):
        own = paragraph[held : gap.start()]
        if own.endswith(".") and ends_in_initial(own):
            continue
        out.append(own.strip())
        held = gap.end()
    return [s for s in [*out, paragraph[held:].strip()] if s]


def joined(pieces: list[Piece], may: Callable[[Piece], bool], most: int) -> list[Piece]:
    """Each piece is put to the one before it where that one may grow and the two fit."""
    out: list[Piece] = []
    for text, strength in pieces:
        if out and may(out[-1]) and len(out[-1][0]) + 1 + len(text) <= most:
            text = f"{out.pop()[0]} {text}"
        out.append((text, strength))
    return out


def fitted(text: str, strength: str, most: int) -> Iterator[Piece]:
    """The text whole, or by clauses, or by words."""
    text = text.strip()
    if len(text) <= most:
        yield from [(text, strength)] if text else []
        return
    clauses = _CLAUSE.split(text)
    if len(clauses) > 1:
        for i, clause in enumerate(clauses, 1):
            yield from fitted(clause, strength if i == len(clauses) else "clause", most)
        return
    runs = joined([(w, "word") for w in text.split()], lambda _: True, most)
    yield from [*runs[:-1], (runs[-1][0], strength)]


def pieces(text: str, how: Chunking = Chunking()) -> list[Piece]:
    out: list[Piece] = []
    paragraphs = [p for p in re.split(r"\n\s*\n", text) if p.strip()]
    for i, paragraph in enumerate(paragraphs, 1):
        found = sentences(paragraph.strip())
        last = "none" if i == len(paragraphs) else "paragraph"
        for j, sentence in enumerate(found, 1):
            out += fitted(sentence, last if j == len(found) else "sentence", how.most)
    if how.pack:
        out = joined(out, lambda p: p[1] not in ("paragraph", "word"), how.most)
    return joined(out, lambda p: len(p[0]) < how.least, how.most)


def chunk(text: str, how: Chunking = Chunking()) -> list[dict]:
    return [{"index": i, "text": t, "break_after": b, "pause_ms": PAUSES[b]} for i, (t, b) in enumerate(pieces(text, how))]


CHUNK = "struct<index:int,text:string,break_after:string,pause_ms:int>"


def chunked(text: Column, how: Chunking = Chunking()) -> Column:
    return outcome(lambda t: chunk(t, how), f"array<{CHUNK}>")(text)
