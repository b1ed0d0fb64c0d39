"""Scripts of a text, and what becomes of its words in Latin letters."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.outcomes import outcome, parts
from lexmill.functions.romanised import is_romanised, transliterate

# Names of the Latin letters, a to z.
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", ["ഏ", "ബി", "സി", "ഡി", "ഇ", "എഫ്", "ജി", "എച്ച്", "ഐ", "ജെ", "കെ", "എൽ", "എം", "എൻ", "ഒ", "പി", "ക്യൂ", "ആർ", "എസ്", "ടി", "യു", "വി", "ഡബ്ല്യു", "എക്സ്", "വൈ", "സെഡ്"], strict=True))
POLICIES = ("keep", "transliterate", "spell_out", "drop")
DETECTIONS = ("evidence", "permissive", "off")

_ACRONYM = re.compile(r"(?:[A-Z]\.?){2,6}")
_LATIN = re.compile(r"[A-Za-z][A-Za-z'.-]*")


@dataclass(frozen=True)
class Mixing:
    """policy: of Latin words that are neither acronyms nor romanised. detection: how much it takes to be romanised.
    lexicon: words that have a fixed form, as written or in any case."""

    policy: str = "keep"
    detection: str = "evidence"
    acronyms: bool = True
    lexicon: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.policy not in POLICIES or self.detection not in DETECTIONS:
            raise ValueError(f"policies: {', '.join(POLICIES)}; detections: {', '.join(DETECTIONS)}")
        object.__setattr__(self, "_folded", {k.lower(): v for k, v in self.lexicon.items()})
        object.__setattr__(self, "_known", {})

    def fixed(self, word: str) -> str | None:
        return self.lexicon.get(word, self._folded.get(word.lower()))


def script(c: str) -> str:
    if "ഀ" <= c <= "ൿ":
        return "malayalam"
    if c.isascii() and c.isalpha():
        return "latin"
    return "digit" if c.isdigit() else "other"


def segments(text: str) -> list[dict]:
    """script, text, start, end of each run of one script; together they are the text."""
    out, at = [], 0
    for kind, run in groupby(text, script):
        piece = "".join(run)
        out.append({"script": kind, "text": piece, "start": at, "end": at + len(piece)})
        at += len(piece)
    return out


def is_acronym(word: str) -> bool:
    return _ACRONYM.fullmatch(word) is not None


def spell(word: str) -> str:
    return " ".join(LETTERS.get(c, c) for c in word.lower() if c.isalpha())


def _part(word: str, how: Mixing) -> str:
    if (fixed := how.fixed(word)) is not None:
        return fixed
    if how.acronyms and is_acronym(word):
        return spell(word)
    evidence = how.detection == "evidence"
    if how.detection != "off" and is_romanised(word, evidence=evidence):
        return transliterate(word, evidence=evidence)
    return {"keep": lambda: word, "transliterate": lambda: transliterate(word, evidence=False), "spell_out": lambda: spell(word), "drop": str}[how.policy]()


def _token(token: str, how: Mixing) -> str:
    """As _routed has it. What became of a short token is kept for the next time, of 200,000 tokens at most."""
    out = how._known.get(token)
    if out is None:
        out = _routed(token, how)
        if len(token) <= 64:
            if len(how._known) >= 200_000:
                how._known.clear()
            how._known[token] = out
    return out


def _routed(token: str, how: Mixing) -> str:
    """Parts between hyphens go their own ways; stops, hyphens and apostrophes at the end stay."""
    if (fixed := how.fixed(token)) is not None:
        return fixed
    core = token.rstrip(".-'")
    return "-".join(_part(p, how) if p else p for p in core.split("-")) + token[len(core) :]


def route(text: str, how: Mixing = Mixing()) -> str:
    return re.sub(r"[^\S\n]{2,}", " ", _LATIN.sub(lambda m: _token(m.group(), how), text)).strip()


def routed(text: Column, how: Mixing = Mixing()) -> Column:
    return outcome(lambda t: route(t, how), "string")(text)


#: What str.isdigit() takes for a digit, Malayalam letters aside, as a class of Spark's patterns.
_DIGIT = (
    r"\p{Nd}\x{B2}\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}"
    r"\x{24EA}\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}"
)
_SCRIPTS = {"malayalam": r"[\x{0D00}-\x{0D7F}]", "latin": "[A-Za-z]", "digit": rf"[{_DIGIT}&&[^\x{{0D00}}-\x{{0D7F}}]]", "other": rf"[^A-Za-z\x{{0D00}}-\x{{0D7F}}{_DIGIT}]"}


def script_runs(text: Column, kind: str) -> Column:
    """How many runs of one script segments() finds; all in the JVM."""
    return F.regexp_count(text, F.lit(f"{_SCRIPTS[kind]}+")).cast("long")


_KINDS = ("malayalam", "latin", "digit", "other")


@cache
def _kind_of() -> np.ndarray:
    """The place in _KINDS of each code point."""
    return np.fromiter((_KINDS.index(script(chr(c))) for c in range(0x110000)), np.uint8, 0x110000)


def run_counts(texts: list[str]) -> np.ndarray:
    """How many runs of each of _KINDS segments() finds: a row for each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    kinds = _kind_of()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    first = np.ones(len(kinds), bool)
    np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
    starts = np.cumsum(sizes) - sizes
    first[starts[sizes > 0]] = True
    at = np.flatnonzero(first)
    row = np.searchsorted(starts + sizes, at, side="right")
    return np.bincount(row * len(_KINDS) + kinds[at], minlength=len(texts) * len(_KINDS)).reshape(-1, len(_KINDS))


def script_counts(text: Column) -> Column:
    """struct of how many runs of each script segments() finds; of null all are null. By arrays of code points."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in parts(batches, 1 << 20):
            there = batch.notna().to_numpy()
            out = pd.DataFrame(run_counts([t or "" for t in batch]), columns=list(_KINDS)).astype("Int64")
            out.loc[~there] = pd.NA
            yield out

    return F.pandas_udf(run, ", ".join(f"{k} long" for k in _KINDS))(text)


def segmented(text: Column) -> Column:
    return outcome(segments, "array<struct<script:string,text:string,start:int,end:int>>")(text)
