"""Canonical form of Malayalam text, with counts of what was changed."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.outcomes import parts

# Fixed values of the script: letters, signs and their canonical forms.
VIRAMA, ZWJ, ZWNJ, ANUSVARA = "്", "‍", "‌", "ം"
CHILLU_OF = {"ണ": "ൺ", "ന": "ൻ", "ര": "ർ", "ല": "ൽ", "ള": "ൾ", "ക": "ൿ"}
ARCHAIC = {"ൟ": "ഈ", "ൔ": ANUSVARA, "ൕ": "യ" + VIRAMA, "ൖ": "ഴ" + VIRAMA, "ൎ": "ർ", "ൌ": "ൗ"}
DIGITS = {"൦": "0", "൧": "1", "൨": "2", "൩": "3", "൪": "4", "൫": "5", "൬": "6", "൭": "7", "൮": "8", "൯": "9", "൰": "10", "൱": "100", "൲": "1000"}
PUNCTUATION = {"।": ".", "॥": ".", "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", " ": " ", "​": "", "﻿": ""}
LEGACY = {"ൻന": "ന്ന", "ൻമ": "ന്മ", "ൺട": "ണ്ട", "ൺമ": "ണ്മ"}

COUNTERS = ("control_stripped", "chillu_composed", "legacy_nta_fixed", "legacy_fixed", "archaic_mapped", "zero_width_stripped", "digits_converted")


def _one_of(keys) -> str:
    return "|".join(map(re.escape, keys))


def _passes(legacy: bool, digits: bool) -> list[tuple[str | None, re.Pattern[str], dict[str, str] | str]]:
    """(counter, pattern, replacement) in the order in which they must run."""
    nta = ("legacy_nta_fixed", re.compile("ൻറ"), "ന്റ")
    return [
        ("control_stripped", re.compile(r"[\x00-\x08\x0b-\x1f\x7f]"), ""),
        ("chillu_composed", re.compile(f"(?:{_one_of(CHILLU_OF)}){VIRAMA}{ZWJ}"), {k + VIRAMA + ZWJ: v for k, v in CHILLU_OF.items()}),
        nta,
        *([("legacy_fixed", re.compile(_one_of(LEGACY)), LEGACY)] if legacy else []),
        ("archaic_mapped", re.compile(_one_of(ARCHAIC)), ARCHAIC),
        ("zero_width_stripped", re.compile(f"[{ZWJ}{ZWNJ}]"), ""),
        nta,  # what a joiner kept apart till now; so that a second run changes nothing
        *([("digits_converted", re.compile(_one_of(DIGITS)), DIGITS)] if digits else []),
        (None, re.compile(_one_of(PUNCTUATION)), PUNCTUATION),
        (None, re.compile(f"{VIRAMA}{{2,}}"), VIRAMA),
        (None, re.compile(r"[^\S\n]+"), " "),
        (None, re.compile(r"\n{3,}"), "\n\n"),
    ]


_PASSES = {(a, b): _passes(a, b) for a in (False, True) for b in (False, True)}


def normalize(text: str, *, legacy: bool = False, digits: bool = True) -> tuple[str, dict[str, int]]:
    counts = dict.fromkeys(COUNTERS, 0)
    text = unicodedata.normalize("NFC", text)
    for counter, pattern, to in _PASSES[legacy, digits]:
        text, n = pattern.subn((lambda m, to=to: to[m.group()]) if isinstance(to, dict) else to, text)
        if counter:
            counts[counter] += n
    return "\n".join([line.strip() for line in text.split("\n")]).strip(), counts


def normalized(text: Column, *, legacy: bool = False, digits: bool = True) -> Column:
    """struct<text, counters, changed>; null text: null. Python, for Spark has no Unicode normalisation."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in parts(batches):
            rows = []
            for t in batch:
                if t is None:
                    rows.append((None, *[None] * len(COUNTERS), None))
                else:
                    out, counts = normalize(t, legacy=legacy, digits=digits)
                    rows.append((out, *counts.values(), out != t))
            yield pd.DataFrame(rows, columns=["text", *COUNTERS, "changed"])

    return F.pandas_udf(run, f"text string, {', '.join(f'{c} long' for c in COUNTERS)}, changed boolean")(text)


def composed(text: Column) -> Column:
    """NFC; null text: null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in parts(batches):
            yield pd.Series([None if t is None else unicodedata.normalize("NFC", t) for t in batch], dtype=object)

    return F.pandas_udf(run, "string")(text)


def decomposed_chillu(text: Column) -> Column:
    """Each chillu letter as its consonant with virama and joiner, for lexicons that are older than the letters."""
    for base, chillu in CHILLU_OF.items():
        text = F.replace(text, F.lit(chillu), F.lit(base + VIRAMA + ZWJ))
    return text
