"""Malayalam number words, in the system of lakhs and crores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The number words of the language.
ZERO, MINUS, POINT, LAKH, CRORE, ONE_OF = "പൂജ്യം", "മൈനസ്", "പോയിന്റ്", "ലക്ഷം", "കോടി", "ഒരു"
ONES = ["", "ഒന്ന്", "രണ്ട്", "മൂന്ന്", "നാല്", "അഞ്ച്", "ആറ്", "ഏഴ്", "എട്ട്", "ഒൻപത്"]
TEENS = ["പത്ത്", "പതിനൊന്ന്", "പന്ത്രണ്ട്", "പതിമൂന്ന്", "പതിനാല്", "പതിനഞ്ച്", "പതിനാറ്", "പതിനേഴ്", "പതിനെട്ട്", "പത്തൊൻപത്"]
TENS = ["", "", "ഇരുപത്", "മുപ്പത്", "നാൽപത്", "അമ്പത്", "അറുപത്", "എഴുപത്", "എൺപത്", "തൊണ്ണൂറ്"]
HUNDREDS = ["", "നൂറ്", "ഇരുനൂറ്", "മുന്നൂറ്", "നാനൂറ്", "അഞ്ഞൂറ്", "അറുനൂറ്", "എഴുനൂറ്", "എണ്ണൂറ്", "തൊള്ളായിരം"]
THOUSANDS = ["", "ആയിരം", "രണ്ടായിരം", "മൂവായിരം", "നാലായിരം", "അയ്യായിരം", "ആറായിരം", "ഏഴായിരം", "എണ്ണായിരം", "ഒൻപതിനായിരം"]
TEEN_THOUSANDS = ["പതിനായിരം", "പതിനൊന്നായിരം", "പന്ത്രണ്ടായിരം", "പതിമൂന്നായിരം", "പതിനാലായിരം", "പതിനയ്യായിരം", "പതിനാറായിരം", "പതിനേഴായിരം", "പതിനെട്ടായിരം", "പത്തൊൻപതിനായിരം"]
TEN_THOUSANDS = ["", "", "ഇരുപതിനായിരം", "മുപ്പതിനായിരം", "നാൽപതിനായിരം", "അമ്പതിനായിരം", "അറുപതിനായിരം", "എഴുപതിനായിരം", "എൺപതിനായിരം", "തൊണ്ണൂറായിരം"]
SIGNS = {"അ": "", "ആ": "ാ", "ഇ": "ി", "ഈ": "ീ", "ഉ": "ു", "ഊ": "ൂ", "ഋ": "ൃ", "എ": "െ", "ഏ": "േ", "ഐ": "ൈ", "ഒ": "ൊ", "ഓ": "ോ", "ഔ": "ൗ"}
STEM_ENDS = {"ം": "ത്തി", "റ്": "റ്റി", "ത്": "ത്തി"}
MOST = 10**19 - 1


class NumberError(ValueError):
    """A number that has no words here."""


def stem(word: str) -> str:
    """Form of a number word that another follows."""
    for end, by in STEM_ENDS.items():
        if word.endswith(end):
            return word[: -len(end)] + by
    return word if word.endswith("ി") else word + "ി"


def joined(head: str, tail: str) -> str:
    """Head in stem form and tail as one word; between two vowels stands a glide."""
    head = stem(head)
    return f"{head}യ{SIGNS[tail[0]]}{tail[1:]}" if tail[0] in SIGNS else head + tail


def _table(tens: list[str], teens: list[str], ones: list[str]) -> list[str]:
    """Words of 0 to 99 built of a series' tens, teens and ones; compounds of tens take the stem of the plain tens."""
    out = [*ones, *teens]
    for t in range(2, 10):
        out += [tens[t], *[joined(TENS[t], o) for o in ones[1:]]]
    return out


_BELOW_100 = _table(TENS, TEENS, ONES)
_THOUSANDS = _table(TEN_THOUSANDS, TEEN_THOUSANDS, THOUSANDS)


def _below_lakh(n: int) -> str:
    word = ""
    for part, words in ((n // 1000, _THOUSANDS), (n // 100 % 10, HUNDREDS), (n % 100, _BELOW_100)):
        if part:
            word = joined(word, words[part]) if word else words[part]
    return word


def cardinal(n: int) -> str:
    if abs(n) > MOST:
        raise NumberError(f"{n} is out of range")
    if n <= 0:
        return f"{MINUS} {cardinal(-n)}" if n else ZERO
    crores, rest = divmod(n, 10**7)
    lakhs, small = divmod(rest, 10**5)
    parts = []
    for count, word, more in ((crores, CRORE, rest), (lakhs, LAKH, small)):
        if count:
            parts.append(f"{ONE_OF if count == 1 else cardinal(count)} {stem(word) if more else word}")
    return " ".join([*parts, *([_below_lakh(small)] if small else [])])


def ordinal(n: int) -> str:
    if n < 1:
        raise NumberError("an ordinal is 1 or more")
    word = cardinal(n)
    return (word[:-1] if word[-1] in "്ം" else word) + "ാം"


def spoken_digits(digits: str, separator: str = " ") -> str:
    if not all("0" <= c <= "9" for c in digits):
        raise NumberError("not only digits")
    return separator.join([ZERO if c == "0" else ONES[int(c)] for c in digits])


def decimal(text: str) -> str:
    sign, plain = (f"{MINUS} ", text[1:]) if text.startswith("-") else ("", text.removeprefix("+"))
    whole, _, part = plain.partition(".")
    if not whole.isascii() or not whole.isdigit() or part and not part.isdigit():
        raise NumberError(f"{text} is no decimal number")
    return sign + cardinal(int(whole)) + (f" {POINT} {spoken_digits(part)}" if part else "")


def _or_null(f):
    def run(x):
        try:
            return None if x is None or x != x else f(int(x))
        except NumberError:
            return None

    return run


def _column(f):
    """Each distinct value of a batch is spelled once."""

    def spelled(numbers: pd.Series) -> pd.Series:
        words = {n: _or_null(f)(n) for n in numbers.unique()}
        return numbers.map(words)

    return F.pandas_udf(spelled, "string")


def cardinal_column(n: Column) -> Column:
    """Null where the number is null or out of range."""
    return _column(cardinal)(n)


def ordinal_column(n: Column) -> Column:
    return _column(ordinal)(n)
