"""Numbers, dates, times, money, measures and abbreviations of a text as Malayalam words."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column

from lexmill.functions.numerals import cardinal, decimal, ordinal, spoken_digits
from lexmill.functions.outcomes import outcome

# The spoken words.
MONTHS = ["ജനുവരി", "ഫെബ്രുവരി", "മാർച്ച്", "ഏപ്രിൽ", "മെയ്", "ജൂൺ", "ജൂലൈ", "ഓഗസ്റ്റ്", "സെപ്റ്റംബർ", "ഒക്ടോബർ", "നവംബർ", "ഡിസംബർ"]
CURRENCIES = {"₹": "രൂപ", "$": "ഡോളർ", "€": "യൂറോ", "£": "പൗണ്ട്", "¥": "യെൻ"}
ABBREVIATIONS = {
    "ഡോ.": "ഡോക്ടർ", "പ്രൊഫ.": "പ്രൊഫസർ", "അഡ്വ.": "അഡ്വക്കേറ്റ്", "എൻജി.": "എൻജിനീയർ",
    "കി.മീ.": "കിലോമീറ്റർ", "കി.മീ": "കിലോമീറ്റർ", "കി.ഗ്രാം": "കിലോഗ്രാം", "സെ.മീ.": "സെന്റിമീറ്റർ", "സെ.മീ": "സെന്റിമീറ്റർ",
    "ച.അടി": "ചതുരശ്ര അടി", "ശ.മാ.": "ശതമാനം", "രൂ.": "രൂപ", "നം.": "നമ്പർ",
    "Dr.": "ഡോക്ടർ", "Mr.": "മിസ്റ്റർ", "Mrs.": "മിസിസ്", "Ms.": "മിസ്", "Prof.": "പ്രൊഫസർ", "Rs.": "രൂപ", "No.": "നമ്പർ", "vs.": "വേഴ്സസ്", "etc.": "മുതലായവ",
}
UNITS = {
    "km": "കിലോമീറ്റർ", "kg": "കിലോഗ്രാം", "cm": "സെന്റിമീറ്റർ", "mm": "മില്ലിമീറ്റർ", "ml": "മില്ലിലിറ്റർ", "gb": "ജിഗാബൈറ്റ്", "mb": "മെഗാബൈറ്റ്",
    "kb": "കിലോബൈറ്റ്", "hz": "ഹെർട്സ്", "kw": "കിലോവാട്ട്", "m": "മീറ്റർ", "g": "ഗ്രാം", "l": "ലിറ്റർ",
}
PERCENT, CELSIUS, PLUS = "ശതമാനം", "ഡിഗ്രി സെൽഷ്യസ്", "പ്ലസ്"
HOUR, MINUTE, SECOND, MORNING, EVENING = "മണി", "മിനിറ്റ്", "സെക്കൻഡ്", "രാവിലെ", "വൈകുന്നേരം"


@dataclass(frozen=True)
class Speaking:
    """digits_from: a bare run of so many digits is read digit by digit. compat: numbers after a currency sign
    end where groups of three end, and a time takes the blank behind it."""

    digits_from: int = 6
    abbreviations: bool = True
    units: bool = True
    day_first: bool = True
    compat: bool = False


def quantity(literal: str) -> str:
    plain = literal.replace(",", "")
    return decimal(plain) if "." in plain else cardinal(int(plain))


def date(year: str, month: str, day: str) -> str:
    y, m, d = int(year), int(month), int(day)
    named = 1 <= m <= 12 and 1 <= d <= 31
    return f"{cardinal(y)} {MONTHS[m - 1] if named else cardinal(m)} {cardinal(d)}"


def time(hour: str, minute: str, second: str | None, half: str | None) -> str:
    said = [EVENING if half.lower() == "pm" else MORNING] if half else []
    said.append(f"{cardinal(int(hour))} {HOUR}")
    said += [f"{cardinal(int(n))} {word}" for n, word in ((minute, MINUTE), (second, SECOND)) if n and int(n)]
    return " ".join(said)


def _any(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


@cache
def _rules(how: Speaking) -> list[tuple[re.Pattern[str], Callable[..., str]]]:
    """Pattern and speech of its groups. A rule sees what those before it have left, so the order is part of the result."""
    group = r"\d{1,3}(?:,\d{2,3})*(?:\.\d+)?" if how.compat else r"\d{1,3}(?:,\d{2,3})+(?!\d)(?:\.\d+)?"
    n = rf"({group}|\d+(?:\.\d+)?)"
    blank = r"\s*(am|pm|AM|PM)?" if how.compat else r"(?:\s*(am|pm|AM|PM))?"
    rules = [
        (r"\+(\d{1,3})[\s-]?(\d{6,14})\b", lambda code, rest: f"{PLUS} {spoken_digits(code)} {spoken_digits(rest)}"),
        (r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", date),
        (r"\b(\d{1,2})[/.](\d{1,2})[/.](\d{4})\b", lambda a, b, y: date(y, b, a) if how.day_first else date(y, a, b)),
        (rf"\b(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?{blank}\b", time),
        (r"\b(\d+)ാം", lambda x: ordinal(int(x))),
        (r"(?i)\b(\d+)(?:st|nd|rd|th)\b", lambda x: ordinal(int(x))),
        (rf"([{''.join(CURRENCIES)}])\s?{n}", lambda sign, x: f"{quantity(x)} {CURRENCIES[sign]}"),
        (rf"{n}\s?%", lambda x: f"{quantity(x)} {PERCENT}"),
        (rf"{n}\s?°\s?C\b", lambda x: f"{quantity(x)} {CELSIUS}"),
        (r"\b(\d{1,3}(?:,\d{2,3})+(?:\.\d+)?)\b", quantity),
        (r"\b(\d+\.\d+)\b", decimal),
        (r"(\d+)", lambda x: spoken_digits(x) if len(x) >= how.digits_from else cardinal(int(x))),
    ]
    if how.units:
        rules.insert(9, (rf"(?i){n}\s?({_any(UNITS)})\b", lambda x, unit: f"{quantity(x)} {UNITS[unit.lower()]}"))
    if how.abbreviations:
        rules.insert(0, (f"({_any(ABBREVIATIONS)})", ABBREVIATIONS.__getitem__))
    return [(re.compile(p), f) for p, f in rules]


def expand(text: str, how: Speaking = Speaking()) -> str:
    """Numbers without words (an ordinal of 0, 20 digits in groups) are errors."""
    for pattern, say in _rules(how):
        text = pattern.sub(lambda m, say=say: say(*m.groups()), text)
    return text


def expanded(text: Column, how: Speaking = Speaking()) -> Column:
    return outcome(lambda t: expand(t, how), "string")(text)
