"""Phonemes of Malayalam words."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.columns import lit_map
from lexmill.functions.outcomes import outcome
from lexmill.functions.unicode_text import ANUSVARA, CHILLU_OF, VIRAMA

# Sounds of the letters, and names of the sounds in ASCII.
CONSONANTS = {
    "ക": "k", "ഖ": "kʰ", "ഗ": "ɡ", "ഘ": "ɡʰ", "ങ": "ŋ", "ച": "tʃ", "ഛ": "tʃʰ", "ജ": "dʒ", "ഝ": "dʒʰ", "ഞ": "ɲ",
    "ട": "ʈ", "ഠ": "ʈʰ", "ഡ": "ɖ", "ഢ": "ɖʰ", "ണ": "ɳ", "ത": "t̪", "ഥ": "t̪ʰ", "ദ": "d̪", "ധ": "d̪ʰ", "ന": "n", "ഩ": "n",
    "പ": "p", "ഫ": "pʰ", "ബ": "b", "ഭ": "bʰ", "മ": "m", "യ": "j", "ര": "ɾ", "റ": "r", "ല": "l", "ള": "ɭ", "ഴ": "ɻ", "വ": "ʋ",
    "ശ": "ʃ", "ഷ": "ʂ", "സ": "s", "ഹ": "h", "ഺ": "t",
}
VOWELS = {"അ": "a", "ആ": "aː", "ഇ": "i", "ഈ": "iː", "ഉ": "u", "ഊ": "uː", "ഋ": "ɾɨ", "ഌ": "lɨ", "എ": "e", "ഏ": "eː", "ഐ": "ai", "ഒ": "o", "ഓ": "oː", "ഔ": "au"}
SIGNS = {
    "ാ": "aː", "ി": "i", "ീ": "iː", "ു": "u", "ൂ": "uː", "ൃ": "ɾɨ", "ൄ": "ɾɨː", "െ": "e", "േ": "eː", "ൈ": "ai", "ൊ": "o", "ോ": "oː",
    "ൌ": "au", "ൗ": "au", "ൢ": "lɨ", "ൣ": "lɨː",
}
VISARGA, HALF_VOWEL, LONG = "ഃ", "ɨ", "ː"
NASALS = frozenset("mnɳɲŋ")
NASAL_BEFORE = {
    "k": "ŋ", "kʰ": "ŋ", "ɡ": "ŋ", "ɡʰ": "ŋ", "tʃ": "ɲ", "tʃʰ": "ɲ", "dʒ": "ɲ", "ʈ": "ɳ", "ʈʰ": "ɳ", "ɖ": "ɳ",
    "t̪": "n", "t̪ʰ": "n", "d̪": "n", "n": "n", "p": "m", "pʰ": "m", "b": "m", "m": "m",
}
VOICED = {"k": "ɡ", "tʃ": "dʒ", "ʈ": "ɖ", "t̪": "d̪", "p": "b"}
CLUSTERS = {("r", "r"): ("tː",), ("n", "r"): ("n", "d̪")}
ASCII = {
    "a": "a", "aː": "aa", "i": "i", "iː": "ii", "u": "u", "uː": "uu", "ɨ": "ax", "e": "e", "eː": "ee", "ai": "ai", "o": "o", "oː": "oo", "au": "au",
    "ɾɨ": "rx", "ɾɨː": "rxx", "lɨ": "lx", "lɨː": "lxx",
    "k": "k", "kʰ": "kh", "ɡ": "g", "ɡʰ": "gh", "tʃ": "c", "tʃʰ": "ch", "dʒ": "j", "dʒʰ": "jh", "ʈ": "tt", "ʈʰ": "tth", "ɖ": "dd", "ɖʰ": "ddh",
    "t̪": "t", "t̪ʰ": "th", "d̪": "d", "d̪ʰ": "dh", "t": "tr", "p": "p", "pʰ": "ph", "b": "b", "bʰ": "bh", "ŋ": "ng", "ɲ": "ny", "ɳ": "nn", "n": "n", "m": "m",
    "j": "y", "ɾ": "r", "r": "rr", "l": "l", "ɭ": "ll", "ɻ": "zh", "ʋ": "v", "ʃ": "sh", "ʂ": "ss", "s": "s", "h": "h",
}


@dataclass(frozen=True)
class Sounding:
    between_vowels: bool = False
    after_nasals: bool = True
    half_vowel: bool = True
    clusters: bool = True


class Sound(NamedTuple):
    """mark: how a consonant was written (virama, anusvara or neither), or that a vowel was the sign of u."""

    phone: str
    vowel: bool = False
    mark: str = ""


def _sounds(word: str) -> list[Sound]:
    """A consonant without sign or virama has an a after it; what isn't a letter has no sound."""
    out: list[Sound] = []
    bare = False
    for c in word:
        if bare:
            bare = False
            if c == VIRAMA:
                out[-1] = out[-1]._replace(mark="virama")
                continue
            if c in SIGNS:
                out.append(Sound(SIGNS[c], True, "u" if c == "ു" else ""))
                continue
            out.append(Sound("a", True))
        if c in CONSONANTS:
            out.append(Sound(CONSONANTS[c]))
            bare = True
        elif c in _ALONE:
            out.append(_ALONE[c])
    return [*out, Sound("a", True)] if bare else out


_ALONE = {
    **{c: Sound(p, True) for c, p in VOWELS.items()},
    **{chillu: Sound("r" if base == "ര" else CONSONANTS[base]) for base, chillu in CHILLU_OF.items()},
    ANUSVARA: Sound("m", mark="anusvara"),
    VISARGA: Sound("h"),
}


def _clustered(sounds: list[Sound]) -> list[Sound]:
    """Pairs over a virama: those with a sound of their own, and doubles as one long sound. A pair joins no third."""
    out: list[Sound] = []
    free = False
    for s in sounds:
        pair = (out[-1].phone, s.phone) if free and not s.vowel else None
        made = CLUSTERS.get(pair, (s.phone + LONG,) if pair and pair[0] == pair[1] else None) if pair else None
        if made:
            out[-1:] = [Sound(p, mark="virama") for p in made[:-1]] + [Sound(made[-1], mark=s.mark)]
            free = False
        else:
            out.append(s)
            free = s.mark == "virama"
    return out


def phonemes(word: str, how: Sounding = Sounding()) -> list[str]:
    sounds = _sounds(word)
    for i, (s, after) in enumerate(zip(sounds, sounds[1:], strict=False)):
        if s.mark == "anusvara" and not after.vowel:
            sounds[i] = s._replace(phone=NASAL_BEFORE.get(after.phone, s.phone))
    if how.clusters:
        sounds = _clustered(sounds)
    if how.half_vowel and sounds:
        if sounds[-1].mark == "virama":
            sounds.append(Sound(HALF_VOWEL, True))
        elif sounds[-1].mark == "u":
            sounds[-1] = Sound(HALF_VOWEL, True)

    def said(i: int) -> str:
        s, before = sounds[i], sounds[i - 1] if i else None
        nasal = how.after_nasals and before is not None and before.phone in NASALS
        between = how.between_vowels and before is not None and before.vowel and i + 1 < len(sounds) and sounds[i + 1].vowel
        return VOICED.get(s.phone, s.phone) if nasal or between else s.phone

    return [said(i) for i in range(len(sounds))]


def phonemized(text: str, how: Sounding = Sounding()) -> list[list[str]]:
    """Phonemes of each word between white space; a word that isn't Malayalam has none, so places stay."""
    return [phonemes(w, how) for w in text.split()]


def ascii_name(phone: str) -> str:
    return ASCII[phone] if phone in ASCII else f"{ASCII[phone.removesuffix(LONG)]}:"


def rendered(words: list[list[str]], *, ascii: bool = False, boundary: str = "|") -> str:
    return f" {boundary} ".join(" ".join(map(ascii_name, w) if ascii else w) for w in words if w)


def phoneme_lists(text: Column, how: Sounding = Sounding()) -> Column:
    return outcome(lambda t: phonemized(t, how), "array<array<string>>")(text)


def rendered_column(words: Column, *, ascii: bool = False, boundary: str = "|") -> Column:
    """Rendering of array<array<string>> as an expression of Spark."""
    name = lambda p: F.coalesce(lit_map(ASCII)[p], F.concat(lit_map(ASCII)[F.rtrim(p, F.lit(LONG))], F.lit(":"))) if ascii else p
    kept = F.filter(words, lambda w: F.size(w) > 0)
    return F.array_join(F.transform(kept, lambda w: F.array_join(F.transform(w, name), " ")), f" {boundary} ")
