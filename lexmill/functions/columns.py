"""Column builders: all stays in the JVM but what needs Unicode normalisation (error rates, moderation)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions import unicode_text

MALAYALAM = r"[\x{0D00}-\x{0D7F}]"
#: The Unicode punctuation classes that scoring drops; connector punctuation stays.
SCORED_AWAY = r"[\p{Po}\p{Pd}\p{Ps}\p{Pe}\p{Pi}\p{Pf}]"
_EDGE_SPACE = r"(?U)^\s+|\s+$"


def lit_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def has_malayalam(text: Column) -> Column:
    return text.rlike(MALAYALAM)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE_SPACE, "")


def for_scoring(text: Column, *, strip_punctuation: bool = True) -> Column:
    """Canonical form, without punctuation, white space folded to single spaces, edges trimmed."""
    t = unicode_text.normalized(text)["text"]
    t = F.regexp_replace(t, SCORED_AWAY, "") if strip_punctuation else t
    return stripped(F.regexp_replace(t, r"(?U)\s+", " "))


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits over the reference's characters, spaces aside; null where the reference is empty."""
    bare = lambda c: F.regexp_replace(for_scoring(c), " ", "")
    r, h = bare(reference), bare(hypothesis)
    n = F.length(r)
    return F.when(n > 0, F.levenshtein(r, h) / n)


def lettered(reference: str, hypothesis: str) -> tuple[str, str]:
    """Each distinct word of the pair as one letter of its own; surrogates are no letters."""
    known: dict[str, str] = {}

    def letter(word: str) -> str:
        if word not in known:
            at = len(known) + 1
            known[word] = chr(at if at < 0xD800 else at + 0x800)
        return known[word]

    return "".join(map(letter, reference.split())), "".join(map(letter, hypothesis.split()))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits over the reference's words. Each word of the pair becomes one letter, so the edit distance of
    strings is that of word lists; a pair of more distinct words than Unicode has letters (1,112,063) is an error."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for r, h in batches:
            yield pd.DataFrame([(None, None) if x is None or y is None else lettered(x, y) for x, y in zip(r, h, strict=True)], columns=["r", "h"])

    pair = F.pandas_udf(run, "r string, h string")(for_scoring(reference), for_scoring(hypothesis))
    return F.when(F.length(pair["r"]) > 0, F.levenshtein(pair["r"], pair["h"]) / F.length(pair["r"]))


def longest_run(items: Column) -> Column:
    """Length of the longest run of equal neighbours."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(a: Column, x: Column) -> Column:
        n = F.when(a.last.eqNullSafe(x), a.n + 1).otherwise(1)
        return F.struct(x.alias("last"), n.alias("n"), F.greatest(a.most, n).alias("most"))

    return F.aggregate(items, start, step, lambda a: a.most)


def reasons(*rules: tuple[Column, Column | str]) -> Column:
    """Texts of the rules that hold, in order."""
    made = [F.when(rule, F.lit(text) if isinstance(text, str) else text) for rule, text in rules]
    return F.array_compact(F.array(*made)) if made else F.array().cast("array<string>")


def transcript_problems(text: Column, *, expect_malayalam: bool = True, most_repeats: int = 4, many_words: int = 8, least_variety: float = 0.35) -> Column:
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    empty = F.size(words) == 0
    looping = longest_run(words) > most_repeats
    monotonous = (F.size(words) >= many_words) & (F.size(F.array_distinct(words)) / F.size(words) < least_variety)
    foreign = text.rlike(r"\p{L}") & ~has_malayalam(text) if expect_malayalam else F.lit(False)
    return F.when(empty, F.array(F.lit("empty"))).otherwise(reasons((foreign, "wrong_script"), (looping, "repeats"), (~looping & monotonous, "low_variety")))


def proximity(left: str, right: str, window: int = 40) -> str:
    """Pattern for both terms, in either order, at most `window` characters apart."""
    gap = f".{{0,{window}}}"
    return f"(?:(?:{left}){gap}(?:{right})|(?:{right}){gap}(?:{left}))"


def moderation(text: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct<severity, rules>; rules: (name, block or flag, pattern), matched on NFC in lower case with spaces folded."""
    folded = F.regexp_replace(F.lower(unicode_text.composed(text)), r"(?U)\s+", " ")
    hits = {name: folded.rlike(f"(?iu){pattern}") for name, _, pattern in rules}
    hard = [hits[n] for n, severity, _ in rules if severity == "block"]
    blocked = F.exists(F.array(*hard), lambda x: x) if hard else F.lit(False)
    names = reasons(*[(hits[n], n) for n, _, _ in rules])
    return F.struct(F.when(blocked, "block").when(F.size(names) > 0, "flag").otherwise("allow").alias("severity"), names.alias("rules"))


def hash_position(key: Column, salt: str) -> Column:
    """Place in [0, 1): the first 8 bytes of sha256(salt:key) as a fraction."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), key.cast("string")), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / float(2**64)


def assigned_split(key: Column, *, test: float = 0.05, validation: float = 0.05, salt: str = "corpus-v1") -> Column:
    at = hash_position(key, salt)
    return F.when(at < test, "test").when(at < test + validation, "validation").otherwise("train")


def payload_for(*parts: Column) -> Column:
    """32-bit mark of several parts: the first 4 bytes of the hash of them joined by bars."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


def owner_id(key: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit("owner:"), key.cast("string")), 256), 1, 24)


def fingerprint(content: Column, length: int = 12) -> Column:
    """The first hex digits of the content's hash, to tell versions apart."""
    return F.substring(F.sha2(content, 256), 1, length)


def cosine(a: Column, b: Column) -> Column:
    """Of vectors; a zero vector has similarity 0 to all."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def dbfs(level: Column) -> Column:
    """Minus infinity for silence."""
    return F.when(level > 0, 20 * F.log10(level)).otherwise(float("-inf"))


def peak_dbfs(samples: Column) -> Column:
    return dbfs(F.array_max(F.transform(samples, lambda x: F.abs(x))))


def rms_dbfs(samples: Column) -> Column:
    power = F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x) / F.size(samples)
    return dbfs(F.sqrt(power))


def loudness_gain_db(loudness: Column, peak: Column, *, target: float, most: float = 30.0, ceiling: float = -1.0) -> Column:
    """Gain to the target, at most `most`, reduced so that the peak stays under the ceiling."""
    return F.least(F.lit(target) - loudness, F.lit(most), F.lit(ceiling) - peak)


def spoken_digits(text: Column, names: Mapping[str, str], separator: str = " ") -> Column:
    """Digit by digit; null where a character is no digit."""
    return F.when(text.rlike("^[0-9]*$"), F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: lit_map(names)[c]), separator))


def is_acronym(word: Column) -> Column:
    return word.rlike(r"^(?:[A-Z]\.?){2,6}$")


def text_error(text: Column, most: int = 5000) -> Column:
    """Error code of a text that can't be processed, else null."""
    return F.when(text.isNull() | (stripped(text) == ""), "validation_error").when(F.length(text) > most, "text_too_long")


def request_cost(path_is_json: Column, content_length: Column, most: int = 5000) -> Column:
    return F.when(path_is_json, F.least(F.greatest(F.coalesce(content_length, F.lit(1)), F.lit(1)), F.lit(most))).otherwise(1)


def parsed_keys(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"[,\s]+"), lambda k: k != ""))


def consent_status(status: Column, revoked_at: Column, expires_at: Column, as_of: Column) -> Column:
    return F.when(revoked_at.isNotNull(), "revoked").when((status == "verified") & (as_of >= expires_at), "expired").otherwise(status)


def script_predicates(char: Column) -> dict[str, Column]:
    """Whether a character is a consonant, a chillu, a vowel sign or an independent vowel."""
    classes = {"consonant": r"\x{0D15}-\x{0D3A}", "chillu": r"\x{0D54}-\x{0D56}\x{0D7A}-\x{0D7F}", "vowel_sign": r"\x{0D3E}-\x{0D4C}\x{0D57}\x{0D62}\x{0D63}", "independent_vowel": r"\x{0D05}-\x{0D14}\x{0D60}\x{0D61}"}
    return {f"is_{name}": char.rlike(f"^[{c}]$") for name, c in classes.items()}


def reference_plausibility(text: Column, seconds: Column) -> Column:
    """struct<error_code, characters_per_second, advisories> of a reference recording and what it says. Errors: no text,
    under 2 s, over 30 s. Over 25 or under 4 characters a second the transcript is doubtful; over 12 s costs time."""
    n = F.length(stripped(F.coalesce(text, F.lit(""))))
    rate = F.when(seconds > 0, n / seconds).otherwise(float("inf"))
    wrong = (n == 0) | (seconds < 2.0) | (seconds > 30.0)
    notes = reasons((rate > 25.0, "transcript_too_long"), (rate < 4.0, "transcript_too_short"), (seconds > 12.0, "recording_long"))
    return F.struct(F.when(wrong, "validation_error").alias("error_code"), rate.alias("characters_per_second"), notes.alias("advisories"))


_VERIFICATION = "passed boolean, phrase_cer double, nonce_words_found int, speaker_similarity double, reasons array<string>"


def verification_of(text: Column) -> Column:
    """A consent's verification from its JSON; keys that aren't there, and a text that isn't JSON, mean not verified."""
    v = F.from_json(text, _VERIFICATION)
    none = {"passed": F.lit(False), "phrase_cer": F.lit(1.0), "nonce_words_found": F.lit(0), "reasons": F.array().cast("array<string>")}
    return F.struct(*[F.coalesce(v[k], none[k]).alias(k) if k in none else v[k].alias(k) for k in ("passed", "phrase_cer", "nonce_words_found", "speaker_similarity", "reasons")])


def joined_chunks(chunks: Column, rate: int) -> Column:
    """Samples of array<struct<samples: array<double>, pause_ms: int>>, each followed by its pause of silence."""
    silence = lambda c: F.array_repeat(F.lit(0.0), F.floor(c.pause_ms * rate / 1000).cast("int"))
    return F.flatten(F.transform(chunks, lambda c: F.concat(c.samples, silence(c))))


def in_utc(ts: Column, zone: str) -> Column:
    """A wall-clock time of a zone as the same instant in UTC."""
    return F.to_utc_timestamp(ts, zone)


def consent_phrase(name: Column, words: Column, day: Column) -> Column:
    """What a person reads out to consent; null without a name. words: those that prove it is read today."""
    said = F.format_string(
        "ഞാൻ %s. %d-%d-%d തീയതി, എന്റെ ശബ്ദം ഉപയോഗിച്ച് കൃത്രിമ ശബ്ദം നിർമ്മിക്കാൻ ഞാൻ അനുമതി നൽകുന്നു. സ്ഥിരീകരണ വാക്കുകൾ: %s.",
        stripped(name), F.dayofmonth(day), F.month(day), F.year(day), F.array_join(words, ", "),
    )
    return F.when(stripped(name) != "", said)


def worst(rank: Sequence[str], statuses: Column) -> Column:
    """The last in rank of an array of statuses; the first of rank where there are none."""
    at = F.array_max(F.transform(statuses, lambda s: F.array_position(F.array(*map(F.lit, rank)), s)))
    return F.element_at(F.array(*map(F.lit, rank)), F.coalesce(at, F.lit(1)).cast("int"))


# Words of the stock moderation rules.
_OTP = r"otp|ഒ\s*ടി\s*പി|ഒറ്റത്തവണ\s*പാസ്?.?വേഡ്"
_CREDENTIAL = r"password|പാസ്?.?വേഡ്|പിൻ\s*നമ്പർ|\bcvv\b|atm\s*pin|\bpin\b"
_SHARE = r"share|send|പറയ|അയക്ക|തരാമോ|തരൂ|നൽക|വേണം|ചൊല്ല"
_MONEY = r"പണം|രൂപ|money|transfer|അയക്ക|ഗൂഗിൾ\s*പേ|\bupi\b|\bgpay\b|₹"
_URGENT = r"അടിയന്തര|urgent|immediately|ഉടനെ|പെട്ടെന്ന്|ഇപ്പോൾ\s*തന്നെ"
_EMERGENCY = r"അപകട|ആശുപത്രി|അറസ്റ്റ്|hospital|accident|arrest|police\s*station|ജയില"
_AUTHORITY = r"മുഖ്യമന്ത്രി|മന്ത്രി|കമ്മീഷണർ|എസ്\s*ഐ|പോലീസ്|ഐ\s*പി\s*എസ്|collector"
_PRIZE = r"ലോട്ടറി|lottery|സമ്മാനം|prize|ജാക്ക്.?പോട്ട്"
_CLAIM = r"അടിച്ചു|\bwon\b|കിട്ടി|claim|ക്ലെയിം|ജയിച്ചു"
_ACCOUNT = r"അക്കൗണ്ട്\s*നമ്പർ|account\s*number|\bifsc\b|ബാങ്ക്\s*വിവര"
_MYSELF = r"ഞാൻ\s*(?:ആണ്|തന്നെ|ആണു)|this\s+is\s+the"
#: Rules of moderation() against fraud: name, severity, pattern.
STOCK_RULES = (
    ("otp_solicitation", "block", proximity(_OTP, _SHARE)),
    ("credential_solicitation", "block", proximity(_CREDENTIAL, _SHARE)),
    ("urgent_money_transfer", "block", proximity(_URGENT, _MONEY)),
    ("relative_in_trouble_scam", "block", proximity(_EMERGENCY, _MONEY, 60)),
    ("account_details_request", "flag", _ACCOUNT),
    ("impersonation_claim", "flag", proximity(_MYSELF, _AUTHORITY, 30)),
    ("prize_lottery_scam", "flag", proximity(_PRIZE, _CLAIM)),
)


def stock_moderation(text: Column, blocked: Sequence[str] = ()) -> Column:
    """moderation() by the stock rules, and further patterns that block, named extra_1 and so on."""
    return moderation(text, [*STOCK_RULES, *[(f"extra_{i}", "block", p) for i, p in enumerate(blocked, 1)]])
