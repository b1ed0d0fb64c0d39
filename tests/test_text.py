"""The text frontend on cases that the driver's tables don't hold."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import chunking, codemix, frontend, phonemes, romanised, spoken
from lexmill.functions.numerals import cardinal, spoken_digits


@pytest.mark.parametrize(
    ("raw", "said"),
    [
        ("₹250 വേണം", "ഇരുനൂറ്റിയമ്പത് രൂപ വേണം"),
        ("₹1500", f"{cardinal(1500)} രൂപ"),
        ("₹1,25,000", f"{cardinal(125000)} രൂപ"),
        ("2024-01-26", f"{cardinal(2024)} ജനുവരി {cardinal(26)}"),
        ("26/1/2024", f"{cardinal(2024)} ജനുവരി {cardinal(26)}"),
        ("26/13/2024", f"{cardinal(2024)} {cardinal(13)} {cardinal(26)}"),
        ("10:30 ന്", f"{cardinal(10)} മണി {cardinal(30)} മിനിറ്റ് ന്"),
        ("9:00 pm", f"വൈകുന്നേരം {cardinal(9)} മണി"),
        ("50% 3km 20°C", f"{cardinal(50)} ശതമാനം {cardinal(3)} കിലോമീറ്റർ {cardinal(20)} ഡിഗ്രി സെൽഷ്യസ്"),
        ("682001 12345", f"{spoken_digits('682001')} {cardinal(12345)}"),
        ("+91 9876543210", f"പ്ലസ് {spoken_digits('91')} {spoken_digits('9876543210')}"),
        ("3rd 3ാം", "മൂന്നാം മൂന്നാം"),
        ("Dr. കി.മീ.", "ഡോക്ടർ കിലോമീറ്റർ"),
    ],
)
def test_expand(raw, said):
    assert spoken.expand(raw) == said


def test_expand_compat():
    how = spoken.Speaking(compat=True)
    assert spoken.expand("₹1500", how) == f"{cardinal(150)} രൂപ{cardinal(0)}"
    assert spoken.expand("10:30 ന്", how) == f"{cardinal(10)} മണി {cardinal(30)} മിനിറ്റ്ന്"


def test_expand_errors(spark):
    rows = spark.createDataFrame([("0th",), ("1",), (None,)], "t string").select(spoken.expanded(F.col("t")).alias("x")).select("x.*").collect()
    assert [(r.value, r.error_code) for r in rows] == [(None, "validation_error"), ("ഒന്ന്", None), (None, None)]


def test_transliterate(spark):
    assert romanised.transliterate("njan veedu poyi") == "ഞാൻ വീട് പോയി"
    assert romanised.transliterate("paranju world meeting BJP") == "പരഞു world meeting BJP"
    assert romanised.spelled("malar") == "മലർ" and romanised.spelled("maram") == "മരം"
    words = ["paranju", "world", "meeting", "BJP", "all", "njan", "cheythu", "sky", "x1", "Kollam", "email"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", romanised.romanised(F.col("w")).alias("r"))
    assert {r.w: r.r for r in df.collect()} == {w: romanised.is_romanised(w) for w in words}
    assert not romanised.is_romanised("all") and romanised.is_romanised("paranju")


def test_route():
    assert codemix.route("njan BJP work poyi.") == "ഞാൻ ബി ജെ പി work പോയി."
    assert codemix.route("U.P.S.C Kerala app-il") == "യു പി എസ് സി കേരളം app-ഇൽ"
    assert codemix.route("a work b", codemix.Mixing(policy="drop")) == ""
    assert codemix.route("work", codemix.Mixing(lexicon={"Work": "വർക്ക്"})) == "വർക്ക്"
    assert codemix.route("ok", codemix.Mixing(policy="spell_out", detection="off")) == "ഒ കെ"
    with pytest.raises(ValueError, match="policies"):
        codemix.Mixing(policy="other")


def test_segments():
    runs = codemix.segments("ഞാൻ work 12!")
    assert [(r["script"], r["text"]) for r in runs] == [("malayalam", "ഞാൻ"), ("other", " "), ("latin", "work"), ("other", " "), ("digit", "12"), ("other", "!")]
    assert codemix.segments("") == [] and runs[-1]["end"] == len("ഞാൻ work 12!")


def test_chunks():
    small = chunking.Chunking(most=20, least=1, pack=False)
    got = chunking.chunk("വി. ഡി സതീശൻ. ശരി. ok", small)
    assert [c["text"] for c in got] == ["വി. ഡി സതീശൻ.", "ശരി.", "ok"] and got[-1]["break_after"] == "none"
    assert [(c["text"], c["break_after"]) for c in chunking.chunk("aa bb.\n\ncc dd.", chunking.Chunking(most=20, least=1))] == [("aa bb.", "paragraph"), ("cc dd.", "none")]
    assert [c["break_after"] for c in chunking.chunk("one two, three four five six seven", small)] == ["clause", "word", "none"]
    assert chunking.chunk("x" * 50, small)[0]["text"] == "x" * 50
    text = "word, " * 300 + "end."
    assert " ".join(c["text"] for c in chunking.chunk(text)).split() == text.split()
    assert all(len(c["text"]) <= 220 for c in chunking.chunk(text)) and chunking.chunk(" ") == []
    with pytest.raises(ValueError, match="least"):
        chunking.Chunking(most=5, least=5)


@pytest.mark.parametrize(
    ("word", "phones"),
    [
        ("നാട്", "n aː ʈ ɨ"), ("പത്ത്", "p a t̪ː ɨ"), ("എന്റെ", "e n d̪ e"), ("കാറ്റ്", "k aː tː ɨ"), ("സംഗീതം", "s a ŋ ɡ iː t̪ a m"),
        ("ഉണ്ട്", "u ɳ ɖ ɨ"), ("അവൻ", "a ʋ a n"), ("ഇത്", "i t̪ ɨ"), ("വന്നു", "ʋ a nː ɨ"), ("abc", ""),
    ],
)
def test_phonemes(word, phones):
    assert phonemes.phonemes(word) == phones.split()


def test_phoneme_options(spark):
    assert phonemes.phonemes("അകം", phonemes.Sounding(between_vowels=True)) == ["a", "ɡ", "a", "m"]
    assert phonemes.phonemes("പത്ത്", phonemes.Sounding(clusters=False, half_vowel=False)) == ["p", "a", "t̪", "t̪"]
    words = phonemes.phonemized("പത്ത് x നാട്")
    assert words[1] == [] and phonemes.rendered(words, ascii=True) == "p a t: ax | n aa tt ax"
    df = spark.createDataFrame([(words,)], "w array<array<string>>")
    got = df.select(phonemes.rendered_column(F.col("w"), ascii=True).alias("a"), phonemes.rendered_column(F.col("w")).alias("i")).first()
    assert (got.a, got.i) == (phonemes.rendered(words, ascii=True), phonemes.rendered(words))


def test_every_sound_has_a_name():
    sounds = {*phonemes.CONSONANTS.values(), *phonemes.VOWELS.values(), *phonemes.SIGNS.values(), *phonemes.VOICED.values(), "tː", "ɨ"}
    assert all(phonemes.ascii_name(s) for s in sounds)


def test_frontend(spark):
    rows = [("₹250 ഉണ്ട്",), ("  ",), ("x" * 5001,), (None,), ("0th",)]
    df = spark.createDataFrame(rows, "t string").withColumn("d", frontend.processed(F.col("t")))
    got = df.select("d.*", frontend.summary(F.col("t"), F.col("d")).alias("s")).collect()
    assert [r.error_code for r in got] == [None, "validation_error", "text_too_long", None, "validation_error"]
    assert got[0].value.routed == "ഇരുനൂറ്റിയമ്പത് രൂപ ഉണ്ട്" and got[0].s.contains_malayalam and got[0].s.chunks == 1
    parts = frontend.chunks(df, "t", "d").collect()
    assert len(parts) == 1 and parts[0].phonemes[2] == ["u", "ɳ", "ɖ", "ɨ"]


def test_texts_are_taken_in_parts():
    """Rows of a batch in order, whole, about so many characters at a time; a longer text by itself."""
    import pandas as pd

    from lexmill.functions.outcomes import parts

    batches = [pd.Series(["x" * 900] * 5 + [None, "y" * 5000, ""]), pd.Series([], dtype=object), pd.Series([None])]
    got = [list(p) for p in parts(iter(batches), 2000)]
    assert [t for p in got for t in p] == [t for b in batches for t in b]
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 2000 for p in got) and len(got) > 4


def test_tokens_are_routed_once():
    how = codemix.Mixing()
    first = codemix.route("njan NASA-yil poyi NASA-yil", how)
    assert first == codemix.route("njan NASA-yil poyi NASA-yil", how) and set(how._known) == {"njan", "NASA-yil", "poyi"}
