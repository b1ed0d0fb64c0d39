"""Cases, their results, the report as one document; error codes' statuses and a verification's defaults."""

import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import columns as C
from lexmill.functions import outcomes
from lexmill.operators import evaluation

CASES = [("a", "names", "one two"), ("b", "names", "x"), ("c", "numbers", "y"), ("d", "numbers", "z"), ("e", None, "w")]
OUT = "id string, normalized_text string, audio_seconds double, generation_seconds double, heard string, error string"


@pytest.fixture(scope="module")
def done(spark):
    cases = spark.createDataFrame(CASES, "id string, category string, text string")
    came = [("a", "one two", 2.00049, 1.0, "one too", None), ("b", "x", 0.0, 1.0, None, None), ("c", "y", 1.0, 1.0, "y", "text_too_long"), ("e", "w", 4.0, 1.0, "w", None), ("f", "?", 1.0, 1.0, "?", None)]
    return evaluation.results(cases, spark.createDataFrame(came, OUT))


def test_results(done):
    got = {r.id: r for r in done.collect()}
    assert set(got) == set("abcde")
    a = got["a"]
    assert (a.audio_seconds, a.real_time_factor, a.cer, a.wer, a.error) == (2.0, round(1 / 2.00049, 4), pytest.approx(1 / 6), 0.5, None)
    assert got["b"].real_time_factor == float("inf") and got["b"].cer is None and got["b"].error is None
    for k, error in (("c", "text_too_long"), ("d", evaluation.MISSING)):
        assert (got[k].error, got[k].normalized_text, got[k].audio_seconds, got[k].real_time_factor, got[k].cer, got[k].asr_text) == (error, "", 0.0, float("inf"), None, None)


def test_report_is_one_document(spark, done, tmp_path):
    path = str(tmp_path / "report.json")
    evaluation.write_document(done, path, backend="stub", title="പരിശോധന")
    text = open(path, encoding="utf-8").read()
    report = json.loads(text)
    assert "പരിശോധന" in text and "\n" in text and list(report) == ["backend", "title", "summary", "failed"]
    assert {(x["category"], x["overall"], x["cases"], x["errors"]) for x in report["summary"]} == {("names", 0, 2, 0), ("numbers", 0, 2, 2), (None, 0, 1, 0), (None, 1, 5, 2)}
    assert [x["id"] for x in report["failed"]] == ["c", "d"]
    with pytest.raises(FileExistsError):
        evaluation.write_document(done, path)
    none = json.loads(evaluation.document(done.limit(0)))
    assert none["failed"] == [] and [x["cases"] for x in none["summary"]] in ([], [0])


def test_chosen(spark):
    cases = spark.createDataFrame(CASES, "id string, category string, text string")
    assert evaluation.chosen(cases).count() == 5 and {r.id for r in evaluation.chosen(cases, ["numbers"]).collect()} == {"c", "d"} and evaluation.chosen(cases, []).count() == 0
    assert [tuple(r) for r in evaluation.category_counts(cases).collect()] == [("names", 2), ("numbers", 2), ("None", 1)]


def test_statuses_and_defaults(spark):
    df = spark.createDataFrame([(c,) for c in [*outcomes.ERROR_CODES, None, "other"]], "c string").select("c", outcomes.status_of(F.col("c")).alias("s"))
    got = dict(map(tuple, df.collect()))
    assert got[None] == 200 and got["other"] == got["internal_error"] == got["configuration_error"] == 500 and got["text_too_long"] == 413 and set(outcomes.STATUSES) < set(outcomes.ERROR_CODES)
    texts = ["{}", None, "no json", '{"passed": true, "phrase_cer": 0.1, "nonce_words_found": 3, "speaker_similarity": 0.9, "reasons": ["x"]}', '{"phrase_cer": null}']
    got = [tuple(r.v) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(C.verification_of(F.col("t")).alias("v")).collect()]
    none = (False, 1.0, 0, None, [])
    assert got == [none, none, none, (True, 0.1, 3, 0.9, ["x"]), none]
