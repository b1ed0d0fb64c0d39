import json
import random

import pytest

from lexmill.sources import listings


def test_listing(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('u1\ta.wav\t"quoted\ts1\textra\nshort\tline\n\nu2\tb.wav\t\ts2\n')
    with pytest.warns(UserWarning, match=r"1 lines .*a\.tsv: line 2"):
        rows = sorted(map(tuple, listings.read_listing(spark, str(tmp_path / "a.tsv"), "/x").collect()))
    assert rows == [("u1", "/x/a.wav", '"quoted', "s1"), ("u2", "/x/b.wav", "", "s2")]


def test_manifest(spark, tmp_path):
    good = {"id": "1", "audio_path": "a", "source": "s", "license_id": "l", "commercial_use_permitted": True, "text": "t", "speaker_id": "p", "duration_seconds": 1.5, "sample_rate": 24000, "language": "ml"}
    (tmp_path / "good").write_text(json.dumps(good) + "\n")
    df = listings.read_manifest(spark, str(tmp_path / "good"))
    listings.write_manifest(df, str(tmp_path / "out"))
    assert listings.read_manifest(spark, str(tmp_path / "out")).collect() == df.collect()
    lines = [good, good | {"duration_seconds": 0}, good | {"language": "en"}, {k: v for k, v in good.items() if k != "license_id"}]
    (tmp_path / "bad").write_text("\n".join([*map(json.dumps, lines), "{broken"]))
    found = sorted(r.defect or "" for r in listings.read_manifest(spark, str(tmp_path / "bad"), strict=False).collect())
    assert found == ["", "duration_seconds isn't positive", "language isn't ml", "no license_id", "not valid JSON"]
    with pytest.raises(listings.ManifestError, match=r"manifest: file:.*/bad: line 2: duration_seconds isn't positive") as e:
        listings.read_manifest(spark, str(tmp_path / "bad"))
    assert e.value.line == 2


def test_blocklist(spark, tmp_path):
    (tmp_path / "b.txt").write_text("# names\n\n  One Name \nother\n")
    assert [r.name for r in listings.read_blocklist(spark, str(tmp_path / "b.txt")).collect()] == ["One Name", "other"]


def test_lines_are_numbered_across_ranges(spark, tmp_path):
    """Files that many tasks read in ranges, lines of all lengths, blank ones and ones longer than a range among them."""
    rng = random.Random(2)
    want = {}
    (tmp_path / "in").mkdir()
    for name in "abc":
        lines = ["x" * rng.choice([0, 1, 5, 40, 700, 9000]) for _ in range(400)]
        (tmp_path / "in" / name).write_text("\n".join(lines) + ("\n" if name != "c" else ""))
        want |= {(name, i): x for i, x in enumerate(lines, 1) if not (name == "c" and i == 400 and not x)}
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("4096", "1024"), strict=True):
        spark.conf.set(k, v)
    try:
        df = listings.numbered_lines(spark, str(tmp_path / "in"))
        assert spark.read.text(str(tmp_path / "in")).rdd.getNumPartitions() > 50
        got = {(r.file.rpartition("/")[2], r.line): r.value for r in df.collect()}
        assert got == want and df.count() == len(want)
        good = {"id": "1", "audio_path": "a", "source": "s", "license_id": "l", "commercial_use_permitted": True, "text": "t", "speaker_id": "p", "duration_seconds": 1.5, "sample_rate": 24000, "language": "ml"}
        many = [json.dumps(good | {"id": str(i), "text": "t" * rng.randint(0, 300)}) for i in range(900)]
        many[333] = "  "
        many[456], many[789] = "{}", "{"
        (tmp_path / "m").write_text("\n".join(many))
        with pytest.raises(listings.ManifestError, match="line 457: no id"):
            listings.read_manifest(spark, str(tmp_path / "m"))
        loose = listings.read_manifest(spark, str(tmp_path / "m"), strict=False)
        assert {(r.line, r.defect) for r in loose.filter("defect IS NOT NULL").collect()} == {(457, "no id"), (790, "not valid JSON")} and loose.count() == 899
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)
