"""Each operator on hard rows: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import bpe, graph, labelled, mixing, near_dedup, pii, quality_classifier, quality_rules, staging, substring_dedup, toxicity, voronoi, warc
from lexmill.llm.text import grams, groups, shingles

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rep long, mark string, kept boolean"
_rng = random.Random(5)
_words = ["".join(_rng.choice("etaoin") for _ in range(_rng.randint(1, 6))) for _ in range(900)]
LONG = " ".join(_rng.choice(_words) for _ in range(30_000))
BASE = [_rng.choice(_words) for _ in range(300)]
PASSAGE = [_rng.choice(_words) for _ in range(60)]
TEXTS = [
    None, "", "   \n\t", "a", "a b c", "same same same " * 200, LONG, " ".join(BASE), " ".join(BASE), " ".join([*BASE[:150], "changed", *BASE[151:]]),
    " ".join([*BASE[:100], "other", *BASE[101:]]).upper(), " ".join([*(_rng.choice(_words) for _ in range(50)), *PASSAGE]), " ".join([*PASSAGE, *(_rng.choice(_words) for _ in range(50))]),
    "mail a.b@c.de or +1 (222) 555-0199, 4111 1111 1111 1111 and 4111 1111 1111 1112 at 10.0.0.1 and 999.1.1.1", "x" * 60_000, "1" * 40_000, "é😀 " * 100, "line\nline\nline\n" * 30,
]


@pytest.fixture(scope="module")
def rows():
    out = [(i + 1, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", len(t) if t else 0, -1, -2, "x", None) for i, t in enumerate(TEXTS)]
    return [*out, out[7], (None, "text without an id " * 20, "en", "s0", 5, 0, 0, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return SPLIT.findall(text or "")


def test_pii(docs, none, rows):
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find(docs).collect())
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "phone": 9 <= len(d) <= 15}[kind]

    want = Counter()
    for doc_id, text, *_ in rows:
        spans = [(k, m.start(), m.end()) for k, p in patterns.items() for m in (re.finditer(p, text or "") if text not in (TEXTS[14], LONG) else ()) if good(k, m.group())]
        want[(doc_id, *[sum(s[0] == k for s in spans) for k in patterns], hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest())] += 1
    assert got == want
    assert pii.find(none).count() == 0
    masked = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert "[EMAIL]" in masked[14].text and "a.b@" not in masked[14].text and masked[14].n_chars == len(masked[14].text)
    assert masked[1].text is None and masked[8].text == TEXTS[7]


def test_quality_rules(docs, none, rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.score(docs).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        w, at = words(text), {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        cover = {i + j for v in at.values() if len(v) > 1 for i in v for j in range(3)}
        lines = [x for x in (text or "").split("\n") if SPLIT.search(x)]
        want[(doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))] += 1
    assert got == want
    assert quality_rules.score(none).count() == 0


def test_warc(spark):
    rows = [(5, "http://a/ b\r\nX: y", "<p>é</p>", 1), (3, None, "<p>é</p>", 1), (9, "", None, 1), (8, "u", "", 1), (4, "u", "z" * 300_000, 1), (7, "u", "once", 1), (7, "u", "once", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(warc.write(pages, staging.new_path(spark, "warc"))).collect()}
    assert got == {(5, 9, "revisit", 3), (3, 9, "response", None), (9, 0, "revisit", 8), (8, 0, "response", None), (4, 300_000, "response", None), (7, 4, "response", None)}
    assert warc.read(warc.write(pages.limit(0), staging.new_path(spark, "warc"))).count() == 0
    member = next(warc.members(__import__("io").BytesIO(warc.record(1, "u", b"abc", None))))
    assert warc.parse(member)["payload"] == b"abc"
    with pytest.raises(warc.WarcError):
        warc.parse(member.replace(b"abc", b"abd"))
    with pytest.raises(warc.WarcError):
        list(warc.members(__import__("io").BytesIO(warc.record(1, "u", b"abc", None)[:-9])))


def test_mixing(docs, none, rows):
    got = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        assert r["size"] == next(len(words(t)) for i, t, *_ in rows if i == r.doc_id) and 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    for r in got:
        assert r.source_size == sizes[r.source] and abs(taken[r.source] - r.target) < 1
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(sizes.values())) < 1e-6 * sum(sizes.values())
    assert mixing.mix(none).count() == 0
    out = mixing.mixed_documents(docs.filter("doc_id <> 8")).collect()
    assert {x.strip() for r in out for x in [r.text] if r.doc_id == 8} == set()
    assert sum(len(words(r.text)) for r in out) == sum(r.taken for r in mixing.mix(docs.filter("doc_id <> 8")).collect())


def test_substring_dedup(docs, none, rows):
    size, starts = 35, {}
    lists = [words(t) if i is not None else [] for i, t, *_ in rows]
    for d, w in enumerate(lists):
        for i in range(len(w) - size + 1):
            starts.setdefault(tuple(w[i : i + size]), []).append((d, i))
    gone = [set() for _ in lists]
    for v in starts.values():
        for d, i in v if len(v) > 1 else ():
            gone[d].update(range(i, i + size))
    sha = lambda w: hashlib.sha256(" ".join(w).encode()).hexdigest()
    want = Counter((i, len(words(t)), len(g), sha([x for j, x in enumerate(words(t)) if j not in g])) for (i, t, *_), g in zip(rows, gone, strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()) == want
    assert substring_dedup.remove_repeats(none).count() == 0


def test_fingerprint_index(spark):
    path = staging.new_path(spark, "index")
    batch = lambda *x: spark.createDataFrame([(i, 0, 0, list(m), [0] * len(m)) for i, m in enumerate(x)], substring_dedup._WINDOWS)
    hits = []
    for x in (((1, 2), (2, 3)), ((3, 4, 4),), ((1, 9),)):
        index = substring_dedup.FingerprintIndex(spark, path)  # opened again from its folder each time
        hits.append({r.mark: r.n for r in index.absorb(batch(*x)).collect()})
    assert hits == [{2: 2}, {3: 2, 4: 2}, {1: 2}] and len(index.runs) == 1
    run = index.run(index.runs[0]).collect()
    assert {r.mark: r.n for r in run} == {1: 2, 2: 2, 3: 2, 4: 2, 9: 1}
    assert index.documents().count() == 4
    with pytest.raises(ValueError):
        substring_dedup.FingerprintIndex(spark, path, size=20)


def test_substring_dedup_of_a_second_batch(spark, rows):
    """A batch that comes later, in another session, is judged against what the index holds as by a full rebuild."""
    data = [(i, t) for i, t, *_ in rows if i is not None]
    extra = [(100, data[7][1]), (101, " ".join(_rng.choice(_words) for _ in range(80))), (102, data[12][1] + " and more"), (103, " ".join([*(_rng.choice(_words) for _ in range(40)), *PASSAGE[5:50]]))]
    old, new = ([x for x in data if x[0] % 2 == k] + (extra if k else []) for k in (0, 1))
    path, frame = staging.new_path(spark, "index"), lambda x: spark.createDataFrame(x, "doc_id long, text string")
    substring_dedup.remove_repeats(frame(old), index=substring_dedup.FingerprintIndex(spark, path)).collect()
    later = spark.newSession()
    again = later.createDataFrame(new, "doc_id long, text string")
    got = substring_dedup.remove_repeats(again, batches=2, index=substring_dedup.FingerprintIndex(later, path), history=later.createDataFrame(old, "doc_id long, text string"))
    want = substring_dedup.remove_repeats(frame(old + new)).filter(F.col("doc_id").isin([i for i, _ in new]))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_windows_with_repeated_grams(monkeypatch):
    """Stretches are those of each window's leftmost least gram, also where grams repeat inside a window."""
    monkeypatch.setattr(substring_dedup, "GRAM", 5)
    rng = random.Random(3)
    for _ in range(300):
        texts = [" ".join(rng.choice("ab") if rng.random() < 0.7 else f"w{rng.randrange(50)}" for _ in range(rng.randrange(60))).encode() for _ in range(5)]
        for group in groups(texts):
            w = substring_dedup.Windows(group, 7)
            for d in range(5):
                h = group.h[group.bounds[d] : group.bounds[d + 1]]
                g = grams(h, 5)
                at = [i + min(range(3), key=lambda j: (int(g[i + j]), j)) for i in range(len(h) - 6)]
                want = [(i, int(g[x])) for i, x in enumerate(at) if i == 0 or at[i - 1] != x]
                a, b = w.bounds[d], w.bounds[d + 1]
                assert [(int(f) - group.bounds[d], int(m)) for f, m in zip(w.first[a:b], w.marks[a:b], strict=True)] == want
                assert [int(x) - group.bounds[d] for x in w.last[a:b]] == [i - 1 for i, _ in want[1:]] + ([len(at) - 1] if at else [])


def test_word_hashes():
    rng = random.Random(1)
    made = [None, b"", b" \n", b" a b", b"a  b", b"a b"] + [bytes(rng.choice(b"ab \t\n\xc3\xa9") for _ in range(rng.randrange(40))) for _ in range(500)]
    made += [b"x" * 5_000_000 + b" ab a", b" ".join(b"w%d" % rng.randrange(99) for _ in range(200_000))]
    known, at = {}, 0
    for group in groups(made):
        for d, text in enumerate(group.texts):
            words_, h = text.split(), group.h[group.bounds[d] : group.bounds[d + 1]].tolist()
            assert len(words_) == len(h) and all(known.setdefault(w, x) == x for w, x in zip(words_, h, strict=True)) and group.joined(d) == b" ".join(words_)
            at += 1
    assert at == len(made) and len(set(known.values())) == len(known)


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    import public_tokenizers

    own, t = bpe.codec(bpe.load()), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    letters = "abcdeéüß 'sترあ漢字ΣσİŁÅǺ̧\x1c\x85 09½²ⅣⅢ_#$%\t\nthing!?…—"
    texts = ["".join(_rng.choice(letters) for _ in range(_rng.randint(0, 60))) for _ in range(400)] + ["".join(_rng.choice("aaeinrsth") for _ in range(25)) for _ in range(400)]
    for s in [*texts, "a<|endoftext|>b <|startoftext|>", *[x or "" for x in TEXTS]]:
        ids = t.encode(s, add_special_tokens=False).ids
        assert own.encode(s) == ids and own.text(ids) == t.decode(ids, skip_special_tokens=False)
    encoded = {r.doc_id: r.ids for r in bpe.encode(docs).collect()}
    for r in bpe.digests(docs).collect():
        assert r.n_tokens == len(encoded[r.doc_id]) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, encoded[r.doc_id])).encode()).hexdigest()
    assert bpe.digests(none).count() == 0


def test_voronoi(spark, monkeypatch):
    monkeypatch.setattr(voronoi, "BLOCK", 64)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(400)] + [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(400, 600)]
    rows += [(601, None), (602, [1.0, None, 1.0, 1.0]), (603, [float("nan")] * 4), (604, [float("inf")] * 4), (650, [2.0, 2.0]), (700, []), (5, rows[5][1])]
    good = {i: [int(np.floor(256 * x)) for x in np.array(v, np.float32).astype(float)] for i, v in rows if i not in (601, 602, 603, 604)}
    want = set()
    for q in (i for i in good if i % 50 == 0):
        best = sorted(((-sum(a * b for a, b in zip(good[q], v, strict=False)), i) for i, v in good.items() if i != q))[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in voronoi.top_k(df).collect()} == want
    assert voronoi.top_k(df.limit(0)).count() == 0


def test_voronoi_prunes(spark, monkeypatch):
    """Clusters of unlike norms, many cells and shares: right, and most pairs of a query and a cell are never solved."""
    monkeypatch.setattr(voronoi, "BLOCK", 4)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(12, 6)) * 3
    made = np.floor(256 * (centre[rng.integers(0, 12, 2000)] + rng.normal(size=(2000, 6)) * 0.02)).astype(np.int64)
    rows = [(i, [float(x) / 256 for x in v]) for i, v in enumerate(made)]
    want = set()
    for q in range(0, 2000, 50):
        score = made @ made[q]
        best = sorted((-int(s), i) for i, s in enumerate(score) if i != q)[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    told = {}
    assert {tuple(r) for r in voronoi.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), pivots=24, told=told).collect()} == want
    assert told["cells"] == 24 and told["pairs"] < 0.5 * 40 * 24


@pytest.mark.parametrize("label", ["toxic", "quality"])
def test_classifiers(spark, docs, none, label):
    rng = random.Random(9)
    made = []
    for i in range(900):
        bad = i % 4 == 0
        w = [rng.choice(_words) for _ in range(40)]
        if bad:
            w = [x + ("%%%" if label == "quality" else "") for x in w] if label == "quality" else [*w[:20], "insult", *w[20:]]
        made.append((i, " ".join(w), int(bad if label == "toxic" else not bad)))
    train = spark.createDataFrame(made, f"doc_id long, text string, {label} int")
    labels = train.select("doc_id", label)
    if label == "toxic":
        model = toxicity.train(train, labels)
        run = lambda d: toxicity.score(d, model).collect()
    else:
        model = quality_classifier.train(train, labels)
        run = lambda d: [r.asDict() | {"predicted": int(r["score"] >= 0.3)} for r in quality_classifier.scored(d, model, ["doc_id"]).collect()]
    got = {r["doc_id"]: r["predicted"] for r in run(train)}
    assert np.mean([got[i] == y for i, _, y in made if __import__("zlib").crc32(str(i).encode()) % 5 == 0]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in run(docs)) and len(run(docs)) == docs.count() and run(none) == []
    held = {r.doc_id: r.h for r in train.select("doc_id", labelled.held_out().alias("h")).collect()}
    assert all(h == (__import__("zlib").crc32(str(i).encode()) % 5 == 0) for i, h in held.items())


def test_quality_looks_of_long_words():
    """A long word's looks are those of all of it, and it isn't kept."""
    head = b"a" * 300
    looks = {quality_classifier._terms[head + tail] % quality_classifier.LOOKS for tail in (b"", b"0", b"A!0", b"-0-A")}
    assert len(looks) == 4 and not any(len(w) > 200 for w in quality_classifier._terms)


def test_near_dedup(docs, none, rows):
    def shingles(text):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t, *_ in rows if i is not None}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            r, s = sorted((root[a], root[b]))
            root = {k: r if v == s else v for k, v in root.items()}
    want = Counter((i, len(shingles(t)), root.get(i), i is None or root[i] == i) for i, t, *_ in rows)
    assert Counter(tuple(r) for r in near_dedup.link(docs).collect()) == want
    assert near_dedup.link(none).count() == 0


def test_near_dedup_crowd(spark):
    """A large group of near copies whose ends aren't alike is one component, through what lies between."""
    rng = random.Random(2)
    text, made = [rng.choice(_words) for _ in range(200)], []
    for i in range(150):
        text = list(text)
        text[rng.randrange(200)] = f"new{i}"
        made.append((i, " ".join(text)))
    got = near_dedup.link(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_near_dedup_settles_crowded_regions(spark):
    """Regions that stay crowded at every depth lose no link: many components in each, against brute force."""
    rng = random.Random(4)
    base, made = [rng.choice(_words) for _ in range(120)], []
    for i in range(160):
        text = list(base)
        for _ in range(rng.randint(2, 12)):
            text[rng.randrange(120)] = f"n{rng.randrange(40)}"
        made.append((i, " ".join(text)))
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for _, t in made)]
    root = list(range(len(made)))
    for a, b in itertools.combinations(root[:], 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            r, s = sorted((root[a], root[b]))
            root = [r if v == s else v for v in root]
    assert 10 < len(set(root)) < 150
    got = near_dedup.link(spark.createDataFrame(made, "doc_id long, text string"), crowd=2).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))


def test_near_dedup_settles_shallow_regions(spark):
    """Two texts that share crowded regions of 3 to 5 values only, each with an unlike third class before them, are linked."""
    K, D = near_dedup.TREES, near_dedup.DEPTH
    grams = lambda w: {" ".join(w[i : i + 4]) for i in range(len(w) - 3)}
    sig = lambda w: near_dedup.signature(shingles(" ".join(w).encode()))
    depths = lambda x, y: [next((i for i in range(D) if p[i] != q[i]), D) for p, q in zip(x.reshape(K, D), y.reshape(K, D), strict=True)]
    rng = random.Random(9)
    for _ in range(20_000):
        a = [f"w{rng.randrange(10_000)}" for _ in range(115)]
        b = list(a)
        for i in (20, 45, 70):
            b[i] = f"v{rng.randrange(10_000)}"
        met = depths(sig(a), sig(b))
        if 100 * len(grams(a) & grams(b)) >= 80 * len(grams(a) | grams(b)) and 3 <= max(met) < D:
            break
    else:
        raise AssertionError("no such pair")
    want, made = sig(a).reshape(K, D), []
    alone = {g: sig(g.split()).reshape(K, D) for g in grams(a) & grams(b)}
    for tree, depth in enumerate(met):
        if depth < 3:
            continue
        least = [next(g for g, s in alone.items() if s[tree, i] == want[tree, i]) for i in range(depth)]
        for attempt in range(20_000):
            filler = " ".join(f"{g} f{tree}x{attempt}" for g in least).split()
            if depths(sig(filler), sig(a))[tree] >= depth:
                break
        else:
            raise AssertionError("no filler")
        made.append((tree, " ".join(filler)))
    made += [(100, " ".join(a)), (101, " ".join(b))]
    got = near_dedup.link(spark.createDataFrame(made, "doc_id long, text string"), crowd=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: min(i, 100) for i, _ in made}


def test_near_dedup_gathers_regions(spark, monkeypatch):
    """Classes that share many crowded regions meet their texts a few times, not once a region; no link is lost."""
    rng = random.Random(6)
    base, made = [rng.choice(_words) for _ in range(120)], []
    for i in range(200):
        text = list(base)
        for j in rng.sample(range(0, 120, 4), rng.choice((1, 9))):
            text[j] = f"n{rng.randrange(1000)}"
        made.append((i, " ".join(text)))
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for _, t in made)]
    root = list(range(len(made)))
    for a, b in itertools.combinations(root[:], 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            r, s = sorted((root[a], root[b]))
            root = [r if v == s else v for v in root]
    sieved, stage = [], staging.stage

    def staged(df, name, codec="zstd"):
        out = stage(df, name, codec)
        if name == "sieved":
            sieved.append(out.agg(F.count("node"), F.countDistinct("node")).first())
        return out

    monkeypatch.setattr(staging, "stage", staged)
    docs = spark.createDataFrame(made, "doc_id long, text string")
    for held, times in ((near_dedup.HELD, 4), (16, 8)):  # with 16, strays make several chunks
        monkeypatch.setattr(near_dedup, "HELD", held)
        sieved.clear()
        got = near_dedup.link(docs, crowd=20).collect()
        assert {r.doc_id: r.component_id for r in got} == dict(enumerate(root))
        assert sieved and all(rows <= times * nodes for rows, nodes in sieved)


def test_workers_keep_one_operators_caches(monkeypatch):
    """A worker process goes from stage to stage; what the classifier and the codec keep there doesn't add up."""
    import pyarrow as pa

    def kept():
        return bool(quality_classifier._terms), bool(bpe._codecs)

    spec = bpe.load()
    quality_classifier.counts(b"some words")
    assert kept()[0]
    bpe.codec(spec)
    assert kept() == (False, True)
    quality_classifier.counts(b"some words")
    monkeypatch.setattr(near_dedup, "ROWS", 2)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "text": ["a b c d e", None, "", "a b", "A b c d e"]})
    out = list(near_dedup._signed(iter([batch])))
    assert kept() == (False, False)
    assert [x.num_rows for x in out] == [2, 2, 1] and pa.Table.from_batches(out)["n_shingles"].to_pylist() == [2, 0, 0, 1, 2]


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 5000: 5000, 5001: 5000}
