"""Each stage of the pipeline on what the one before kept, against plain Python; and run() against the stages."""

import hashlib
import itertools
from collections import Counter

from lexmill.llm import bpe, mixing, pii, quality_classifier, staging
import corpus_pipeline

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, outs = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        outs.append(staging.stage(stage(spark, outs[-1], DATA), name))
    assert all(o.columns == columns for o in outs[:-1])
    first, good, single, masked, mixed, tokens = [o.collect() for o in outs]

    model = quality_classifier.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    scores = model.scores([quality_classifier.counts(r.text.encode()) for r in first])
    assert {r.doc_id for r in good} == {r.doc_id for r, s in zip(first, scores, strict=True) if s >= 0.3}

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in good:
        w = r.text.translate(lower).encode().split()
        sets[r.doc_id] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or {tuple(w)}
    root = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    assert {r.doc_id for r in single} == {i for i, r in root.items() if i == r}

    spans = {r.doc_id: [x.split(":") for x in r.spans.split(",") if x] for r in pii.find(outs[2]).collect()}
    text = {r.doc_id: r.text for r in masked}
    for r in single:
        out, at = "", 0
        for s, e, kind in sorted((int(s), int(e), k) for k, s, e in spans[r.doc_id]):
            if s >= at:
                out += r.text[at:s] + f"[{kind.upper()}]"
            at = max(at, e)
        assert text[r.doc_id] == out + r.text[at:]

    taken = {r.doc_id: r.taken for r in mixing.mix(outs[3]).collect()}
    words = Counter()
    for r in mixed:
        assert text[r.doc_id].startswith(r.text)
        words[r.doc_id] += len(r.text.encode().split())
    assert words == Counter({i: n for i, n in taken.items() if n})

    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in mixed:
        ids = t.encode(r.text, add_special_tokens=False).ids
        want[(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in tokens) == want
    assert bpe.load()
    assert Counter(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == Counter(map(tuple, tokens))


def test_stages_on_hard_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows, an empty table and columns with the stages' own names."""
    schema = "doc_id long, text string, source string, n_chars long, score double, size long, doc string, spans string, taken long, copy int, rep long"
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    tail = (0, 0.5, 1, "d", "s", 2, 3, 4)
    one = (1, " ".join(word[i % 10] + str(i) for i in range(40)), "a", *tail)
    rows = [one, one, one, one, (2, None, "a", *tail), (3, "", "a", *tail), (None, "no id here " * 9, "a", *tail), (None, "no id here " * 9, None, *tail), (4, "w " * 20_000, "b", *tail), (5, "mail a.b@c.org now", None, *tail), (6, "x" * 50_000, "b", *tail)]
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        assert stage(spark, none, DATA).collect() == [], name
    kept = corpus_pipeline.near_duplicates(spark, docs, DATA).collect()
    assert Counter(r.doc_id for r in kept) == Counter([None, None, 1, 2, 3, 4, 5, 6])
    masked = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, docs, DATA).collect()}
    assert masked[5].text == "mail [EMAIL] now" and masked[5].spans == "s" and masked[2].text is None
    mixed = corpus_pipeline.mixture(spark, docs, DATA).collect()
    took = {}
    for r in mixing.mix(docs).collect():
        took[r.doc_id] = took.get(r.doc_id, 0) + r.taken
    got = Counter()
    for r in mixed:
        got[r.doc_id] += len((r.text or "").split())
        assert (r.doc, r.taken, r.copy, r.n_chars) == ("d", 2, 3, len(r.text))
    assert got == Counter({i: n for i, n in took.items() if n})
    assert {(r.doc_id, r.n_tokens) for r in corpus_pipeline.tokens(spark, docs, DATA).collect() if r.doc_id in (2, 3)} == {(2, 0), (3, 0)}
    assert corpus_pipeline.tokens(spark, none, DATA).collect() == []
