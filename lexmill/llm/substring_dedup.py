"""Removal of passages that repeat anywhere, by a log-structured index of window fingerprints.

A window of 35 words is known by the least hash among its 12-word grams, its mark; neighbouring windows
mostly share one, so a text has about one mark every 12 words, and equal windows have equal ones. A stretch is a row
of neighbouring windows around one mark.

The index is a folder: immutable runs (mark, n), sorted by mark, one for each batch of documents, the windows of
the batch's documents, and a manifest that names what is live. Each new batch makes a run of its own, which is
merge-joined with the runs before it; marks found there, or twice in the batch, are hits. Runs are compacted into
one where there are more than `most_runs`. Hits are then verified: where the whole stretch is found again, all its
windows repeat; of other stretches each window is compared by 128 bits over its words. Only one of several equal
stretches, and one of several equal documents, is ever expanded. `remove_repeats` takes an index of earlier
documents: then only the new ones are judged, against both, and the index holds both afterwards.

Hot passages: counts are summed in each task first. Keys that many rows share are bounded in number (at most
50,000 with more than 1/50,000 of the rows), so rows that have one are joined by broadcast and never meet in a task.

Null or empty text, or under 35 words: nothing removed. Rows with a null doc_id: nothing removed, and nothing
is matched against them. Repeated rows: each other's copies. Ids must otherwise be unique, also across batches.
Very long texts count whole; ties, of equal windows, all count. Other columns don't matter, whatever their names. Empty table:
empty result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import skew, staging, workers
from lexmill.llm.text import U64, Group, grams, groups, mix, powers, texts

GRAM = 12


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0]..last[0], first[1]..last[1] and so on, in one array."""
    n = last - first + 1
    return np.arange(n.sum()) + np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n)


class Windows:
    """Marks of all windows of a group of texts: stretch i has the windows first[i] to last[i], places in group.h.
    The stretches of text d are bounds[d] to bounds[d + 1] - 1."""

    _bases = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, group: Group, size: int):
        self.h, self.size, gram = group.h, size, min(GRAM, size)
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        n, span = len(self.h), size - gram + 1
        many = n - size + 1
        if many <= 0:
            self.marks, self.first = np.empty(0, U64), np.empty(0, np.int64)
            self.last, self.bounds = self.first, np.zeros(len(group.bounds), np.int64)
            return
        g = grams(self.h, gram)
        least, k = g, 1
        while 2 * k <= span:
            least = np.minimum(least[:-k], least[k:])
            k *= 2
        if span > k:
            least = np.minimum(least[: -(span - k)], least[span - k :])
        words = np.diff(group.bounds)
        inside = (np.arange(n) + size <= np.repeat(group.bounds[1:], words))[:many]
        before = np.concatenate(([False], inside[:-1]))
        first = np.flatnonzero(inside & (~before | np.concatenate(([True], least[1:] != least[:-1]))))
        last = self._ends(first, inside)
        view = np.lib.stride_tricks.sliding_window_view(g, span)
        at = (view[first] == least[first][:, None]).argmax(axis=1) + first
        if (twice := at < last).any():  # a gram that comes again inside a window: its leftmost place counts
            place = np.repeat(at, last - first + 1)
            again = np.repeat(twice, last - first + 1)
            own = _spread(first, last)
            place[again] = own[again] + view[own[again]].argmin(axis=1)
            new = np.concatenate(([True], (place[1:] != place[:-1]) | (own[1:] != own[:-1] + 1)))
            first, at = own[new], place[new]
            last = self._ends(first, inside)
        self.first, self.last, self.marks = first, last, g[at]
        self.bounds = first.searchsorted(group.bounds)

    @staticmethod
    def _ends(first: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Each stretch ends before the next one, or with its text's last window."""
        stop = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False])))
        return np.minimum(np.concatenate((first[1:] - 1, [len(inside) - 1])), stop[stop.searchsorted(first)]) if len(first) else first

    def _span(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of words start..end-1 for each pair."""
        if k not in self._sums:
            up, down = powers(len(self.h) + 1, self._bases[k])
            self._sums[k] = np.append(U64(0), np.cumsum(mix(self.h + U64(k)) * up[:-1], dtype=U64)), down
        total, down = self._sums[k]
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))

    def stretches(self) -> np.ndarray:
        return self._span(0, self.first, self.last + self.size)

    def windows(self, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._span(0, start, start + self.size), self._span(1, start, start + self.size)


_WINDOWS = "doc_id long, d1 long, d2 long, marks array<long>, spans array<long>"


class FingerprintIndex:
    """Log-structured, in one folder: runs of (mark, n) sorted by mark, windows of the documents, and a manifest.

    Files are only added; a manifest is a new file that names the runs it holds, and is written last. What a
    compaction replaced is deleted after that. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, size: int = 35, most_runs: int = 1):
        """Opens the index at path, or begins one."""
        self.spark, self.path, self.most_runs = spark, path.rstrip("/"), most_runs
        self.version, names = 0, staging.listed(spark, self.path)
        for name in names:
            if name.startswith("manifest-"):
                self.version = max(self.version, int(name[9:-5]))
        said = json.loads(staging.read_text(spark, self._manifest())) if self.version else {"size": size, "runs": [], "windows": []}
        if said["size"] != size:
            raise ValueError(f"the index holds windows of {said['size']} words, not {size}")
        self.size, self.runs, self.batches = size, said["runs"], said["windows"]

    def _manifest(self) -> str:
        return f"{self.path}/manifest-{self.version}.json"

    def _write(self, rows: DataFrame, name: str) -> str:
        at = f"{name}-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{at}")
        return at

    def run(self, name: str) -> DataFrame:
        return self.spark.read.schema("mark long, n long").parquet(f"{self.path}/{name}")

    def documents(self) -> DataFrame:
        """Windows of the documents of all batches."""
        paths = [f"{self.path}/{b}" for b in self.batches]
        return self.spark.read.schema(_WINDOWS).parquet(*paths) if paths else self.spark.createDataFrame([], _WINDOWS)

    def absorb(self, documents: DataFrame) -> DataFrame:
        """Adds a batch (the columns of documents()). Returns its hits: marks with n, found twice in it or in a run before."""
        batch = self._write(documents.select(*[c.split()[0] for c in _WINDOWS.split(", ")]), "windows")
        marks = self.spark.read.schema(_WINDOWS).parquet(f"{self.path}/{batch}").select(F.explode("marks").alias("mark"))
        name = self._write(marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("mark"), "run")
        new = self.run(name)
        hits = new.filter("n > 1")
        for old in self.runs:
            hits = hits.unionByName(new.join(self.run(old).withColumnRenamed("n", "m").hint("merge"), "mark").select("mark", (F.col("n") + F.col("m")).alias("n")))
        hits = staging.stage(hits, "hits")
        self.runs, self.batches = [*self.runs, name], [*self.batches, batch]
        if len(self.runs) > self.most_runs:
            self.compact()
        else:
            self._commit()
        return hits

    def compact(self) -> None:
        """All runs become one."""
        old = self.runs
        both = self.spark.read.schema("mark long, n long").parquet(*[f"{self.path}/{r}" for r in old])
        self.runs = [self._write(both.groupBy("mark").agg(F.sum("n").alias("n")).sortWithinPartitions("mark"), "run")]
        self._commit()
        staging.delete(self.spark, *[f"{self.path}/{r}" for r in old])

    def _commit(self) -> None:
        self.version += 1
        staging.write_text(self.spark, self._manifest(), json.dumps({"size": self.size, "runs": self.runs, "windows": self.batches}))


_READ = "doc_id long, n_words long, d1 long, d2 long, sha string, marks array<long>, spans array<long>"
_LONG, _LIST = pa.int64(), pa.list_(pa.int64())


def _sha(joined: bytes) -> str:
    return hashlib.sha256(joined).hexdigest()


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _signed(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column("doc_id").cast(_LONG), 0
            for group in groups(texts(batch.column("text"))):
                w, n = Windows(group, size), len(group.texts)
                digest = [
                    np.frombuffer(xxhash.xxh3_128_digest(group.h[a:b].tobytes()), np.int64).tolist() if b - a >= size else (None, None)
                    for a, b in zip(group.bounds[:-1].tolist(), group.bounds[1:].tolist(), strict=True)
                ]
                arrays = [ids.slice(at, n), pa.array(np.diff(group.bounds)), *[pa.array([d[i] for d in digest], _LONG) for i in (0, 1)]]
                arrays += [pa.array([_sha(group.joined(d)) for d in range(n)]), _lists(w.marks, w.bounds), _lists(w.stretches(), w.bounds)]
                yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _READ.split(", ")])
                at += n

    return run


def _flat(column: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """Offsets, and the fields of a column of lists of structs, each as one array."""
    offsets = column.offsets.to_numpy()
    inner = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return (offsets - offsets[0], *[inner.field(f).to_numpy(zero_copy_only=False) for f in fields])


def _expanded(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            offsets, index, weight = _flat(batch.column("marks"), "i", "weight")
            at = 0
            for group in groups(texts(batch.column("text"))):
                w, n = Windows(group, size), len(group.texts)
                a, b = offsets[at], offsets[at + n]
                doc = np.repeat(np.arange(n), np.diff(offsets[at : at + n + 1]))
                ask = np.flatnonzero(weight[a:b] > 0)
                i, doc = w.bounds[doc[ask]] + index[a:b][ask], doc[ask]
                start, many = _spread(w.first[i], w.last[i]), w.last[i] - w.first[i] + 1
                w1, w2 = w.windows(start)
                doc = np.repeat(doc, many)
                arrays = [ids[at : at + n][doc], (start - group.bounds[doc]).astype(np.int32), w1.view(np.int64), w2.view(np.int64), np.repeat(weight[a:b][ask], many).astype(np.int32)]
                at += n
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["doc_id", "s", "w1", "w2", "weight"])

    return run


def _kept(group: Group, d: int, gone: np.ndarray) -> bytes:
    return b" ".join(np.array(group.texts[d].split(), dtype=object)[~gone].tolist())


def _cleaned(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, index, whole = _flat(batch.column("marks"), "i", "whole")
            hits = batch.column("hits").to_pylist()
            at = 0
            for group in groups(texts(batch.column("text"))):
                w, n = Windows(group, size), len(group.texts)
                a, b = offsets[at], offsets[at + n]
                doc = np.repeat(np.arange(n), np.diff(offsets[at : at + n + 1]))
                all_ = np.flatnonzero(whole[a:b])
                i = w.bounds[doc[all_]] + index[a:b][all_]
                single = [np.asarray(h, np.int64) + s for h, s in zip(hits[at : at + n], group.bounds.tolist(), strict=False) if h]
                single = np.concatenate(single) if single else np.empty(0, np.int64)
                many = len(group.h) + 1
                step = np.bincount(np.concatenate((w.first[i], single)), minlength=many) - np.bincount(np.concatenate((w.last[i], single)) + size, minlength=many)
                gone = step.cumsum()[:-1] > 0
                rows = []
                for d, (p, q) in enumerate(zip(group.bounds[:-1].tolist(), group.bounds[1:].tolist(), strict=True)):
                    cut = int(np.count_nonzero(gone[p:q]))
                    kept = _kept(group, d, gone[p:q]) if cut else group.joined(d)
                    rows.append((cut, _sha(kept), kept))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (_LONG, pa.string(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), *columns], names=["doc_id", "cut", "cut_sha", "cut_text"])
                at += n

    return run


def _classes(read: DataFrame, past: DataFrame) -> DataFrame:
    """Equal documents that have windows: d1, d2, the smallest doc_id, rows n, and whether history has them (old)."""
    own = read.filter("d1 IS NOT NULL AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    own = own.join(past.select("d1", "d2").distinct().withColumn("old", F.lit(True)), ["d1", "d2"], "left")
    return staging.stage(own.withColumn("old", F.coalesce("old", F.lit(False))), "classes")


def _asked(documents: DataFrame, hits: DataFrame) -> DataFrame:
    """doc_id and marks: list of (i, whole, weight). whole: all of stretch i repeats. weight: that many of its windows
    count where stretch i is the one that is expanded, for its mark has other stretches too."""
    live = staging.stage(hits.groupBy("mark").agg(F.sum("n").alias("n")), "live")
    found = documents.select("doc_id", F.posexplode(F.arrays_zip("marks", "spans")).alias("i", "x")).select("doc_id", "i", F.col("x.marks").alias("mark"), F.col("x.spans").alias("span"))
    marks = documents.agg(F.sum(F.size("marks"))).first()[0] or 0
    found = staging.stage(skew.joined(found, live, ["mark"], marks).drop("n"), "found")
    total = found.count()
    kinds = staging.stage(found.groupBy("mark", "span").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "i")).alias("one")), "kinds")
    whole = skew.joined(found, kinds.filter("n > 1").select("mark", "span", "n"), ["mark", "span"], total)
    mixed = kinds.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    some = skew.joined(kinds.select("mark", "one", F.least("n", F.lit(2)).cast("int").alias("weight")), mixed, ["mark"], total)
    told = whole.select("doc_id", "i", F.lit(True).alias("whole"), F.lit(0).alias("weight")).unionByName(some.select("one.doc_id", "one.i", F.lit(False).alias("whole"), "weight"))
    asked = staging.stage(told.groupBy("doc_id").agg(F.max("weight").alias("most"), F.collect_list(F.struct("i", "whole", "weight")).alias("marks")), "asked")
    staging.drop(live, found, kinds)
    return asked


def remove_repeats(docs: DataFrame, size: int = 35, batches: int = 2, index: FingerprintIndex | None = None, history: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and kept_text where a part was removed (null: all words, or none, stay).
    index: that of earlier documents, whose rows (doc_id, text) are history; docs are added to it, in batches."""
    spark = docs.sparkSession
    workers.ship(spark)
    index = index or FingerprintIndex(spark, staging.new_path(spark, "fingerprints"), size)
    docs = docs.select("doc_id", "text")
    read = staging.stage(docs.mapInArrow(_signed(size), _READ), "windows")
    classes = _classes(read, index.documents())
    fresh = classes.filter("NOT old").select("doc_id", "d1", "d2")
    hits = None
    for b in range(batches):
        part = F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b
        found = index.absorb(read.filter(part).join(fresh.filter(part), ["doc_id", "d1", "d2"]))
        hits = found if hits is None else hits.unionByName(found)
    wide, read = read, staging.stage(read.select("doc_id", "n_words", "d1", "d2", "sha"), "words")
    staging.drop(wide)
    asked = _asked(index.documents(), hits).join(classes.filter("n = 1 AND NOT old").select("doc_id", F.lit(True).alias("judged")), "doc_id", "left").filter("judged OR most > 0")
    held = staging.stage((docs if history is None else docs.unionByName(history.select("doc_id", "text"))).join(asked, "doc_id"), "held")
    wins = staging.stage(held.filter("most > 0").select("doc_id", "text", "marks").mapInArrow(_expanded(size), "doc_id long, s int, w1 long, w2 long, weight int"), "expanded")
    again = wins.groupBy("w1", "w2").agg(F.sum("weight").alias("n")).filter("n > 1")
    hits = skew.joined(wins.filter("weight = 1").select("doc_id", "s", "w1", "w2"), again, ["w1", "w2"], 2 * wins.count()).groupBy("doc_id").agg(F.collect_list("s").alias("hits"))
    cleaned = held.filter("judged").select("doc_id", "text", "marks").join(hits, "doc_id", "left").mapInArrow(_cleaned(size), "doc_id long, cut long, cut_sha string, cut_text binary")
    copied = skew.joined(read.filter("d1 IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "d1", "d2"), classes.filter("n > 1 OR old").select("d1", "d2", "n"), ["d1", "d2"], read.count())
    none = F.lit(None)
    gone = copied.select("doc_id").distinct().select("doc_id", none.cast("long").alias("cut"), F.lit(_sha(b"")).alias("cut_sha"), none.cast("binary").alias("cut_text"))
    rows = read.select("doc_id", "n_words", "sha")
    out = rows.filter("doc_id IS NOT NULL").join(gone.unionByName(cleaned), "doc_id", "left")
    out = out.select("doc_id", "n_words", F.when(F.col("cut_sha").isNull(), 0).otherwise(F.coalesce("cut", "n_words")).alias("n_removed"), F.coalesce("cut_sha", "sha").alias("kept_sha256"), F.when(F.col("cut") > 0, F.col("cut_text").cast("string")).alias("kept_text"))
    return out.unionByName(rows.filter("doc_id IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), none.cast("string").alias("kept_text")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i+34], ' ')) AS n FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM x WHERE n > 1),
e AS (SELECT doc_id, unnest(w) AS y, unnest(range(1, len(w) + 1)) AS j FROM w),
k AS (SELECT e.doc_id, string_agg(e.y, ' ' ORDER BY e.j) AS kept FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.j = g.j WHERE g.j IS NULL GROUP BY e.doc_id),
r AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id LEFT JOIN r ON w.doc_id = r.doc_id
"""
