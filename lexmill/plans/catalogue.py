"""Queries over the driver's tables, each with its equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import columns as C
from lexmill.functions import chunking, codemix, frontend, numerals, phonemes, romanised, scoring, spoken, unicode_text
from lexmill.operators import reports, scans, signal, synthesis, voices
from lexmill.sources import shared

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
AS_OF = "2024-06-01 00:00:00"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if f.__name__ in _queries:
            raise ValueError(f"there is a query {f.__name__} already")
        _queries[f.__name__] = f
        if oracle is not None:
            _oracles[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shared.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_balance(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracles() -> dict[str, str]:
    return dict(_oracles)


_POSITION = "CAST(CAST(concat('0x', substr(sha256('corpus-v1:' || {0}), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0"
_SPLIT = "CASE WHEN {0} < 0.05 THEN 'test' WHEN {0} < 0.1 THEN 'validation' ELSE 'train' END".format(_POSITION)


@query(f"""
WITH d AS (SELECT d.*, quality, {_SPLIT.format("CAST(source AS VARCHAR)")} AS split FROM documents d LEFT JOIN labels USING (doc_id)),
m AS (SELECT split, lang, source, GROUPING_ID(split, lang, source) AS g, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars,
      count(quality) AS n_labelled, coalesce(CAST(count(*) FILTER (quality = 1) AS DOUBLE) / nullif(count(quality), 0), 1.0) AS pass_rate
      FROM d GROUP BY GROUPING SETS ((split), (lang), (source), ()))
SELECT CASE g WHEN 3 THEN 'split' WHEN 5 THEN 'lang' WHEN 6 THEN 'source' ELSE 'all' END AS dimension,
       CASE g WHEN 3 THEN split WHEN 5 THEN lang WHEN 6 THEN source END AS key, n_docs, n_chars, n_labelled, round(pass_rate, 9) AS pass_rate FROM m
""")
def corpus_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    measures = {"n_docs": F.count(F.lit(1)), "n_chars": F.sum("n_chars"), "n_labelled": F.count("quality"), "pass_rate": F.round(reports.pass_rate(F.col("quality") == 1), 9)}
    return reports.balance(docs.withColumn("split", C.assigned_split(F.col("source"))), ["split", "lang", "source"], measures)


@query("SELECT coalesce(lang, 'None') AS key, count(*) AS n FROM documents GROUP BY 1")
def manifest_count_by(spark, sf_dir):
    return reports.count_by(table(spark, sf_dir, "documents"), "lang")


@query("SELECT round(coalesce(sum(value), 0) / 3600, 6) AS hours, count(DISTINCT user_id) AS speakers FROM events")
def total_hours(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.round(reports.hours(F.col("value")), 6).alias("hours"), F.countDistinct("user_id").alias("speakers"))


@query(f"SELECT o_orderkey, o_custkey, {_SPLIT.format('CAST(o_custkey AS VARCHAR)')} AS split FROM orders")
def assign_split(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", C.assigned_split(F.col("o_custkey")).alias("split"))


@query(f"SELECT count(*) AS n FROM (SELECT o_custkey FROM (SELECT o_custkey, {_SPLIT.format('CAST(o_custkey AS VARCHAR)')} AS split FROM orders) GROUP BY 1 HAVING count(DISTINCT split) > 1)")
def split_disjointness(spark, sf_dir):
    split = table(spark, sf_dir, "orders").select("o_custkey", C.assigned_split(F.col("o_custkey")).alias("split"))
    return split.groupBy("o_custkey").agg(F.countDistinct("split").alias("k")).filter("k > 1").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, turn, CAST(CAST(concat('0x', substr(sha256(CAST(conv_id AS VARCHAR) || '|' || role), 1, 8)) AS UBIGINT) AS BIGINT) AS payload,
          substr(sha256('owner:' || CAST(conv_id AS VARCHAR)), 1, 24) AS owner FROM conversations""")
def payload_and_owner(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.payload_for(F.col("conv_id").cast("string"), F.col("role")).alias("payload"), C.owner_id(F.col("conv_id")).alias("owner"))


#: Each pair's characters become one-byte ones, for DuckDB's edit distance counts bytes.
_PAIRS = """p AS (SELECT conv_id, turn, text AS h, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
a AS (SELECT conv_id, turn, regexp_replace(r, '[\\p{Po}\\p{Pd}\\p{Ps}\\p{Pe}\\p{Pi}\\p{Pf}\\s]', '', 'g') AS r, regexp_replace(h, '[\\p{Po}\\p{Pd}\\p{Ps}\\p{Pe}\\p{Pi}\\p{Pf}\\s]', '', 'g') AS h FROM p WHERE r IS NOT NULL),
f AS (SELECT *, array_to_string(list_distinct(string_split(r || h, '')), '') AS c, array_to_string(list_transform(range(1, 128), lambda i: chr(CAST(i AS INT))), '') AS t FROM a),
s AS (SELECT conv_id, turn, translate(r, c, t[1:length(c)]) AS r, translate(h, c, t[1:length(c)]) AS h FROM f)"""


#: d: of lists of words r and h (table w), the table of distances, filled row by row; its last number is the distance.
_TABLE = """d AS (SELECT conv_id, turn, len(h) - len(r) AS drift, len(r) AS n, list_reduce(list_prepend({'w': '', 't': range(0, len(h) + 1)}, list_transform(r, lambda w: {'w': w, 't': CAST([] AS BIGINT[])})),
  lambda a, x: {'w': '', 't': list_transform(range(1, len(h) + 2), lambda j: list_min(list_transform(range(1, j + 1), lambda k: j - k + least(a.t[k] + 1, CASE WHEN k > 1 THEN a.t[k - 1] + CASE WHEN h[k - 1] = x.w THEN 0 ELSE 1 END ELSE a.t[k] + 1 END))))}) AS z FROM w"""


def _pairs(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("h"), F.lag("text").over(w).alias("r"))
    return df.filter(F.col("r").isNotNull())


@query(f"WITH {_PAIRS} SELECT conv_id, turn, round(CASE WHEN length(r) > 0 THEN CAST(levenshtein(r, h) AS DOUBLE) / length(r) END, 9) AS cer FROM s")
def cer_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(C.character_error_rate(F.col("r"), F.col("h")), 9).alias("cer"))


@query(f"""WITH p AS (SELECT conv_id, turn, text AS h, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
s AS (SELECT conv_id, turn, regexp_replace(r, '[\\p{{Po}}\\p{{Pd}}\\p{{Ps}}\\p{{Pe}}\\p{{Pi}}\\p{{Pf}}]', '', 'g') AS r, regexp_replace(h, '[\\p{{Po}}\\p{{Pd}}\\p{{Ps}}\\p{{Pe}}\\p{{Pi}}\\p{{Pf}}]', '', 'g') AS h FROM p WHERE r IS NOT NULL),
w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(r, '\\s+'), lambda w: w <> '') AS r, list_filter(regexp_split_to_array(h, '\\s+'), lambda w: w <> '') AS h FROM s),
{_TABLE}) SELECT conv_id, turn, round(CASE WHEN n > 0 THEN CAST(z.t[-1] AS DOUBLE) / n END, 9) AS wer FROM d""")
def wer_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(C.word_error_rate(F.col("r"), F.col("h")), 9).alias("wer"))


@query(f"WITH {_PAIRS} SELECT conv_id, turn FROM s WHERE length(r) > 0 AND levenshtein(r, h) / length(r) > 0.85")
def asr_mismatch(spark, sf_dir):
    return _pairs(spark, sf_dir).filter(C.character_error_rate(F.col("r"), F.col("h")) > 0.85).select("conv_id", "turn")


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\s]+') AS w FROM documents),
e AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT doc_id, x, i - row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS g FROM e),
r AS (SELECT doc_id, max(n) AS run FROM (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id, x, g) GROUP BY doc_id)
SELECT w.doc_id, CASE WHEN len(w) = 0 THEN 'empty' WHEN run > 4 THEN 'repeats' WHEN len(w) >= 8 AND CAST(len(list_distinct(w)) AS DOUBLE) / len(w) < 0.35 THEN 'low_variety' ELSE '' END AS problems
FROM w LEFT JOIN r ON w.doc_id = r.doc_id""")
def transcript_sanity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(C.transcript_problems(F.col("text"), expect_malayalam=False), ",").alias("problems"))


@query(r"""SELECT doc_id, CASE WHEN text IS NULL OR regexp_replace(text, '\s', '', 'g') = '' THEN 'validation_error' WHEN length(text) > 5000 THEN 'text_too_long' END AS error_code FROM documents""")
def text_guard(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.text_error(F.col("text")).alias("error_code"))


_STATS = "s AS (SELECT user_id, sum(value) / 60 AS duration, avg(value) AS snr, CAST(count(*) FILTER (value < 20) AS DOUBLE) / count(*) AS silence FROM events GROUP BY user_id)"


@query(f"""WITH {_STATS} SELECT user_id, concat_ws(',', CASE WHEN duration < 0.5 THEN 'too_short' END, CASE WHEN duration > 30 THEN 'too_long' END,
           CASE WHEN snr < 20 THEN 'noisy' END, CASE WHEN silence > 0.6 THEN 'mostly_silence' END) AS reasons FROM s""")
def quality_gate_reasons(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id").agg((F.sum("value") / 60).alias("duration"), F.avg("value").alias("snr"), (F.count_if(F.col("value") < 20) / F.count(F.lit(1))).alias("silence"))
    return s.select("user_id", F.array_join(signal.quality_reasons(F.col("duration"), F.col("snr"), F.col("silence")), ",").alias("reasons"))


@query(f"""WITH {_STATS}, g AS (SELECT CASE WHEN duration < 0.5 THEN 'too_short' WHEN duration > 30 THEN 'too_long' WHEN snr < 20 OR silence > 0.6 THEN 'quality' ELSE 'accepted' END AS stage, duration FROM s)
           SELECT stage, count(*) AS n, round(sum(duration) / 3600, 6) AS hours FROM g GROUP BY stage""")
def rejection_summary(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id").agg((F.sum("value") / 60).alias("duration"), F.avg("value").alias("snr"), (F.count_if(F.col("value") < 20) / F.count(F.lit(1))).alias("silence"))
    stage = F.when(F.col("duration") < 0.5, "too_short").when(F.col("duration") > 30, "too_long").when((F.col("snr") < 20) | (F.col("silence") > 0.6), "quality").otherwise("accepted")
    return s.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.round(reports.hours(F.col("duration")), 6).alias("hours"))


_FRAMES = """x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT user_id, CASE WHEN n < 4 THEN 0 ELSE pos // 4 END AS frame, value FROM x WHERE n < 4 OR (pos // 4 + 1) * 4 <= n),
e AS (SELECT user_id, CAST(frame AS INTEGER) AS frame, 20 * log10(sqrt(avg(value * value)) + 1e-12) AS energy FROM f GROUP BY user_id, frame)"""


def _frames(spark, sf_dir):
    placed = scans.positions(table(spark, sf_dir, "events").select("user_id", "value", "ts", "event_id"), "user_id", ["ts", "event_id"])
    return signal.frame_energy(placed, "user_id", "pos", "value", 4)


@query(f"WITH {_FRAMES} SELECT user_id, frame, round(energy, 6) AS energy FROM e")
def frame_energy(spark, sf_dir):
    return _frames(spark, sf_dir).select("user_id", "frame", F.round("energy", 6).alias("energy"))


@query(f"""WITH {_FRAMES}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM e),
l AS (SELECT user_id, min(energy) AS least FROM c WHERE n >= 50 GROUP BY user_id, frame // 25 HAVING count(*) = 25),
fl AS (SELECT user_id, quantile_cont(least, 0.1) AS lo FROM l GROUP BY user_id UNION ALL SELECT user_id, quantile_cont(energy, 0.05) FROM c WHERE n < 50 GROUP BY user_id)
SELECT e.user_id, round(lo, 6) AS floor_db, round(quantile_cont(energy, 0.9) - lo, 6) AS snr, round(avg(CASE WHEN energy < lo + 6 THEN 1.0 ELSE 0.0 END), 6) AS silence_ratio
FROM e JOIN fl ON e.user_id = fl.user_id GROUP BY e.user_id, lo""")
def quality_report(spark, sf_dir):
    return signal.quality_report(_frames(spark, sf_dir), "user_id").select("user_id", F.round("floor", 6).alias("floor_db"), F.round("snr", 6).alias("snr"), F.round("silence_ratio", 6).alias("silence_ratio"))


@query(f"""WITH {_FRAMES}, t AS (SELECT user_id, quantile_cont(energy, 0.1) + 6 AS th, max(frame) AS fin FROM e GROUP BY user_id),
a AS (SELECT e.user_id, frame, fin, frame - lag(frame) OVER (PARTITION BY e.user_id ORDER BY frame) AS gap FROM e JOIN t ON e.user_id = t.user_id WHERE energy > th),
i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap - 1 > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame) AS segment FROM a),
r AS (SELECT user_id, segment, min(frame) AS start_frame, CASE WHEN fin - max(frame) <= 1 THEN fin + 1 ELSE max(frame) END AS end_frame FROM i GROUP BY user_id, segment, fin)
SELECT user_id, CAST(segment AS BIGINT) AS segment, start_frame, end_frame FROM r WHERE end_frame - start_frame >= 1""")
def vad_segments(spark, sf_dir):
    s = signal.speech_segments(_frames(spark, sf_dir), "user_id", margin=6.0, idle=1, least=1)
    return s.select("user_id", F.col("segment").cast("long"), F.col("start").alias("start_frame"), F.col("end").alias("end_frame"))


@query("""WITH x AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events)
          SELECT user_id, CAST(max(n) AS INTEGER) AS longest FROM (SELECT user_id, count(*) AS n FROM x GROUP BY user_id, event_type, g) GROUP BY user_id""")
def longest_run(spark, sf_dir):
    by, order = Window.partitionBy("user_id"), ("ts", "event_id")
    island = F.row_number().over(by.orderBy(*order)) - F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(*order))
    runs = table(spark, sf_dir, "events").select("user_id", "event_type", island.alias("island")).groupBy("user_id", "event_type", "island").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").cast("int").alias("longest"))


@query("""SELECT lang AS category, count(*) AS cases, count(quality) AS asserted, count(*) FILTER (quality = 1) AS passed,
          round(coalesce(CAST(count(*) FILTER (quality = 1) AS DOUBLE) / nullif(count(quality), 0), 1.0), 9) AS pass_rate
          FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def eval_by_category(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return reports.by_category(df, "lang", F.col("quality") == 1).withColumn("pass_rate", F.round("pass_rate", 9))


@query("SELECT lang, round(avg(CASE WHEN toxic = 0 THEN n_chars END), 6) AS mean_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def mean_without_errors(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return df.groupBy("lang").agg(F.round(reports.mean_without_errors(F.col("n_chars"), F.when(F.coalesce(F.col("toxic") != 0, F.lit(True)), "error")), 6).alias("mean_chars"))


_RULES = (("pressed_thing", "block", C.proximity("thing", "that", 30)), ("names_ation", "flag", r"\bation"), ("tion", "flag", "tion"))


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_replace(lower(text), '\s+', ' ', 'g') AS t FROM conversations),
r AS (SELECT conv_id, turn, regexp_matches(t, '(?s)(?:thing.{0,30}that|that.{0,30}thing)') AS a, regexp_matches(t, '\bation') AS b, regexp_matches(t, 'tion') AS c FROM t)
SELECT conv_id, turn, CASE WHEN a THEN 'block' WHEN b OR c THEN 'flag' ELSE 'allow' END AS severity,
       concat_ws(',', CASE WHEN a THEN 'pressed_thing' END, CASE WHEN b THEN 'names_ation' END, CASE WHEN c THEN 'tion' END) AS rules FROM r""")
def moderate(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", C.moderation(F.col("text"), _RULES).alias("m"))
    return df.select("conv_id", "turn", "m.severity", F.array_join("m.rules", ",").alias("rules"))


_NAMES = ["Supplier#000000001", "000000042", "000000007 and company supplier000000007"]


@query("""WITH b AS (SELECT unnest(['supplier000000001', '000000042', '000000007andcompanysupplier000000007']) AS e), n AS (SELECT s_suppkey, s_name, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS f FROM supplier)
          SELECT s_suppkey, s_name FROM n WHERE EXISTS (SELECT 1 FROM b WHERE contains(f, e) OR contains(e, f))""")
def name_blocklist(spark, sf_dir):
    return voices.blocked_names(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_name", _NAMES)


@query("SELECT o_custkey, o_orderkey, position FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS INTEGER) AS position FROM orders) WHERE position BETWEEN 2 AND 4")
def voice_list_topk(spark, sf_dir):
    return voices.latest(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 3, skip=1).select("o_custkey", "o_orderkey", "position")


def _consents(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("consent_id"), F.when(F.col("o_orderstatus") == "F", "verified").otherwise("pending").alias("status"),
                    (F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")).alias("expires_at"), F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate")).alias("revoked_at"))


_CONSENTS = "c AS (SELECT o_orderkey AS consent_id, CASE WHEN o_orderstatus = 'F' THEN 'verified' ELSE 'pending' END AS status, o_orderdate + INTERVAL 365 DAY AS expires_at, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END AS revoked_at FROM orders)"


@query(f"WITH {_CONSENTS} SELECT consent_id, CASE WHEN revoked_at IS NOT NULL THEN 'revoked' WHEN status = 'verified' AND TIMESTAMP '1997-06-01' >= expires_at THEN 'expired' ELSE status END AS effective FROM c")
def consent_status(spark, sf_dir):
    as_of = F.lit("1997-06-01 00:00:00").cast("timestamp")
    return _consents(spark, sf_dir).select("consent_id", C.consent_status(F.col("status"), F.col("revoked_at"), F.col("expires_at"), as_of).alias("effective"))


def _voices(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("consent_id"), "l_linenumber", F.when(F.col("l_linestatus") == "O", "enabled").otherwise("disabled").alias("status"))


@query(f"""WITH {_CONSENTS} SELECT l_orderkey AS consent_id, l_linenumber, coalesce(c.status = 'verified' AND revoked_at IS NULL AND TIMESTAMP '1997-06-01' < expires_at, FALSE) AS consent_active,
           coalesce(c.status = 'verified' AND revoked_at IS NULL AND TIMESTAMP '1997-06-01' < expires_at, FALSE) AND l_linestatus = 'O' AS usable FROM lineitem LEFT JOIN c ON l_orderkey = consent_id""")
def usable_voices(spark, sf_dir):
    df = voices.with_consent(_voices(spark, sf_dir), _consents(spark, sf_dir), F.lit("1997-06-01 00:00:00").cast("timestamp"))
    return df.select("consent_id", "l_linenumber", "consent_active", "usable")


@query("SELECT l_orderkey AS consent_id, l_linenumber, CASE WHEN l_orderkey % 11 = 0 THEN 'disabled' WHEN l_linestatus = 'O' THEN 'enabled' ELSE 'disabled' END AS status FROM lineitem")
def consent_revoke_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("consent_id"))
    return voices.revoked(_voices(spark, sf_dir), gone).select("consent_id", "l_linenumber", "status")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 13 = 0)")
def delete_cascade(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").filter("o_custkey % 13 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")


@query("""SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))
          / (sqrt(list_sum(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(b.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 6) AS similarity
          FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def speaker_similarity(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(C.cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


@query("SELECT doc_id, len(regexp_extract_all(text, '(?m)(?:^|[ \\n])((?:[A-Z]\\.?){2,6})(?:[ \\n]|$)')) > 0 AS any_acronym FROM documents")
def acronyms(spark, sf_dir):
    words = F.split("text", "[ \n]")
    return table(spark, sf_dir, "documents").select("doc_id", F.exists(words, C.is_acronym).alias("any_acronym"))


@query("""SELECT user_id, round(20 * log10(max(abs(value / 1000))), 6) AS peak_dbfs, round(10 * log10(avg(value / 1000 * (value / 1000))), 6) AS rms_dbfs,
          round(least(-23 - 10 * log10(avg(value / 1000 * (value / 1000))), 30, -1 - 20 * log10(max(abs(value / 1000)))), 6) AS gain_db FROM events GROUP BY user_id""")
def loudness_gain(spark, sf_dir):
    x = F.col("value") / 1000
    df = table(spark, sf_dir, "events").groupBy("user_id").agg(C.dbfs(F.max(F.abs(x))).alias("peak"), C.dbfs(F.sqrt(F.avg(x * x))).alias("rms"))
    gain = C.loudness_gain_db(F.col("rms"), F.col("peak"), target=-23.0)
    return df.select("user_id", F.round("peak", 6).alias("peak_dbfs"), F.round("rms", 6).alias("rms_dbfs"), F.round(gain, 6).alias("gain_db"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type = 'click' THEN least(greatest(length(props), 1), 5000) ELSE 1 END AS cost FROM events")
def request_cost(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").k.alias("k"), C.request_cost(F.col("event_type") == "click", F.length("props")).cast("long").alias("cost"))


@query()
def rate_limit(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("request_id"), "ts", F.length("props").alias("cost"))
    return voices.rate_limited(e, per_minute=0.002, characters_per_minute=0.02)


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_transform(string_split(CAST(l_partkey AS VARCHAR), ''), lambda c: c), ' ') AS spaced FROM lineitem")
def digit_by_digit(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", C.spoken_digits(F.col("l_partkey").cast("string"), {str(d): str(d) for d in range(10)}).alias("spaced"))


@query()
def cardinal(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numerals.cardinal_column(q).alias("words"), numerals.ordinal_column(q).alias("ordinal"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\S\n]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", unicode_text.normalized(F.col("text"))["text"].alias("normalized"))


@query()
def normalization_by_source(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("source", unicode_text.normalized(F.col("text")).alias("n"))
    return df.groupBy("source").agg(*[F.sum(f"n.{c}").alias(c) for c in unicode_text.COUNTERS], F.count_if("n.changed").alias("changed"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]+')) AS BIGINT) AS latin, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS digit,
           CAST(len(regexp_extract_all(text, '[^A-Za-z0-9]+')) AS BIGINT) AS other FROM documents""")
def segment_scripts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", codemix.script_counts(F.col("text")).alias("n")).select("doc_id", "n.latin", "n.digit", "n.other")


@query(rf"""
WITH w AS (SELECT lang, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)
SELECT lang, w AS word, count(*) AS n FROM w
WHERE NOT lower(w) IN ({", ".join(f"'{e}'" for e in sorted(romanised.ENGLISH))}) AND NOT regexp_matches(w, '(?i){"|".join(romanised.ENGLISH_PARTS)}')
AND regexp_matches(w, '[aeiouAEIOU]') AND NOT (w = upper(w) AND length(w) <= 5)
AND (lower(w) IN ({", ".join(f"'{e}'" for e in romanised.LEXICON)}) OR regexp_matches(w, '(?i)({"|".join(romanised.SIGNALS)})|({"|".join(romanised.ENDINGS)})$'))
GROUP BY lang, w""")
def romanised_words(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")).filter(romanised.romanised(F.col("word"))).select("lang", "word", "n")


@query()
def route_codemix(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", codemix.routed(F.col("text"))["value"].alias("routed"))


@query()
def transliterate(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", romanised.transliterated(F.col("text"))["value"].alias("text"))


@query()
def expand_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    text = F.concat_ws(" ", F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("₹"), F.col("o_totalprice").cast("string")), F.concat(F.col("o_custkey").cast("string"), F.lit("km")))
    return o.select("o_orderkey", spoken.expanded(text).alias("x")).select("o_orderkey", "x.value", "x.error_code")


@query()
def chunk_text(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.explode(chunking.chunked(F.col("text"))["value"]).alias("c"))
    return df.select("doc_id", "c.index", "c.text", "c.break_after", "c.pause_ms")


@query()
def g2p(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numerals.cardinal_column(F.col("l_quantity").cast("long")).alias("words"))
    said = phonemes.phoneme_lists(F.col("words"))["value"]
    return rows.select("l_orderkey", "l_linenumber", said.alias("p")).select("l_orderkey", "l_linenumber", phonemes.rendered_column(F.col("p")).alias("ipa"), phonemes.rendered_column(F.col("p"), ascii=True).alias("ascii"))


@query()
def text_frontend(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "text", frontend.processed(F.col("text")).alias("d"))
    return df.select("doc_id", "d.error_code", "d.value.routed", frontend.summary(F.col("text"), F.col("d")).alias("s")).select("doc_id", "error_code", "routed", "s.*")


@query()
def frontend_eval(spark, sf_dir):
    """Pass rate by role; a turn passes if its Latin words that are no romanised Malayalam come through unchanged."""
    df = table(spark, sf_dir, "conversations").select("role", "text", frontend.processed(F.col("text")).alias("d"))
    return reports.by_category(df.withColumn("passed", F.col("d.value.routed") == F.col("d.value.expanded")), "role", F.col("passed"))


_FRAUD = ("", " please send me the otp", " urgent, transfer money now", " hospital bill, the money is due", " your account number and ifsc", " this is the collector", " you won the lottery", " tell no one the pin")


def _rule_sql(name: str, pattern: str) -> str:
    return f"CASE WHEN regexp_matches(t, '(?i){pattern.replace(chr(39), chr(39) * 2)}') THEN '{name}' END"


@query(f"""WITH t AS (SELECT conv_id, turn, regexp_replace(lower(text || ([{", ".join(f"'{x}'" for x in _FRAUD)}])[CAST((conv_id + turn) % {len(_FRAUD)} AS INTEGER) + 1]), '\\s+', ' ', 'g') AS t FROM conversations),
r AS (SELECT conv_id, turn, concat_ws(',', {", ".join(_rule_sql(n, p) for n, s, p in C.STOCK_RULES if s == "block")}) AS hard, concat_ws(',', {", ".join(_rule_sql(n, p) for n, s, p in C.STOCK_RULES if s == "flag")}) AS soft FROM t)
SELECT conv_id, turn, CASE WHEN hard <> '' THEN 'block' WHEN soft <> '' THEN 'flag' ELSE 'allow' END AS severity, concat_ws(',', nullif(hard, ''), nullif(soft, '')) AS rules FROM r""")
def stock_moderation(spark, sf_dir):
    said = F.concat("text", F.element_at(F.array(*map(F.lit, _FRAUD)), ((F.col("conv_id") + F.col("turn")) % len(_FRAUD)).cast("int") + 1))
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", C.stock_moderation(said).alias("m"))
    return df.select("conv_id", "turn", "m.severity", F.array_join("m.rules", ",").alias("rules"))


@query("""WITH d AS (SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS n, CAST(n_chars % 40 AS DOUBLE) AS s FROM documents),
r AS (SELECT *, CASE WHEN s > 0 THEN n / s ELSE CAST('inf' AS DOUBLE) END AS rate FROM d)
SELECT doc_id, CASE WHEN n = 0 OR s < 2 OR s > 30 THEN 'validation_error' END AS error_code, CASE WHEN s > 0 THEN round(rate, 6) END AS rate,
concat_ws(',', CASE WHEN rate > 25 THEN 'transcript_too_long' END, CASE WHEN rate < 4 THEN 'transcript_too_short' END, CASE WHEN s > 12 THEN 'recording_long' END) AS advisories FROM r""")
def reference_plausibility(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 40).cast("double").alias("s"), "text")
    df = df.select("doc_id", "s", C.reference_plausibility(F.col("text"), F.col("s")).alias("p"))
    return df.select("doc_id", "p.error_code", F.when(F.col("s") > 0, F.round("p.characters_per_second", 6)).alias("rate"), F.array_join("p.advisories", ",").alias("advisories"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN round(l_quantity / l_discount, 6) ELSE CAST('inf' AS DOUBLE) END AS rtf FROM lineitem")
def real_time_factor_rows(spark, sf_dir):
    """Of an unknown discount the factor is infinite too, as the SQL has it."""
    x = synthesis.real_time_factor(F.col("l_quantity"), F.col("l_discount"))
    rtf = F.when(F.col("l_discount") > 0, F.round(x * 1e6) / 1e6).otherwise(float("inf"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rtf.alias("rtf"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 8) AS v FROM embeddings),
p AS (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) AS peak FROM x)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: abs(x) / greatest(peak, 1))), 3) AS loudness, CAST(len(v) AS BIGINT) AS n FROM p""")
def unit_loudness(spark, sf_dir):
    x = synthesis.unit_samples(F.transform("embedding", lambda v: v.cast("double") * 8))
    df = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))
    return df.select("vec_id", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v)), 3).alias("loudness"), F.size("x").cast("long").alias("n"))


@query("""SELECT vec_id, CAST(2 * len(embedding) + 3 * (vec_id % 50) + 150 AS BIGINT) AS n, round(2 * list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 6) AS total FROM embeddings""")
def joined_chunks(spark, sf_dir):
    samples = F.transform("embedding", lambda v: v.cast("double")).alias("samples")
    chunks = F.array(F.struct(samples, (F.col("vec_id") % 50).alias("pause_ms")), F.struct(samples, F.lit(50).cast("long").alias("pause_ms")))
    df = table(spark, sf_dir, "embeddings").select("vec_id", C.joined_chunks(chunks, 3000).alias("x"))
    return df.select("vec_id", F.size("x").cast("long").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("SELECT doc_id, substr(sha256(text), 1, 12) AS mark FROM documents")
def content_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.fingerprint(F.col("text")).alias("mark"))


@query("""SELECT event_type AS category, count(*) AS cases, count(*) FILTER (user_id % 7 = 0) AS errors, CAST(GROUPING(event_type) AS INTEGER) AS overall,
round(avg(value) FILTER (user_id % 7 <> 0), 4) AS mean_value FROM events GROUP BY GROUPING SETS ((event_type), ())""")
def synthesis_by_category(spark, sf_dir):
    error = F.when(F.col("user_id") % 7 == 0, "backend_unavailable")
    df = reports.synthesis_report(table(spark, sf_dir, "events"), "event_type", error, {"mean_value": F.col("value")})
    return df.withColumn("mean_value", F.round("mean_value", 4))


@query("""WITH s AS (SELECT user_id, sum(value) / 60 AS duration, avg(value) AS snr, CAST(count(*) FILTER (value < 20) AS DOUBLE) / count(*) AS silence, CAST(count(*) FILTER (value > 90) AS DOUBLE) / count(*) / 16 AS clipping,
min(value) / 63 AS shift, max(value) - 130 AS peak FROM events GROUP BY user_id)
SELECT user_id, concat_ws('; ', CASE WHEN duration < 0.5 THEN printf('too short (%.2fs)', duration) END, CASE WHEN duration > 30 THEN printf('too long (%.2fs)', duration) END, CASE WHEN snr < 20 THEN printf('snr too low (%.1f dB)', snr) END,
CASE WHEN clipping > 0.001 THEN printf('clipped (%.4f%% of samples)', clipping * 100) END, CASE WHEN silence > 0.6 THEN printf('mostly silence (%.0f%%)', silence * 100) END, CASE WHEN abs(shift) > 0.01 THEN printf('dc offset (%+.4f)', shift) END,
CASE WHEN peak < -40 THEN printf('level too low (peak %.1f dBFS)', peak) END) AS reasons FROM s""")
def quality_gate_texts(spark, sf_dir):
    n, v = F.count(F.lit(1)), F.col("value")
    s = table(spark, sf_dir, "events").groupBy("user_id").agg((F.sum("value") / 60).alias("duration"), F.avg("value").alias("snr"), (F.count_if(v < 20) / n).alias("silence"),
        (F.count_if(v > 90) / n / 16).alias("clipping"), (F.min("value") / 63).alias("shift"), (F.max("value") - 130).alias("peak"))
    return s.select("user_id", F.array_join(signal.quality_texts(*map(F.col, ("duration", "snr", "clipping", "silence", "shift", "peak"))), "; ").alias("reasons"))


@query("""SELECT l_orderkey, CASE max(CASE WHEN l_returnflag = 'R' THEN 3 WHEN l_linestatus = 'O' THEN 2 ELSE 1 END) WHEN 3 THEN 'fail' WHEN 2 THEN 'warn' ELSE 'ok' END AS status FROM lineitem GROUP BY l_orderkey""")
def worst_status(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "R", "fail").when(F.col("l_linestatus") == "O", "warn").otherwise("ok")
    df = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(status).alias("s"))
    return df.select("l_orderkey", C.worst(("ok", "warn", "fail"), F.col("s")).alias("status"))


@query("""SELECT o_orderkey, 'ഞാൻ Customer ' || o_custkey || '. ' || day(o_orderdate) || '-' || month(o_orderdate) || '-' || year(o_orderdate) || ' തീയതി, എന്റെ ശബ്ദം ഉപയോഗിച്ച് കൃത്രിമ ശബ്ദം നിർമ്മിക്കാൻ ഞാൻ അനുമതി നൽകുന്നു. സ്ഥിരീകരണ വാക്കുകൾ: '
|| o_orderstatus || ', ' || o_orderpriority || '.' AS phrase FROM orders""")
def consent_phrase(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit(" Customer "), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", C.consent_phrase(name, F.array("o_orderstatus", "o_orderpriority"), F.col("o_orderdate")).alias("phrase"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 365 DAY AS expires_at, TIMESTAMP '1997-06-01' >= o_orderdate + INTERVAL 365 DAY AS expired FROM orders")
def consent_expiry(spark, sf_dir):
    until = F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS")
    return table(spark, sf_dir, "orders").select("o_orderkey", until.alias("expires_at"), (F.lit("1997-06-01 00:00:00").cast("timestamp") >= until).alias("expired"))


@query("SELECT s_suppkey, replace(replace('അവൻ ' || s_name || 'ർ', 'ൻ', 'ന' || chr(3405) || chr(8205)), 'ർ', 'ര' || chr(3405) || chr(8205)) AS spelled FROM supplier")
def decompose_chillu(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", unicode_text.decomposed_chillu(F.concat(F.lit("അവൻ "), "s_name", F.lit("ർ"))).alias("spelled"))


_LETTERS = "അആഇഈഉഊഋഎഏഐഒഓഔകഖഗഘങചഛജഝഞടഠഡഢണതഥദധനപഫബഭമയരറലളഴവശഷസഹാിീുൂൃെേൈൊോൌൗംഃ്ൺൻർൽൾൿ൧a1"


@query(f"""WITH c AS (SELECT o_orderpriority, unnest(string_split(substr('{_LETTERS}', CAST(1 + o_orderkey % {len(_LETTERS)} AS INTEGER), CAST(1 + o_custkey % 5 AS INTEGER)), '')) AS c FROM orders)
SELECT o_orderpriority, count(*) FILTER (regexp_matches(c, '^[ക-ഺ]$')) AS consonants, count(*) FILTER (regexp_matches(c, '^[ൔ-ൖൺ-ൿ]$')) AS chillus,
count(*) FILTER (regexp_matches(c, '^[\\x{{0D3E}}-\\x{{0D4C}}\\x{{0D57}}\\x{{0D62}}\\x{{0D63}}]$')) AS signs, count(*) FILTER (regexp_matches(c, '^[അ-ഔൠൡ]$')) AS vowels FROM c GROUP BY o_orderpriority""")
def script_predicates(spark, sf_dir):
    """Letters by kind of texts that orders pick from the alphabet by their keys."""
    text = F.substr(F.lit(_LETTERS), (1 + F.col("o_orderkey") % len(_LETTERS)).cast("int"), (1 + F.col("o_custkey") % 5).cast("int"))
    df = table(spark, sf_dir, "orders").select("o_orderpriority", F.explode(F.split(text, "")).alias("c"))
    is_ = C.script_predicates(F.col("c"))
    kinds = {"consonants": "is_consonant", "chillus": "is_chillu", "signs": "is_vowel_sign", "vowels": "is_independent_vowel"}
    return df.groupBy("o_orderpriority").agg(*[F.count_if(is_[k]).alias(name) for name, k in kinds.items()])


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(p_name || ', ' || p_type, '[,\\s]+'), lambda k: k <> ''))), '|') AS keys FROM part")
def key_list(spark, sf_dir):
    keys = C.parsed_keys(F.concat("p_name", F.lit(", "), "p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.sort_array(keys), "|").alias("keys"))


@query(f"""WITH p AS (SELECT conv_id, turn, text AS h, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
w AS (SELECT conv_id, turn, list_filter(string_split(r, ' '), lambda w: w <> '') AS r, list_filter(string_split(h, ' '), lambda w: w <> '') AS h FROM p WHERE r IS NOT NULL),
{_TABLE})
SELECT conv_id, turn, CAST(drift AS INTEGER) AS drift, CAST(z.t[-1] AS INTEGER) AS edits FROM d""")
def edit_drift(spark, sf_dir):
    """Word edits of each turn against the one before, and insertions less deletions. The SQL fills the table of distances row
    by row."""
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    e = scoring.edit_counts(words(F.col("r")), words(F.col("h"))).alias("e")
    df = _pairs(spark, sf_dir).select("conv_id", "turn", e)
    return df.select("conv_id", "turn", (F.col("e.insertions") - F.col("e.deletions")).alias("drift"), F.expr("e.substitutions + e.deletions + e.insertions").cast("int").alias("edits"))


@query()
def edit_counts(spark, sf_dir):
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    return _pairs(spark, sf_dir).select("conv_id", "turn", scoring.edit_counts(words(F.col("r")), words(F.col("h"))).alias("e")).select("conv_id", "turn", "e.*")


@query()
def challenge_tokens(spark, sf_dir):
    """Tokens of consent challenges, and what is read from them again."""
    body = F.to_json(F.struct(F.col("o_orderkey").alias("subject"), F.col("o_orderdate").alias("issued_at")))
    df = table(spark, sf_dir, "orders").select("o_orderkey", scoring.challenge_tokens(body, b"example key").alias("token"))
    return df.select("o_orderkey", "token", scoring.challenge_bodies(F.col("token"), b"example key").alias("b")).select("o_orderkey", "token", "b.value", "b.error_code")


@query("""SELECT l_returnflag, count(*) FILTER (l_discount = 0) AS endless,
round(avg(CASE WHEN l_discount > 0 THEN l_tax / l_discount END), 6) AS mean FROM lineitem GROUP BY l_returnflag""")
def real_time_factor(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", synthesis.real_time_factor(F.col("l_tax"), F.col("l_discount")).alias("x"))
    endless = F.col("x") == float("inf")
    return df.groupBy("l_returnflag").agg(F.count_if(endless).alias("endless"), F.round(F.avg(F.when(~endless, F.col("x"))), 6).alias("mean"))


@query("SELECT page_id, substr(sha256(url || chr(10) || html), 1, 16) AS version FROM pages")
def fingerprint(spark, sf_dir):
    """Versions of pages: address and content."""
    return table(spark, sf_dir, "pages").select("page_id", C.fingerprint(F.concat("url", F.lit("\n"), "html"), 16).alias("version"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE) * 8)) AS x FROM embeddings)
SELECT vec_id, CAST(len(x) AS INTEGER) AS n, CASE WHEN list_max(x) >= 1 THEN 1.0 ELSE list_max(x) END = 1.0 AS full_scale,
CAST(CASE WHEN list_max(x) > 1 THEN len(list_filter(x, lambda v: v = list_max(x))) ELSE 0 END AS INTEGER) AS peaks FROM x""")
def unit_samples(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", synthesis.unit_samples(F.transform("embedding", lambda v: v.cast("double") * 8)).alias("x"))
    ones = F.size(F.filter("x", lambda v: F.abs(v) == 1.0))
    return df.select("vec_id", F.size("x").alias("n"), (ones > 0).alias("full_scale"), ones.alias("peaks"))


@query("""SELECT conv_id, CAST(sum(length(text) + 10 * turn) AS INTEGER) AS n, CAST(sum(10 * turn) AS INTEGER) AS silent, CAST(count(*) AS INTEGER) AS pieces
FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def synthesized_utterances(spark, sf_dir):
    """Turns as pieces of one sample a character and 10 ms of pause more with each turn."""
    samples = F.array_repeat(F.lit(0.5), F.length("text")).alias("samples")
    pieces = table(spark, sf_dir, "conversations").select("conv_id", "turn", samples, F.lit(1000).alias("sample_rate"), (10 * F.col("turn")).alias("pause_ms"))
    df = synthesis.utterances(pieces, "conv_id", "turn")
    return df.select("conv_id", F.size("samples").alias("n"), F.size(F.filter("samples", lambda x: x == 0)).alias("silent"), "pieces")
