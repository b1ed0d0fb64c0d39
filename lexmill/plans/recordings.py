"""Queries over long sequences and large groups: scans in ranges, exact percentiles, long blocklists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.operators import blocklist, long_audio, scans, selection, signal
from lexmill.plans.catalogue import _FRAMES, _frames, query, table
from lexmill.sources import shared
from lexmill.sources.wave_source import WaveSource
from lexmill.streaming.pieces import ORDERED, in_order, in_order_of_data

_RECORDING = """x AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, count(*) OVER () AS n FROM events),
e AS (SELECT 0 AS user_id, CAST(pos // 4 AS INTEGER) AS frame, 20 * log10(sqrt(avg(value * value)) + 1e-12) AS energy FROM x WHERE (pos // 4 + 1) * 4 <= n GROUP BY pos // 4)"""


def _segments_sql(frames: str, margin: float, idle: int, least: int) -> str:
    return f"""WITH {frames}, t AS (SELECT user_id, quantile_cont(energy, 0.1) + {margin} AS th, max(frame) AS fin FROM e GROUP BY user_id),
a AS (SELECT e.user_id, frame, fin, frame - lag(frame) OVER (PARTITION BY e.user_id ORDER BY frame) AS gap FROM e JOIN t ON e.user_id = t.user_id WHERE energy > th),
i AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap - 1 > {idle} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame) AS segment FROM a),
r AS (SELECT user_id, segment, min(frame) AS start_frame, CASE WHEN fin - max(frame) <= {idle} THEN fin + 1 ELSE max(frame) END AS end_frame FROM i GROUP BY user_id, segment, fin)
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(segment AS BIGINT) AS segment, CAST(start_frame AS INTEGER) AS start_frame, CAST(end_frame AS INTEGER) AS end_frame FROM r WHERE end_frame - start_frame >= {least}"""


def _named(segments):
    return segments.select(F.col("user_id").cast("long"), F.col("segment").cast("long"), F.col("start").cast("int").alias("start_frame"), F.col("end").cast("int").alias("end_frame"))


@query(_segments_sql(_FRAMES, 10.0, 9, 5))
def speech_segments(spark, sf_dir):
    """Each user's values as a clip, with the detector's own settings."""
    return _named(signal.speech_segments(_frames(spark, sf_dir), "user_id", margin=10.0, idle=9, least=5))


@query(_segments_sql(_RECORDING, 12.0, 2, 3))
def recording_segments(spark, sf_dir):
    """All values as one recording, scanned in ranges of 64 frames."""
    samples = scans.positions(table(spark, sf_dir, "events").select(F.lit(0).cast("long").alias("user_id"), "value", "ts", "event_id"), "user_id", ["ts", "event_id"])
    return _named(signal.speech_segments(signal.frame_energy(samples, "user_id", "pos", "value", 4), "user_id", margin=12.0, idle=2, least=3, size=64))


@query("""WITH p AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS x FROM lineitem)
SELECT l_returnflag, l_linestatus, round(quantile_cont(x, 0.001), 6) AS p001, round(quantile_cont(x, 0.1), 6) AS p10, round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.9), 6) AS p90, round(quantile_cont(x, 0.9999), 6) AS p9999
FROM p GROUP BY l_returnflag, l_linestatus""")
def exact_percentiles(spark, sf_dir):
    """Groups are narrowed down until at most 500 rows of different values are left in an interval."""
    at = {"p001": 0.001, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p9999": 0.9999}
    df = selection.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", at, most=500)
    return df.select("l_returnflag", "l_linestatus", *[F.round(c, 6).alias(c) for c in at])


@query(r"""WITH e AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS entry FROM conversations),
f AS (SELECT entry, regexp_replace(strip_accents(lower(entry)), '[^\p{L}\p{N}]', '', 'g') AS e FROM e), n AS (SELECT DISTINCT url AS name, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS n FROM pages)
SELECT name, entry FROM n JOIN f ON e <> '' AND n <> '' AND (contains(n, e) OR contains(e, n))""")
def blocklist_matches(spark, sf_dir):
    """Addresses of pages as names, the words of all conversations as entries."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("entry"))
    return blocklist.blocked(table(spark, sf_dir, "pages"), "url", words, "entry")


@query("""WITH t AS (SELECT conv_id, text, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS index FROM conversations)
SELECT conv_id, index, CAST(length(text) + 10 * (turn % 7) AS INTEGER) AS n, index AS position FROM t""")
def streamed_pieces(spark, sf_dir):
    """Turns as pieces of one sample a character, streamed in four batches that part each conversation, in order again."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("index", F.row_number().over(own) - 1)
    last = F.col("index") == F.max("index").over(Window.partitionBy("conv_id"))
    pieces = turns.select(F.col("conv_id").alias("utterance"), "index", F.array_repeat(F.lit(0.5), F.length("text")).alias("samples"), F.lit(1000).alias("sample_rate"),
        (10 * (F.col("turn") % 7)).alias("pause_ms"), last.alias("last"), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)).alias("batch"))
    came, left, mark = (shared.folder(spark, name) for name in ("pieces", "ordered", "pieces-checkpoint"))
    for k in range(4):
        pieces.filter(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(came)
    stream = spark.readStream.schema(pieces.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(came)
    ordered = in_order(stream, expire_ms=None).writeStream.format("parquet").option("path", left).option("checkpointLocation", mark)
    with in_order_of_data(spark):
        ordered.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(ORDERED).parquet(left).filter("error_code IS NULL")
    return out.select(F.col("utterance").alias("conv_id"), "index", F.size("samples").alias("n"), (F.row_number().over(Window.partitionBy("utterance").orderBy("index")) - 1).cast("long").alias("position"))


@query("""SELECT vec_id, CAST(16 AS INTEGER) AS n, 8.0 AS seconds, round(list_sum(list_transform(embedding[17:32], lambda x: CAST(x AS DOUBLE))), 4) AS total,
CAST(12 + 2 * 8 + 16 + 64 AS BIGINT) AS bytes_read FROM embeddings""")
def audio_slices(spark, sf_dir):
    """Each embedding as a WAV file of 64 samples at 8 a second, of which seconds 2 to 4 are read back."""
    spark.dataSource.register(WaveSource)
    at = shared.folder(spark, "clips")
    clips = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.col("embedding").cast("array<float>").alias("samples"), F.lit(8).alias("sample_rate"))
    clips.write.format("wav").option("subtype", "FLOAT").mode("append").save(at)
    back = spark.read.format("wav").option("start", 2).option("end", 4).load(at)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long").alias("vec_id"), F.size("samples").alias("n"), "seconds", F.round(total, 4).alias("total"), "bytes_read")


@query("""WITH x AS (SELECT user_id, value / 200 AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events),
h AS (SELECT user_id, pos // 4 AS hop, sum(v * v) AS e FROM x GROUP BY user_id, pos // 4 HAVING count(*) = 4),
w AS (SELECT user_id, e + lead(e, 1) OVER o + lead(e, 2) OVER o + lead(e, 3) OVER o AS e FROM h WINDOW o AS (PARTITION BY user_id ORDER BY hop)),
l AS (SELECT user_id, e / 16 AS p FROM w WHERE e IS NOT NULL AND -0.691 + 10 * log10(greatest(e / 16, 1e-30)) >= -70),
m AS (SELECT *, avg(p) OVER (PARTITION BY user_id) AS mean FROM l), g AS (SELECT user_id, -0.691 + 10 * log10(avg(p)) AS gated FROM m WHERE log10(p) > log10(mean) - 1 GROUP BY user_id),
r AS (SELECT user_id, 10 * log10(avg(v * v) + 1e-12) AS rms, max(abs(v)) AS peak FROM x GROUP BY user_id)
SELECT user_id, round(coalesce(gated, rms), 5) AS loudness, CASE WHEN gated IS NULL THEN 'rms_dbfs' ELSE 'itu_bs1770' END AS method, round(peak, 6) AS peak FROM r LEFT JOIN g USING (user_id)""")
def gated_loudness(spark, sf_dir):
    """Each user's values as a clip of 40 samples a second in blocks of two seconds, without the weighting filters."""
    placed = scans.positions(table(spark, sf_dir, "events").select("user_id", (F.col("value") / 200).alias("v"), "ts", "event_id"), "user_id", ["ts", "event_id"])
    blocks = placed.groupBy(F.col("user_id").alias("clip"), F.floor(F.col("pos") / 80).cast("int").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("p"))
    blocks = blocks.select("clip", "block", F.col("p.v").alias("samples"))
    out = long_audio.loudness(blocks, 40, 80, weighted=False)
    return out.select(F.col("clip").alias("user_id"), F.round("loudness", 5).alias("loudness"), "method", F.round("peak", 6).alias("peak"))
