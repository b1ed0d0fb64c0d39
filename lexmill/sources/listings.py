"""Corpus listings, manifests and blocklists as tables."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UTTERANCE = (
    "id string, audio_path string, source string, license_id string, commercial_use_permitted boolean, text string, normalized_text string, phonemes string, "
    "speaker_id string, gender string, dialect string, consent_id string, duration_seconds double, sample_rate int, denoiser string, loudness_lufs double, "
    "quality map<string,double>, asr_text string, asr_cer double, split string, language string, created_at timestamp"
)
_DEFECT = "defect"


class ManifestError(ValueError):
    """The first bad line of a manifest."""

    def __init__(self, path: str, line: int, reason: str):
        super().__init__(f"manifest: {path}: line {line}: {reason}")
        self.path, self.line, self.reason = path, line, reason


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file and line (from 1) of text files that many tasks read at once. A file's byte ranges come in the order of
    their start, each whole in one task, so a line's number is its place in its range and the lines of the ranges before:
    a count for each range, summed up over the ranges of its file."""
    parts = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    lines = spark.read.text(path).select("value", *parts, F.monotonically_increasing_id().alias("turn"))
    ahead = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = lines.groupBy("file", "start").agg(F.min("turn").alias("first"), F.count(F.lit(1)).alias("n"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    line = F.col("turn") - F.col("first") + F.col("before") + 1
    return lines.join(ranges, ["file", "start"]).select("value", "file", line.alias("line"))


def read_listing(spark: SparkSession, path: str, audio_root: str = "") -> DataFrame:
    """id, audio_path, text, speaker_id of tab-separated lines; no quoting. Lines of fewer than four columns are left out;
    where any of them isn't blank, a warning says how many there are and where the first is."""
    cells = F.split("value", "\t", -1)
    short = spark.read.text(path).filter((F.size(cells) < 4) & (F.trim("value") != "")).limit(1)
    if not short.isEmpty():
        lines = numbered_lines(spark, path).filter((F.size(cells) < 4) & (F.trim("value") != ""))
        n, first = lines.agg(F.count(F.lit(1)), F.min(F.struct("file", "line"))).first()
        warnings.warn(f"{n} lines of fewer than four columns are left out, the first: {first.file}: line {first.line}", stacklevel=2)
    df = spark.read.text(path).select(cells.alias("c")).filter(F.size("c") >= 4)
    at = F.concat(F.lit(audio_root.rstrip("/") + "/"), F.col("c")[1]) if audio_root else F.col("c")[1]
    return df.select(F.col("c")[0].alias("id"), at.alias("audio_path"), F.col("c")[2].alias("text"), F.col("c")[3].alias("speaker_id"))


def read_manifest(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """Rows of a JSON-lines manifest; blank lines are passed over. A strict read looks at all lines first and raises
    ManifestError with file, number and reason of the first bad one; otherwise the columns file, line and defect tell."""
    schema = StructType.fromDDL(f"{UTTERANCE}, _broken string")
    row = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    df = numbered_lines(spark, path).filter(F.trim("value") != "").select("file", "line", row.alias("row")).select("file", "line", "row.*")
    needed = ["id", "audio_path", "source", "license_id", "commercial_use_permitted", "text", "speaker_id", "duration_seconds", "sample_rate"]
    rules = [(F.col("_broken").isNotNull(), "not valid JSON"), *[(F.col(c).isNull(), f"no {c}") for c in needed]]
    rules += [(F.col("duration_seconds") <= 0, "duration_seconds isn't positive"), (F.col("sample_rate") <= 0, "sample_rate isn't positive"), (F.col("asr_cer") < 0, "asr_cer is negative"), (F.col("language") != "ml", "language isn't ml")]
    df = df.withColumn(_DEFECT, F.coalesce(*[F.when(rule, text) for rule, text in rules])).drop("_broken")
    if not strict:
        return df
    bad = df.filter(F.col(_DEFECT).isNotNull()).select("file", "line", _DEFECT).orderBy("file", "line").limit(1).collect()
    if bad:
        raise ManifestError(*bad[0])
    return df.drop(_DEFECT, "file", "line")


def write_manifest(rows: DataFrame, path: str) -> int:
    """One JSON object a line, nulls included; replaces what is there. Returns the number of rows."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return seen.get["n"]


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """name of each line that is neither empty nor a comment; none, with a warning, where there is no such file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at) or files.getFileStatus(at).isDirectory():
        warnings.warn(f"no blocklist at {path}", stacklevel=2)
        return spark.createDataFrame([], "name string")
    name = F.trim("value")
    return spark.read.text(path).select(name.alias("name")).filter((F.col("name") != "") & ~F.col("name").startswith("#"))
