"""Tables written to the folder that driver and executors share.

Intermediate results that are read more than once are written there as Parquet: a lost executor costs
a re-read, never a recomputation of the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; a folder of our own only where that is unset (tests)."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _own.setdefault(app, f"file://{tempfile.mkdtemp(prefix='lexmill-')}")
    return f"{base.rstrip('/')}/lexmill-{app}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df now and returns a frame that reads it back."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lexmill_path = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Deletes staged tables that no later plan reads."""
    for df in frames:
        if df is not None and (path := getattr(df, "_lexmill_path", None)):
            delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Deletes everything that this application has staged, once its results are written."""
    delete(spark, *_written.pop(spark.sparkContext.applicationId, []))


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        files, at = _at(spark, path)
        files.delete(at, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    files, at = _at(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file, whole or not at all."""
    files, at = _at(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    out = files.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.rename(new, at):
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
