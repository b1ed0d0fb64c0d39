"""Files in the folder that driver and executors share, through Spark's own file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; in one of our own where that is unset, in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='lexmill-')}"
        base = _own[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_BATCH, _SPARKS_OWN = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Where Spark's own bound of a batch that goes to Python is unchanged, batches are of 8 MB: whole texts of 64 MB are held
    by both sides, twice while they grow."""
    if spark.conf.get(_BATCH).rstrip("bB") == str(_SPARKS_OWN):
        spark.conf.set(_BATCH, str(8 << 20))


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written there and read back."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing where there is none."""
    files, at = _files(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(at)) if files.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    files, at = _files(spark, path)
    stream = files.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, path: str, text: str) -> bool:
    """The text as a new file, whole or not at all; False if there is one already. The file comes into being under its
    name by one rename that doesn't overwrite, which HDFS does at once; object stores need a committer of their own."""
    files, new = _files(spark, f"{path}.{uuid.uuid4().hex}.new")
    out = files.create(new, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options, "Rename").NONE
    try:
        context.rename(new, jvm.org.apache.hadoop.fs.Path(path), options)
    except Exception as e:  # py4j has one class for what Java throws
        files.delete(new, False)
        if "AlreadyExists" in str(e):
            return False
        raise
    return True
