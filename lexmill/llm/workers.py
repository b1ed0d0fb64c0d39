"""Makes the package importable in the Python workers of every executor."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from lexmill.sources import shared

_shipped: set[str] = set()
_caches: dict[str, Callable[[], None]] = {}


def cache(operator: str, clear: Callable[[], None]) -> None:
    """Names what an operator keeps in a worker process from one task to the next."""
    _caches[operator] = clear


_last: list[str] = []


def begin(operator: str) -> None:
    """Called by a task: Spark gives it the process of earlier tasks, and what other operators kept there goes, back to the
    system where the C library can."""
    for name, clear in _caches.items():
        if name != operator:
            clear()
    if _last == [operator]:
        return
    _last[:] = [operator]
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ship(spark: SparkSession) -> None:
    """Once an application: the package's own modules, as a zip that the driver serves. Batches to Python are small."""
    shared.small_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="lexmill-")) / "lexmill-modules.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
