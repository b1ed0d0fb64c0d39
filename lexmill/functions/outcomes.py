"""Text functions as columns: struct<value, error_code, error_message>, so that one bad row never ends a job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


# Error codes of all outcomes.
ERROR_CODES = (
    "configuration_error", "feature_disabled", "validation_error", "text_too_long", "unsupported_script", "voice_not_found", "consent_required",
    "moderation_blocked", "audio_error", "backend_unavailable", "rate_limited", "unauthenticated", "internal_error",
)


# The HTTP status of each code; 500 for those not named.
STATUSES = {
    "feature_disabled": 404, "validation_error": 422, "text_too_long": 413, "unsupported_script": 422, "voice_not_found": 404, "consent_required": 403,
    "moderation_blocked": 403, "audio_error": 422, "backend_unavailable": 503, "rate_limited": 429, "unauthenticated": 401,
}


def status_of(code: Column) -> Column:
    """The status of an error code; 200 without one."""
    out = F.when(code.isNull(), 200)
    for name, status in STATUSES.items():
        out = out.when(code == name, status)
    return out.otherwise(500)


class TextError(ValueError):
    """A text that can't be processed; code names the reason."""

    def __init__(self, message: str, code: str = "validation_error"):
        super().__init__(message)
        self.code = code


def parts(batches: Iterator[pd.Series], most: int = 1 << 18) -> Iterator[pd.Series]:
    """Batches in runs of rows of about `most` characters: what is made of a text can take many times its memory."""
    for batch in batches:
        start = held = 0
        for i, text in enumerate(batch):
            size = 64 + (0 if text is None else len(text))
            if held and held + size > most:
                yield batch.iloc[start:i]
                start, held = i, 0
            held += size
        yield batch.iloc[start:]


def outcome(f: Callable[[str], object], value_type: str) -> Callable[[Column], Column]:
    """Column function of f, with each distinct text of neighbouring rows handled once. Null: all fields null.
    Value types that hold structs take a tuple, dict or list as Arrow does."""

    def one(text: str) -> dict:
        try:
            return {"value": f(text), "error_code": None, "error_message": None}
        except ValueError as e:
            return {"value": None, "error_code": getattr(e, "code", "validation_error"), "error_message": str(e)}

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in parts(batches):
            done = {t: one(t) for t in batch.dropna().unique()}
            none = dict.fromkeys(("value", "error_code", "error_message"))
            yield pd.DataFrame([done.get(t, none) for t in batch], columns=list(none), dtype=object)

    return F.pandas_udf(run, f"value {value_type}, error_code string, error_message string")
