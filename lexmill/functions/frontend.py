"""The whole text frontend as one column: canonical form, spoken words, routed words, pieces, phonemes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.chunking import CHUNK, Chunking, chunk
from lexmill.functions.codemix import Mixing, route
from lexmill.functions.columns import has_malayalam
from lexmill.functions.outcomes import TextError, outcome
from lexmill.functions.phonemes import Sounding, phonemized
from lexmill.functions.spoken import Speaking, expand
from lexmill.functions.unicode_text import normalize


@dataclass(frozen=True)
class Frontend:
    most: int = 5000
    legacy: bool = False
    speaking: Speaking = field(default_factory=Speaking)
    mixing: Mixing = field(default_factory=Mixing)
    chunking: Chunking = field(default_factory=Chunking)
    sounding: Sounding = field(default_factory=Sounding)


VALUE = f"struct<normalized:string,expanded:string,routed:string,chunks:array<{CHUNK}>,phonemes:array<array<array<string>>>,changes:long,nta_fixed:long>"


def process(text: str, how: Frontend = Frontend()) -> dict:
    if not text.strip():
        raise TextError("the text is empty")
    if len(text) > how.most:
        raise TextError(f"the text has {len(text)} characters, {how.most} are allowed", "text_too_long")
    normal, counts = normalize(text, legacy=how.legacy)
    spoken = expand(normal, how.speaking)
    ready = route(spoken, how.mixing)
    parts = chunk(ready, how.chunking)
    return {
        "normalized": normal,
        "expanded": spoken,
        "routed": ready,
        "chunks": parts,
        "phonemes": [phonemized(p["text"], how.sounding) for p in parts],
        "changes": sum(counts.values()),
        "nta_fixed": counts["legacy_nta_fixed"],
    }


def processed(text: Column, how: Frontend = Frontend()) -> Column:
    """struct<value, error_code, error_message>. One Python pass does all stages."""
    return outcome(lambda t: process(t, how), VALUE)(text)


def summary(text: Column, done: Column) -> Column:
    """What the frontend did, in numbers."""
    v = done["value"]
    return F.struct(
        F.length(text).alias("chars_in"), F.length(v["routed"]).alias("chars_out"), F.size(v["chunks"]).alias("chunks"),
        v["changes"].alias("normalization_changes"), v["nta_fixed"].alias("legacy_nta_fixed"), has_malayalam(v["routed"]).alias("contains_malayalam"),
    )


def chunks(df: DataFrame, key: str, done: str) -> DataFrame:
    """One row for each piece: key, index, text, break_after, pause_ms, phonemes."""
    v = F.col(done)["value"]
    rows = df.select(key, F.explode(F.arrays_zip(v["chunks"].alias("c"), v["phonemes"].alias("phonemes"))).alias("x"))
    return rows.select(key, "x.c.*", "x.phonemes")
