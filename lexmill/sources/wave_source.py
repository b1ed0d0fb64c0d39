"""WAV files as a Spark data source: reads of the seconds asked for, writes whose files count once the job commits.

    spark.dataSource.register(WaveSource)
    spark.read.format("wav").option("start", 2.0).option("end", 4.5).load(path)
    clips.select("name", "samples", "sample_rate").write.format("wav").option("subtype", "PCM_24").mode("append").save(path)

Reading: a file's chunks are walked from header to header, and of its samples only the frames of [start, end) are read.
Writing: tasks write under `_temporary`, and tell the driver what they wrote; it moves the files to their names when all
tasks have ended, and removes the folder, what lost or failed tasks left in it too. Paths: what pyarrow can open.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lexmill.functions.audio import AudioError

READ = "path string, samples array<float>, sample_rate int, seconds double, bytes_read long, error_code string, error_message string"
WRITTEN = "name string, samples array<float>, sample_rate int"
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
#: Bytes of a sample and format tag of what can be written.
SUBTYPES = {"PCM_16": (2, PCM), "PCM_24": (3, PCM), "FLOAT": (4, FLOAT)}
#: Bytes of files that a task reads, or about.
SPLIT = 64 << 20


def samples_of(raw: bytes, width: int, tag: int, channels: int) -> np.ndarray:
    """Samples in [-1, 1] of little-endian frames, channels averaged."""
    frame = width * channels
    b = np.frombuffer(raw[: len(raw) // frame * frame], np.uint8).reshape(-1, width)
    if tag == FLOAT:
        x = b.copy().view(f"<f{width}")[:, 0].astype(float)
    elif width == 1:
        x = b[:, 0] / 128.0 - 1
    else:
        full = np.zeros((len(b), 4), np.uint8)
        full[:, 4 - width :] = b
        x = full.view("<i4")[:, 0] / 2.0**31
    return x.reshape(-1, channels).mean(axis=1).astype(np.float32)


def frames_of(x: np.ndarray, subtype: str) -> bytes:
    width, tag = SUBTYPES[subtype]
    if tag == FLOAT:
        return x.astype("<f4").tobytes()
    top = (1 << (8 * width - 1)) - 1
    whole = (np.clip(x.astype(float), -1, 1) * top).astype("<i4")
    return whole.view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def encoded(x: np.ndarray, rate: int, subtype: str) -> bytes:
    """A whole file of one channel."""
    width, tag = SUBTYPES[subtype]
    data = frames_of(x, subtype)
    form = struct.pack("<HHIIHH", tag, 1, rate, rate * width, width, 8 * width)
    body = b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def read_slice(file: pa.NativeFile, start: float, end: float | None) -> tuple[np.ndarray, int, float, int]:
    """Samples of [start, end) seconds, rate, seconds of the whole file, and how many bytes were read of it."""
    seen, form = 12, None
    head = file.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise AudioError("not a WAV file")
    whole = file.size()
    at = 12
    while at + 8 <= whole:
        file.seek(at)
        kind, size = struct.unpack("<4sI", file.read(8))
        seen += 8
        if kind == b"fmt ":
            form = file.read(min(size, 40))
            seen += len(form)
        elif kind == b"data":
            break
        at += 8 + size + size % 2
    else:
        raise AudioError("no samples")
    if form is None or len(form) < 16:
        raise AudioError("no format before the samples")
    tag, channels, rate, _, frame, bits = struct.unpack("<HHIIHH", form[:16])
    if tag == EXTENSIBLE and len(form) >= 26:
        tag = struct.unpack("<H", form[24:26])[0]
    width = frame // channels if channels else 0
    if (tag, width) not in {(PCM, 1), (PCM, 2), (PCM, 3), (PCM, 4), (FLOAT, 4), (FLOAT, 8)} or bits > 8 * width or not rate:
        raise AudioError(f"format {tag} of {bits} bits isn't known")
    n = min(size, whole - at - 8) // frame  # a file that is still written, or was cut, says more than it has
    if not n:
        raise AudioError("no samples")
    first = min(n, max(0, int(start * rate)))
    last = n if end is None else min(n, max(first, int(end * rate)))
    file.seek(at + 8 + first * frame)
    raw = file.read((last - first) * frame)
    return samples_of(raw, width, tag, channels), rate, n / rate, seen + len(raw)


@dataclass
class Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.start, self.end = float(options.get("start", 0)), float(options["end"]) if "end" in options else None

    def partitions(self) -> list[Files]:
        store, at = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(at)
        found = store.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
        if info.type == fs.FileType.NotFound:
            raise AudioError(f"nothing at {self.path}")
        out, size = [], SPLIT
        for f in sorted((f for f in found if f.type == fs.FileType.File and "/_" not in f.path.removeprefix(at) and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            if size >= SPLIT:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size if self.end is None else min(f.size, 1 << 20)
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            try:
                with store.open_input_file(path) as file:
                    x, rate, seconds, seen = read_slice(file, self.start, self.end)
                yield path, x.tolist(), rate, seconds, seen, None, None
            except AudioError as e:
                yield path, None, None, None, None, e.code, str(e)


@dataclass
class Wrote(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.subtype, self.overwrite = options["path"].rstrip("/"), options.get("subtype", "PCM_16"), overwrite
        if self.subtype not in SUBTYPES:
            raise AudioError(f"subtype {self.subtype} isn't one of {', '.join(SUBTYPES)}")
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Wrote:
        store, at = fs.FileSystem.from_uri(self.path)
        own, done = f"{at}/_temporary/{self.job}/{uuid.uuid4().hex}", []
        store.create_dir(own, recursive=True)
        for row in iterator:
            if row.name is None or row.samples is None or "/" in row.name or row.name.startswith((".", "_")):
                raise AudioError(f"no name or no samples: {row.name}")
            path = f"{own}/{row.name}.wav"
            with store.open_output_stream(path) as out:
                out.write(encoded(np.array(row.samples, np.float32), row.sample_rate, self.subtype))
            done.append((path, f"{at}/{row.name}.wav"))
        return Wrote(done)

    def _clear(self) -> None:
        store, at = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(f"{at}/_temporary/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{at}/_temporary/{self.job}")
        if not store.get_file_info(fs.FileSelector(f"{at}/_temporary", allow_not_found=True)):
            if store.get_file_info(f"{at}/_temporary").type == fs.FileType.Directory:
                store.delete_dir(f"{at}/_temporary")

    def commit(self, messages: list[Wrote | None]) -> None:
        store, at = fs.FileSystem.from_uri(self.path)
        moves = [x for m in messages if m is not None for x in m.files]
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise AudioError("two clips of one name")
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(at)):
                if old.type == fs.FileType.File:
                    store.delete_file(old.path)
        for path, to in moves:
            store.move(path, to)
        self._clear()

    def abort(self, messages: list[Wrote | None]) -> None:
        self._clear()


class WaveSource(DataSource):
    """Options: path; start and end (seconds) of a read; subtype of a write."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return READ

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options), overwrite)
