"""Readers and writers of the timeline formats: RTTM, UEM, word lists, WAV."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _us(seconds: Column) -> Column:
    """Decimal seconds as whole microseconds, half to even."""
    return F.bround(seconds * F.lit(1_000_000).cast("decimal(8,0)")).cast("bigint")


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """RTTM text files: file_id, channel, speaker_id, start_us, end_us; times to whole microseconds, half even.

    Lines need eight fields or more and begin with SPEAKER; blank lines and comments are skipped.
    For lines that may fail, use :func:`chronoloom.sources.lines.classify_lines`.
    """
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(f.alias("f")).where((F.size("f") >= 8) & ~F.col("f")[0].startswith("#") & (F.upper(F.col("f")[0]) == "SPEAKER"))
    start, length = F.col("f")[3].cast("decimal(20,9)"), F.col("f")[4].cast("decimal(20,9)")
    return rows.select(F.col("f")[1].alias("file_id"), F.col("f")[2].alias("channel"), F.col("f")[7].alias("speaker_id"), _us(start).alias("start_us"), _us(start + length).alias("end_us"))


def read_uem(spark: SparkSession, path: str) -> DataFrame:
    """UEM text files: file_id, channel, start_us, end_us; four fields a line."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(f.alias("f")).where((F.size("f") == 4) & ~F.col("f")[0].startswith("#"))
    return rows.select(F.col("f")[0].alias("file_id"), F.col("f")[1].alias("channel"), _us(F.col("f")[2].cast("decimal(20,9)")).alias("start_us"), _us(F.col("f")[3].cast("decimal(20,9)")).alias("end_us"))


def _seconds(us) -> object:  # noqa: ANN001
    return F.format_string("%d.%06d", F.floor(F.col(us) / 1_000_000), F.pmod(F.col(us), F.lit(1_000_000)))


def rttm_lines(turns: DataFrame) -> DataFrame:
    """One RTTM line a turn, seconds with six places; write with ``df.write.text``."""
    turns = turns.withColumn("_len", F.col("end_us") - F.col("start_us"))
    na = F.lit("<NA>")
    return turns.select(F.concat_ws(" ", F.lit("SPEAKER"), "file_id", "channel", _seconds("start_us"), _seconds("_len"), na, na, "speaker_id", na, na).alias("value"))


def uem_lines(scope: DataFrame) -> DataFrame:
    return scope.select(F.concat_ws(" ", "file_id", "channel", _seconds("start_us"), _seconds("end_us")).alias("value"))


WORDS = "recording_id STRING, word_id STRING, start_us BIGINT, end_us BIGINT, text STRING, speaker_id STRING, attributable BOOLEAN, overlap_flag BOOLEAN"


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Word lists as JSON lines under a closed schema: a malformed line or an unknown field fails the read."""
    names = [x.split()[0] for x in WORDS.split(", ")]
    lines = spark.read.text(path).where("trim(value) <> ''")
    strange = F.array_except(F.json_object_keys("value"), F.array(*[F.lit(x) for x in names]))
    held = F.when(F.size(strange) > 0, F.raise_error(F.concat(F.lit("unknown field: "), F.array_join(strange, ", "))).cast("string")).otherwise(F.col("value"))
    rows = lines.select(F.from_json(held, WORDS, {"mode": "FAILFAST"}).alias("w")).select("w.*")
    return rows.withColumns({"attributable": F.coalesce("attributable", F.lit(True)), "overlap_flag": F.coalesce("overlap_flag", F.lit(False))})


#: Bytes that a task reads, what opening a file counts as, and frames that are decoded at a time.
TASK_BYTES, OPEN_BYTES, FRAMES = 16 << 20, 16 << 10, 1 << 20


class _Pieces(InputPartition):
    """Ranges of files: (path, from, to); a chunk belongs to the range that holds its first byte."""

    def __init__(self, pieces: list[tuple[str, int, float]]) -> None:
        self.pieces = pieces


def wav_layout(path: str) -> tuple[int, int, int, int, int]:
    """(channels, rate, bytes a sample, offset of the data, frames) of a RIFF/WAVE PCM file."""
    with open(path, "rb") as f:
        head = f.read(12)
        if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
            raise ValueError(f"{path}: not RIFF/WAVE")
        channels = rate = width = 0
        while len(chunk := f.read(8)) == 8:
            name, size = chunk[:4], struct.unpack("<I", chunk[4:])[0]
            if name == b"fmt ":
                body = f.read(size + size % 2)
                code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
                if code not in (1, 0xFFFE) or bits not in (8, 16, 24, 32):
                    raise ValueError(f"{path}: not integer PCM")
                width = bits // 8
            elif name == b"data":
                if not width:
                    raise ValueError(f"{path}: data before format")
                return channels, rate, width, f.tell(), size // (channels * width)
            else:
                f.seek(size + size % 2, 1)
    raise ValueError(f"{path}: no data")


def _wav_sizes(path: str) -> Iterator[tuple[str, int]]:
    """A file and its size, or those of all WAV files of a folder by name."""
    if not os.path.isdir(path):
        yield path, os.path.getsize(path)
        return
    with os.scandir(path) as found:
        yield from sorted((f.path, f.stat().st_size) for f in found if f.name.lower().endswith(".wav") and f.name[0] not in "._")


class _WavReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options["path"].split(",") if p]
        self.chunk = int(options.get("framesPerChunk", 240_000))
        self.bytes = int(options.get("bytesPerTask", TASK_BYTES))
        if any("://" in p and not p.startswith("file://") for p in self.paths):
            raise ValueError("only local and shared paths are read")

    def partitions(self) -> list[InputPartition]:
        out, held, load = [], [], 0
        for p in self.paths:
            for path, size in _wav_sizes(p.removeprefix("file://")):
                cuts = [*range(0, max(size, 1), self.bytes), float("inf")]
                for low, high in zip(cuts, cuts[1:], strict=False):
                    cost = OPEN_BYTES + min(size, high) - low
                    if held and load + cost > self.bytes:
                        out.append(_Pieces(held))
                        held, load = [], 0
                    held.append((path, low, high))
                    load += cost
        return [*out, *([_Pieces(held)] if held else [])]

    def read(self, partition: _Pieces) -> Iterator:
        import pyarrow as pa

        held, n = [], 0
        for path, low, high in partition.pieces:
            channels, rate, width, at, frames = wav_layout(path)
            step = self.chunk * channels * width
            first, last = max(0, -(-(low - at) // step)), -(-frames // self.chunk)
            if high - at < last * step:
                last = max(0, -(-int(high - at) // step))
            many = max(1, FRAMES // self.chunk)
            for c in range(first, last, many):
                ends = [min(k * self.chunk, frames) for k in range(c, min(c + many, last) + 1)]
                mono = _decoded(path, at, channels, width, ends[0], ends[-1])
                places = pa.array([min(e - ends[0], len(mono)) for e in ends], pa.int32())
                k = len(ends) - 1
                held.append(pa.RecordBatch.from_arrays([pa.array([path] * k), pa.array(ends[:-1], pa.int64()), pa.array([rate] * k, pa.int32()), pa.array([channels] * k, pa.int32()), pa.ListArray.from_arrays(places, pa.array(mono))], ["path", "first_frame", "sample_rate_hz", "channels", "samples"]))
                n += len(mono)
                if n >= FRAMES or len(held) >= 1_000:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _decoded(path: str, at: int, channels: int, width: int, first: int, last: int) -> np.ndarray:
    """The channel mean, in [-1, 1], of the frames *first* to *last* of a file."""
    with open(path, "rb") as f:
        f.seek(at + first * channels * width)
        raw = np.frombuffer(f.read((last - first) * channels * width), np.uint8).reshape(-1, width)
    if width == 1:
        x = (raw[:, 0].astype(np.int32) - 128) << 24
    else:
        x = np.zeros(len(raw), np.uint32)
        for k in range(width):
            x |= raw[:, k].astype(np.uint32) << np.uint32(8 * (4 - width + k))
        x = x.view(np.int32)
    return (x.astype(np.float64) / 2147483648.0).reshape(-1, channels).mean(axis=1).astype(np.float32)


class WavSource(DataSource):
    """``spark.read.format("wav")``: PCM WAV files, or those of folders, as chunks of frames.

    Samples are the channel mean in [-1, 1]; option framesPerChunk bounds a chunk. A task reads ranges of
    files of bytesPerTask in all, so small files share a task; headers are read there, not on the driver.
    """

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return "path STRING, first_frame BIGINT, sample_rate_hz INT, channels INT, samples ARRAY<FLOAT>"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _WavReader(self.options)
