"""Round trips through the file formats, in the shared folder, with SQL over what went in."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.plans.tables import _SAMPLES, _samples
from chronoloom.plans.training_data import table
from chronoloom.plans.views import VIEWS, ref_spans, words
from chronoloom.session import kept_until_exit, shared_dir
from chronoloom.sources.formats import WavSource, read_rttm, read_uem, read_words, rttm_lines, uem_lines
from chronoloom.sources.strict import corpus_turns

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    return kept_until_exit(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")


def _written(df: DataFrame, name: str) -> str:
    """The lines of *df* as text files."""
    path = _folder(df.sparkSession, name)
    df.write.text(path)
    kept_until_exit(df.sparkSession, path)
    return path


_GOOD = "start_us IS NOT NULL AND end_us > start_us"


@query(f"SELECT file_id, channel, speaker_id, start_us, end_us FROM rttm WHERE speaker_id IS NOT NULL AND {_GOOD} AND regexp_full_match(speaker_id, '\\S+')")
def rttm_files(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "rttm").where(f"{_GOOD} AND speaker_id IS NOT NULL").where(F.col("speaker_id").rlike(r"^\S+\z"))
    return read_rttm(spark, _written(rttm_lines(t), "rttm"))


@query(f"SELECT file_id, channel, start_us, end_us FROM uem WHERE {_GOOD}")
def uem_files(spark: SparkSession, d: str) -> DataFrame:
    return read_uem(spark, _written(uem_lines(table(spark, d, "uem").where(_GOOD)), "uem"))


@query(f"WITH {VIEWS} SELECT recording AS recording_id, word_id, start_us, end_us, text, label AS speaker_id, ascii(substr(text, 2)) % 2 = 0 AS attributable, false AS overlap_flag FROM words")
def word_files(spark: SparkSession, d: str) -> DataFrame:
    w = words(spark, d)
    lines = F.to_json(F.struct(F.col("recording").alias("recording_id"), "word_id", "start_us", "end_us", "text", F.col("label").alias("speaker_id"), (F.ascii(F.substring("text", 2, 1)) % 2 == 0).alias("attributable")))
    return read_words(spark, _written(w.select(lines.alias("value")), "words"))


@query(f"WITH {VIEWS}, u AS (SELECT recording, label || row_id % 4 AS who, start_us, end_us, row_number() OVER (PARTITION BY recording ORDER BY start_us, row_id) AS pos FROM ref), f AS (SELECT *, min(pos) OVER (PARTITION BY recording, who) AS f FROM u) SELECT recording AS file_id, 'SPEAKER_' || lpad(CAST(dense_rank() OVER (PARTITION BY recording ORDER BY f) - 1 AS VARCHAR), 2, '0') AS speaker_id, start_us, end_us FROM f")
def corpus_files(spark: SparkSession, d: str) -> DataFrame:
    """Each recording as a nested corpus document, and its utterances as turns again."""
    sec = lambda c: (F.col(c).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(20,6)").cast("string")
    u = F.struct("start_us", "row_id", F.struct(F.concat("label", (F.col("row_id") % 4).cast("string")).alias("speaker_id"), sec("start_us").alias("start"), sec("end_us").alias("end"), F.lit("x").alias("form")).alias("u"))
    docs = ref_spans(spark, d).groupBy("recording").agg(F.transform(F.sort_array(F.collect_list(u)), lambda x: x["u"]).alias("utterance"))
    text = F.to_json(F.struct(F.array(F.struct(F.col("recording").alias("id"), "utterance")).alias("document")))
    return corpus_turns(spark.read.text(_written(docs.select(text.alias("value")), "corpus")), "value")


@query(f"WITH {_SAMPLES} SELECT CAST(recording AS VARCHAR) AS recording, 8000 AS sample_rate_hz, 2 AS channels, count(*) AS n_frames, CAST(sum(x) AS BIGINT) AS total, CAST(sum(x * x) AS BIGINT) AS squares FROM s GROUP BY 1")
def wav_files(spark: SparkSession, d: str) -> DataFrame:
    """Samples as stereo files of 16 bits, written where they live, and read again in chunks."""
    folder = _folder(spark, "wav")
    local = folder.removeprefix("file://")

    def head(n: int) -> bytes:
        form = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", n)
        return b"RIFF" + struct.pack("<I", len(form) + n) + form

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by recording and k; a file has its name once it is whole."""
        os.makedirs(local, exist_ok=True)
        f, own, n = None, None, 0

        def end() -> None:
            size = f.tell() - len(head(0))
            f.seek(0)
            f.write(head(size))
            f.close()
            os.replace(f.name, f"{local}/{own}.wav")

        for b in batches:
            x, low = b.column(1).to_numpy(zero_copy_only=False).astype("<i2"), 0
            runs = pc.run_end_encode(b.column(0))
            for name, high in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if f is None or name != own:
                    if f is not None:
                        end()
                    f, own, n = open(f"{local}/.{name}-{uuid.uuid4().hex}", "wb"), name, n + 1  # noqa: SIM115
                    f.write(head(0))
                f.write(x[low:high].repeat(2).tobytes())
                low = high
        if f is not None:
            end()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    ordered = _samples(spark, d).repartition("recording").sortWithinPartitions("recording", "k").select("recording", "x")
    if not ordered.mapInArrow(write, "n BIGINT").agg(F.sum("n")).first()[0]:
        os.makedirs(local, exist_ok=True)
    kept_until_exit(spark, folder)
    spark.dataSource.register(WavSource)
    read = spark.read.format("wav").option("path", folder).option("framesPerChunk", 37).load()
    x = F.transform("samples", lambda v: F.round(v.cast("double") * 32768).cast("bigint"))
    add = lambda s, v: s + v
    chunk = read.select(F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("recording"), "sample_rate_hz", "channels", F.size("samples").alias("n"), F.aggregate(x, F.lit(0).cast("bigint"), add).alias("t"), F.aggregate(F.transform(x, lambda v: v * v), F.lit(0).cast("bigint"), add).alias("q"))
    return chunk.groupBy("recording", "sample_rate_hz", "channels").agg(F.sum("n").alias("n_frames"), F.sum("t").alias("total"), F.sum("q").alias("squares"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
