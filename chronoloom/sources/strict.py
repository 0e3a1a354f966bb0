"""Strict JSON checks and corpus documents."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class _Issue(ValueError):
    pass


def _pairs(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Issue("DUPLICATE_KEY")
    return out


def _constant(name: str) -> float:
    raise _Issue("NOT_FINITE")


def json_issue(text: str | None, depth: int, nodes: int) -> str | None:
    """Why a text is not strict JSON: MISSING, UNREADABLE, DUPLICATE_KEY, NOT_FINITE, TOO_DEEP, TOO_LARGE."""
    if text is None:
        return "MISSING"
    try:
        root = json.loads(text, object_pairs_hook=_pairs, parse_constant=_constant)
    except _Issue as e:
        return str(e)
    except RecursionError:
        return "TOO_DEEP"
    except ValueError:
        return "UNREADABLE"
    seen, stack = 0, [(root, 1)]
    while stack:
        v, d = stack.pop()
        seen += 1
        if d > depth:
            return "TOO_DEEP"
        if seen > nodes:
            return "TOO_LARGE"
        if isinstance(v, (list, dict)):
            stack += [(x, d + 1) for x in (v.values() if isinstance(v, dict) else v)]
    return None


def json_issues(rows: DataFrame, row: str, column: str, depth: int = 32, nodes: int = 100_000) -> DataFrame:
    """row_id and issue of every row whose JSON is not strict. The JVM's readers accept repeated keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [json_issue(t, depth, nodes) for t in b.column(1).to_pylist()]
            t = pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["row_id", "issue"])
            yield t.filter(pc.is_valid(t.column("issue")))

    return rows.select(F.col(row).cast("bigint").alias("row_id"), F.col(column)).mapInArrow(run, "row_id BIGINT, issue STRING")


CORPUS = "STRUCT<document: ARRAY<STRUCT<id: STRING, utterance: ARRAY<STRUCT<speaker_id: STRING, start: STRING, end: STRING, form: STRING>>>>>"


def exact_us(text: Column) -> Column:
    """Decimal seconds as microseconds; null where they are finer than a microsecond or no number."""
    d = text.try_cast("decimal(30,12)") * F.lit(1_000_000).cast("decimal(8,0)")
    return F.when(d == F.floor(d), d).try_cast("bigint")


def corpus_turns(rows: DataFrame, column: str) -> DataFrame:
    """Utterances of nested corpus documents as turns, speakers numbered by first appearance a document.

    Utterances without exact times or with an end not after the start are left out.
    """
    from pyspark.sql import Window

    docs = rows.select(F.explode(F.from_json(column, CORPUS)["document"]).alias("d"))
    u = docs.select(F.col("d.id").alias("file_id"), F.posexplode("d.utterance").alias("pos", "u"))
    t = u.select("file_id", "pos", F.col("u.speaker_id").alias("who"), exact_us(F.col("u.start")).alias("start_us"), exact_us(F.col("u.end")).alias("end_us"))
    t = t.where("who IS NOT NULL AND end_us > start_us").withColumn("_f", F.min("pos").over(Window.partitionBy("file_id", "who")))
    number = F.dense_rank().over(Window.partitionBy("file_id").orderBy("_f")) - 1
    return t.select("file_id", F.format_string("SPEAKER_%02d", number).alias("speaker_id"), "start_us", "end_us")
