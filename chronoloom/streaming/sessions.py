"""Streaming forms: event-time windows, speech sessions and hysteresis with state."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoloom.session import kept_until_exit, shared_dir


def windowed_counts(events: DataFrame, at: str, keys: list[str], size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and key.

    In append mode the state of windows older than the watermark is dropped; complete mode keeps all.
    """
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), *keys).agg(F.count("*").alias("n_events")).select(F.col("w.start").alias("window_start"), *keys, "n_events")


def sessions(events: DataFrame, at: str, keys: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of events no more than *gap* apart, the streaming form of joining within a gap."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("n_events")).select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")


def streaming_hysteresis(frames: DataFrame, key: str, on: float = 0.5, off: float = 0.35, min_silence_us: int = 100_000) -> DataFrame:
    """Regions of :func:`chronoloom.operators.sequences.hysteresis_regions` over a stream of frames.

    Frames (key, start_us, end_us, p) of a key must come in order; a region is emitted once it closes.
    State a key: whether open, where it opened, the end of its last loud frame. A frame that does not
    begin where the last ended closes the region there. Regions still open when the stream is drained
    are in its state, where :func:`drained` finds them.
    """
    def step(ident: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, loud, last = state.get if state.exists else (-1, -1, -1)
        out = []
        for pdf in chunks:
            for s, e, p in pdf.sort_values("start_us")[["start_us", "end_us", "p"]].itertuples(index=False):
                if opened >= 0 and last >= 0 and s != last:
                    out.append((ident[0], opened, loud))
                    opened = -1
                if opened < 0:
                    if p >= on:
                        opened, loud = s, e
                elif p >= off:
                    loud = e
                elif s - loud >= min_silence_us:
                    out.append((ident[0], opened, loud))
                    opened = -1
                last = e
        state.update((int(opened), int(loud), int(last)))
        yield pd.DataFrame(out, columns=[key, "start_us", "end_us"])

    kind = frames.schema[key].dataType.simpleString()
    regions = frames.select(key, "start_us", "end_us", "p").groupBy(key).applyInPandasWithState(step, f"{key} {kind}, start_us BIGINT, end_us BIGINT", "opened BIGINT, loud BIGINT, last BIGINT", "append", GroupStateTimeout.NoTimeout)
    regions._left_open = _open_regions  # type: ignore[attr-defined]
    return regions


def _open_regions(state: DataFrame) -> DataFrame:
    """The regions that the state of :func:`streaming_hysteresis` still holds open."""
    held = F.col("value.groupState")
    return state.where(held["opened"] >= 0).select("key.*", held["opened"].alias("start_us"), held["loud"].alias("end_us"))


def drained(stream: DataFrame, complete: bool = False) -> DataFrame:
    """All that a stream gives of what is there now, as a table in the shared folder.

    Each batch is written whole, with *complete* in place of the one before, so nothing passes the driver.
    What an operator would give only later is at the end read from its state.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(path)
    for own in (path, path + "-state"):
        kept_until_exit(spark, own)

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if complete else "append").parquet(path)

    q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", path + "-state").outputMode("complete" if complete else "append").trigger(availableNow=True).start()
    q.awaitTermination()
    left_open = getattr(stream, "_left_open", None)
    place = spark._jvm.org.apache.hadoop.fs.Path(path + "-state/state")
    if left_open and place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):  # absent if nothing ever came
        left_open(spark.read.format("statestore").load(path + "-state")).select(*stream.columns).write.mode("append").parquet(path)
    return spark.read.schema(stream.schema).parquet(path)
