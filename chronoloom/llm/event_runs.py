"""Repeated consecutive events in sequences: runs of any length in groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.blocked import BLOCK, across, before, block_of, counted_width, inside, null_safe_keys, restored, upto

HOUR_US = 3_600_000_000
PAUSE_US = 300_000


def collapse_runs(events: DataFrame, keys: list[str], label: str, start: str, end: str, row: str, pause: int = PAUSE_US, width: int | None = None) -> DataFrame:
    """Collapse runs of consecutive events of one label that follow almost without pause.

    Events of each key are taken in order of start, end and row. A run is a longest stretch of
    consecutive events with the same label in which each starts no later than *pause* after the
    latest end before it in the run. Returns the keys, label, start, end, n_events, first_row,
    last_row and covered time ``duration`` (last end minus first start), single events included.

    Method: a lag window compares each event with its predecessor, changes are flagged, the flags
    cumulatively summed into run identifiers and runs aggregated. The windows run inside blocks of
    *width* on the start axis (an hour, or as narrow as the densest hour asks for), so a key with a third of all events is many tasks. A one-row summary
    a block carries the last label and latest end into the next, and where a run crosses blocks its
    pieces meet by the block and number of its beginning.

    Defined cases: events without label, start or end, and such whose end is not after the start, are
    ignored; null keys form a group of their own; repeated events follow each other without pause;
    no events give no runs; ties are ordered by *row*; other columns are never read.
    """
    rows = events.select(*keys, F.col(label).alias("label"), F.col(start).cast("bigint").alias("start"), F.col(end).cast("bigint").alias("end"), F.col(row).cast("bigint").alias("row"))
    rows = rows.where("label IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL AND end > start")
    width = counted_width(rows, keys, F.col("start"), HOUR_US) if width is None else width
    rows = rows.withColumn(BLOCK, block_of(F.col("start"), width))
    rows, ks = null_safe_keys(rows, keys)
    rows = rows.drop(*keys)
    order = ("start", "end", "row")
    w = inside(ks, *order)
    # stretches of one label inside the block, and the latest end before a row in its stretch
    prev = F.lag("label").over(w)
    local = rows.withColumn("_s", F.sum(F.when(prev == F.col("label"), 0).otherwise(1)).over(upto(w)))
    inner = F.max("end").over(before(inside([*ks, "_s"], *order)))
    local = local.withColumn("_m", inner)

    # a block's first label, last label, number of stretches and latest end of its last stretch
    last_s = local.groupBy(*ks, BLOCK, "_s").agg(F.max("end").alias("_e"), F.first("label").alias("_l"))
    block = last_s.groupBy(*ks, BLOCK).agg(F.min(F.struct("_s", "_l")).alias("_a"), F.max(F.struct("_s", "_l", "_e")).alias("_z"))
    a = across(ks)
    block = block.select(*ks, BLOCK, F.col("_a._l").alias("_first"), F.col("_z._l").alias("_last"), F.col("_z._e").alias("_tail"), (F.col("_z._s") == 1).alias("_one"))
    block = block.withColumn("_on", F.coalesce(F.lag("_last").over(a) == F.col("_first"), F.lit(False)))
    block = block.withColumn("_c", F.sum(F.when(F.col("_on") & F.col("_one"), 0).otherwise(1)).over(upto(a)))
    reach = F.max("_tail").over(upto(across([*ks, "_c"])))
    block = block.withColumn("_reach", reach).select(*ks, BLOCK, F.when(F.col("_on"), F.lag("_reach").over(a)).alias("_in"))

    flagged = local.join(block, [*ks, BLOCK])
    latest = F.greatest(F.col("_m"), F.when(F.col("_s") == 1, F.col("_in")))  # null: first of its stretch
    flagged = flagged.withColumn("_n", F.when(F.col("start") <= latest + pause, 0).otherwise(1)).withColumn("_r", F.sum("_n").over(upto(w)))
    pieces = flagged.groupBy(*ks, BLOCK, "_r").agg(
        F.first("label").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.min(F.struct(*order)).alias("_f"), F.max(F.struct(*order)).alias("_l")
    )
    # piece 0 of a block continues the last run begun before the block
    begun = pieces.groupBy(*ks, BLOCK).agg(F.max("_r").alias("_top"))
    begun = begun.withColumn("_from", F.last(F.when(F.col("_top") > 0, F.struct(F.col(BLOCK).alias("b"), F.col("_top").alias("r"))), True).over(before(a))).select(*ks, BLOCK, "_from")
    home = F.when(F.col("_r") > 0, F.struct(F.col(BLOCK).alias("b"), F.col("_r").alias("r"))).otherwise(F.col("_from"))
    runs = (
        pieces.join(begun, [*ks, BLOCK]).withColumn("_home", home)
        .groupBy(*ks, "_home.b", "_home.r")
        .agg(F.first("label").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n_events"), F.min("_f").alias("_f"), F.max("_l").alias("_l"))
    )
    return runs.select(*restored(keys), "label", "start", "end", "n_events", F.col("_f.row").alias("first_row"), F.col("_l.row").alias("last_row"), (F.col("end") - F.col("start")).alias("duration"))
