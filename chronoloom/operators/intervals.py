"""Interval algebra on labelled timelines: difference, clipping, cuts, padding, joins by overlap.

All intervals are half-open and in whole microseconds. Unions and cells of any number of sets are in
:mod:`chronoloom.operators.periods`; joins here are equi-joins on time buckets, never range loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.blocked import scanned
from chronoloom.operators.periods import HOUR_US, continuous_periods, sweep

MINUTE_US = 60_000_000


def overlap_us(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length two intervals have in common."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def bucket_width(*sides: DataFrame, least: int = MINUTE_US) -> int:
    """A width of buckets at which intervals cost at most two rows each on average: the greatest mean length.

    A single long interval costs as many rows as it has buckets, but no more than the rest saves.
    """
    mean = F.avg(F.col("end_us") - F.col("start_us"))
    return max(least, *[int(df.agg(mean).first()[0] or 0) + 1 for df in sides])


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", width: int | None = MINUTE_US) -> DataFrame:
    """Pairs of equal keys whose intervals overlap; right's interval as other_start_us, other_end_us.

    Both sides are spread over the buckets they touch and joined on keys and bucket; a pair is kept in
    the bucket where its common part begins, so it comes once. ``left_semi`` and ``left_anti`` keep
    left rows with or without a partner. Choose *width* near the longer typical interval: an interval
    of n buckets costs n rows; None measures it by :func:`bucket_width`, in one pass over both sides.
    """
    width = bucket_width(left, right) if width is None else width

    def spread(df: DataFrame, s: str, e: str) -> DataFrame:
        return df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.col(e) - 1) / width))))

    other = right.withColumnsRenamed({"start_us": "other_start_us", "end_us": "other_end_us"})
    if how in ("left_semi", "left_anti"):
        l, r = left.withColumn("_id", F.struct(*left.columns)), spread(other.select(*keys, "other_start_us", "other_end_us"), "other_start_us", "other_end_us")
        hit = spread(l, "start_us", "end_us").join(r, [*keys, "_b"]).where("start_us < other_end_us AND other_start_us < end_us").select("_id").distinct()
        return l.join(hit, "_id", how).drop("_id")
    pairs = spread(left, "start_us", "end_us").join(spread(other, "other_start_us", "other_end_us"), [*keys, "_b"])
    return pairs.where((F.col("start_us") < F.col("other_end_us")) & (F.col("other_start_us") < F.col("end_us")) & (F.floor(F.greatest("start_us", "other_start_us") / width) == F.col("_b"))).drop("_b")


def subtract(base: DataFrame, excluded: DataFrame, keys: list[str], width: int = HOUR_US) -> DataFrame:
    """Union of *base* without the union of *excluded*, as longest stretches."""
    cells = sweep({"_u": base, "_c": excluded}, keys, width).where("_u > 0 AND _c = 0")
    return continuous_periods(cells, keys, width).drop("n_rows")


def collar_zones(boundaries: DataFrame, at: str, collar_us: int) -> DataFrame:
    """Intervals of *collar_us* to either side of each boundary, to be taken out of a scope."""
    return boundaries.withColumn("start_us", F.col(at) - collar_us).withColumn("end_us", F.col(at) + collar_us).drop(at)


def clip(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """Intervals cut to [low, high); what lies outside is dropped."""
    cut = df.withColumn("start_us", F.greatest("start_us", low)).withColumn("end_us", F.least("end_us", high))
    return cut.where("end_us > start_us")


def merge_within(df: DataFrame, keys: list[str], gap_us: int, width: int = HOUR_US) -> DataFrame:
    """Periods that join intervals no more than *gap_us* apart (inclusive)."""
    wide = continuous_periods(df.select(*keys, "start_us", (F.col("end_us") + gap_us).alias("end_us")), keys, width)
    return wide.withColumn("end_us", F.col("end_us") - gap_us)


def points_inside(points: DataFrame, scope: DataFrame, keys: list[str], at: str, width: int = MINUTE_US) -> DataFrame:
    """Points that lie in some interval of *scope*."""
    as_spans = points.withColumn("start_us", F.col(at)).withColumn("end_us", F.col(at) + 1)
    return interval_join(as_spans, scope, keys, "left_semi", width).drop("start_us", "end_us")


def contained(rows: DataFrame, scope: DataFrame, keys: list[str], width: int = MINUTE_US) -> DataFrame:
    """Adds ``inside``: whether one period of the union of *scope* holds the whole interval."""
    whole = continuous_periods(scope, keys).drop("n_rows")
    held = interval_join(rows.withColumn("_row", F.struct(*rows.columns)), whole, keys, width=width).where("other_start_us <= start_us AND end_us <= other_end_us").select("_row", F.lit(True).alias("_in")).distinct()
    return rows.withColumn("_row", F.struct(*rows.columns)).join(held, "_row", "left").withColumn("inside", F.coalesce("_in", F.lit(False))).drop("_row", "_in")


def grid_starts(df: DataFrame, clip_us: int) -> Column:
    """Starts of the grid windows an interval touches."""
    return F.transform(F.sequence(F.floor(F.col("start_us") / clip_us), F.floor((F.col("end_us") - 1) / clip_us)), lambda x: x * clip_us)


def window_starts(start: Column, end: Column, size: int, shift: int) -> Column:
    """Starts of full sliding windows, plus one that ends at the end where the shift leaves a tail.

    An interval shorter than a window has one window, at its start.
    """
    last = F.greatest(start, end - size)
    full = F.sequence(start, last, F.lit(shift).cast("bigint"))
    return F.array_sort(F.array_distinct(F.concat(full, F.array(last))))


def cut_regions(df: DataFrame, most_us: int) -> DataFrame:
    """Regions cut every *most_us* from their start, with class by length.

    ANCHOR from 1.5 s, SUPPORT from 0.7 s, else MICRO.
    """
    cuts = F.sequence(F.col("start_us"), F.col("end_us") - 1, F.lit(most_us).cast("bigint"))
    out = df.withColumn("_s", F.explode(cuts)).withColumn("end_us", F.least(F.col("_s") + most_us, "end_us")).withColumn("start_us", F.col("_s")).drop("_s")
    size = F.col("end_us") - F.col("start_us")
    return out.withColumn("kind", duration_class(size))


def duration_class(size: Column) -> Column:
    return F.when(size >= 1_500_000, "ANCHOR").when(size >= 700_000, "SUPPORT").otherwise("MICRO")


def padded(df: DataFrame, keys: list[str], pad_us: int, low: Column, high: Column, width: int = HOUR_US) -> DataFrame:
    """Disjoint regions padded on both sides; neighbours share a small gap, the left its lower half."""
    near = scanned(df, keys, "start_us", ["end_us"], width, lag={"_p": F.col("end_us")}, lead={"_a": F.col("start_us")})
    left_gap, right_gap = F.col("start_us") - F.col("_p"), F.col("_a") - F.col("end_us")
    left = F.when(left_gap < 2 * pad_us, left_gap - F.floor(left_gap / 2)).otherwise(F.lit(pad_us))
    right = F.when(right_gap < 2 * pad_us, F.floor(right_gap / 2)).otherwise(F.lit(pad_us))
    return near.select(*df.columns, F.greatest(low, F.col("start_us") - left).alias("padded_start_us"), F.least(high, F.col("end_us") + right).alias("padded_end_us"))


def label_runs(df: DataFrame, keys: list[str], label: str = "label", width: int = HOUR_US) -> DataFrame:
    """Adjacent intervals of one label that touch become one; a run is named by the place where it begins."""
    near = scanned(df, keys, "start_us", ["end_us", label], width, lag={"_l": F.col(label), "_e": F.col("end_us")})
    same = F.coalesce((F.col("_l") == F.col(label)) & (F.col("_e") >= F.col("start_us")), F.lit(False))
    counted = scanned(near.withColumn("_f", F.when(same, 0).otherwise(-1)).drop("_l", "_e"), keys, "start_us", ["end_us", label, "_f"], width, total={"_r": F.col("_f")})
    return counted.groupBy(*keys, "_r", label).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n")).drop("_r")


def with_silence(spans: DataFrame, bounds: DataFrame, keys: list[str], label: str = "NON_SPEECH") -> DataFrame:
    """Labelled spans with the rest of each recording's bounds filled in."""
    gaps = subtract(bounds, spans, keys)
    return spans.select(*keys, "start_us", "end_us", "label").unionByName(gaps.select(*keys, "start_us", "end_us", F.lit(label).alias("label")))


def corrected(spans: DataFrame, corrections: DataFrame, keys: list[str], open_label: str = "UNKNOWN") -> DataFrame:
    """Spans of *open_label* replaced by human labels where corrections lie; other spans are kept.

    Corrections are clipped to the open spans they touch; the rest before and after stays open.
    """
    unknown = spans.where(F.col("label") == open_label)
    hits = interval_join(unknown, corrections.withColumnRenamed("label", "_human"), keys)
    human = hits.select(*keys, F.greatest("start_us", "other_start_us").alias("start_us"), F.least("end_us", "other_end_us").alias("end_us"), F.col("_human").alias("label"))
    rest = subtract(unknown, corrections, keys).withColumn("label", F.lit(open_label))
    names = [*keys, "start_us", "end_us", "label"]
    return spans.where(F.col("label") != open_label).select(*names).unionByName(human.select(*names)).unionByName(rest.select(*names))


def order_faults(df: DataFrame, keys: list[str], width: int = HOUR_US) -> DataFrame:
    """Intervals that begin before their predecessor ended, in order of start and end."""
    return scanned(df, keys, "start_us", ["end_us"], width, top_before={"_e": F.col("end_us")}).where("start_us < _e").drop("_e")
