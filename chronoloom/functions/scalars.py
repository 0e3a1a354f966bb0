"""Scalar functions: integer rounding, labels, thresholds, stable ids, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def half_up_div(num: Column, den: Column) -> Column:
    """num / den to the nearest integer, halves up; in wide decimals, since products overflow BIGINT."""
    n, d = num.cast(WIDE), den.cast(WIDE)
    return F.floor((n * 2 + d) / (d * 2)).cast("bigint")


def sample_to_us(sample: Column, rate: Column) -> Column:
    return half_up_div(sample.cast(WIDE) * 1_000_000, rate)


def mapped_sample(sample: Column, view_start: Column, view_end: Column, source_start: Column, source_end: Column) -> Column:
    """A place of a view in source time, along the straight line of its segment."""
    return source_start + half_up_div((sample - view_start).cast(WIDE) * (source_end - source_start).cast(WIDE), view_end - view_start)


def half_away_mean(a: Column, b: Column) -> Column:
    """Integer mean, halves away from zero."""
    t = a + b
    return F.when(t >= 0, F.floor((t + 1) / 2)).otherwise(F.ceil((t - 1) / 2)).cast("bigint")


def label_kind(label: Column) -> Column:
    up = F.upper(F.trim(F.coalesce(label, F.lit(""))))
    return F.when(up.isin("", "UNKNOWN", "NON_SPEECH"), "unknown").when(up.startswith("OVERLAP"), "overlap").otherwise("assigned")


def threshold_outcome(value: Column, threshold: Column, higher_is_better: Column) -> Column:
    """PASS, FAIL or, without a value or threshold, NOT_EVALUATED; equality passes."""
    good = F.when(higher_is_better, value >= threshold).otherwise(value <= threshold)
    return F.when(value.isNull() | threshold.isNull(), "NOT_EVALUATED").when(good, "PASS").otherwise("FAIL")


def stable_id(namespace: str, *parts: Column) -> Column:
    return F.concat(F.lit(namespace + "_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 20))


def base32_id(*parts: Column) -> Column:
    """First 26 characters of the lower-case base32 of the SHA-256 of the parts joined by bars.

    A character is five bits of the digest, which lie within three of its hexadecimal digits.
    """
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    letters = F.lit("abcdefghijklmnopqrstuvwxyz234567")

    def letter(k: int) -> Column:
        bits = F.conv(F.substring(digest, 5 * k // 4 + 1, 3), 16, 10).cast("int")
        return F.substring(letters, F.shiftright(bits, 7 - 5 * k % 4).bitwiseAND(31) + 1, F.lit(1))

    return F.concat(*[letter(k) for k in range(26)])


def timeline_digest(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """SHA-256 of the ordered rows of a key; independent of how they were partitioned."""
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    listed = F.array_sort(F.collect_list(F.struct(*columns, line.alias("_line"))))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["_line"]), "\n"), 256).alias("digest"), F.count("*").alias("n_rows"))


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))
