"""Sample-level transforms of audio chunks, as Arrow functions over arrays of samples."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_G, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def counter_random(seed: int, first: int, n: int) -> np.ndarray:
    """SplitMix64 outputs number *first* to *first* + *n* - 1: any place without those before it."""
    with np.errstate(over="ignore"):
        x = np.uint64(seed & (2**64 - 1)) + (np.arange(first + 1, first + n + 1, dtype=np.uint64) * _G)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def uniform_noise(seed: int, first: int, n: int) -> np.ndarray:
    """Values in [-1, 1) from the upper 53 bits."""
    return (counter_random(seed, first, n) >> np.uint64(11)).astype(np.float64) / 2.0**52 - 1.0


def resampled(samples: Column, rate: Column, target: int) -> Column:
    """Samples at *target* per second by linear interpolation; the last value is held."""
    @F.pandas_udf("array<float>")
    def run(s: pd.Series, r: pd.Series) -> pd.Series:
        def one(x, rate):  # noqa: ANN001, ANN202
            if x is None or rate is None or len(x) == 0:
                return None if x is None else np.zeros(0, np.float32)
            n = int(len(x) * target // rate)
            return np.interp(np.arange(n) * (rate / target), np.arange(len(x)), x).astype(np.float32)

        return pd.Series([one(x, k) for x, k in zip(s, r, strict=True)])

    return run(samples, rate)


def with_noise(chunks: DataFrame, snr_db: float, seed: int, keys: list[str], samples: str = "samples", first: str = "first_frame") -> DataFrame:
    """Adds noise at *snr_db* below the root mean square of the whole recording, by absolute place.

    The level is one aggregate over all chunks of a key; a chunk's noise depends on its first frame
    alone, so chunks may be anywhere.
    """
    square = F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x)
    level = chunks.groupBy(*keys).agg((F.sum(square) / F.greatest(F.sum(F.size(samples)), F.lit(1))).alias("_ms"))
    scale = F.sqrt(F.col("_ms")) * float(np.sqrt(3.0) * 10 ** (-snr_db / 20))

    @F.pandas_udf("array<float>")
    def add(s: pd.Series, at: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else (np.asarray(x) + f * uniform_noise(seed, int(a), len(x))).clip(-1, 1).astype(np.float32) for x, a, f in zip(s, at, k, strict=True)])

    return chunks.join(level, keys).withColumn(samples, add(F.col(samples), F.col(first), scale)).drop("_ms")


def log_mel(samples: Column, rate: int = 16_000, bins: int = 80) -> Column:
    """Log energies of *bins* mel bands, 25 ms Hamming windows every 10 ms, mean of each band removed."""
    size, shift = rate // 40, rate // 100
    width = 1 << (size - 1).bit_length()
    mel = lambda hz: 1127.0 * np.log1p(hz / 700.0)
    edges = np.linspace(mel(20.0), mel(rate / 2), bins + 2)
    at = mel(np.arange(width // 2 + 1) * rate / width)
    bank = np.clip(np.minimum((at - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None], (edges[2:, None] - at) / (edges[2:] - edges[1:-1])[:, None]), 0, None)

    @F.pandas_udf("array<array<float>>")
    def run(s: pd.Series) -> pd.Series:
        def one(x):  # noqa: ANN001, ANN202
            if x is None or len(x) < size:
                return None if x is None else []
            x = np.asarray(x, np.float64)
            frames = np.lib.stride_tricks.sliding_window_view(x, size)[::shift] * np.hamming(size)
            power = np.abs(np.fft.rfft(frames, width)) ** 2
            out = np.log(np.maximum(power @ bank.T, 1e-10))
            return list((out - out.mean(axis=0)).astype(np.float32))

        return s.map(one)

    return run(samples)


def mapped_points(points: DataFrame, segments: DataFrame, keys: list[str], at: str, width: int = 3_600_000_000) -> DataFrame:
    """Points in view time moved to source time, by the first segment that holds them.

    *segments* (keys, view_start, view_end, source_start, source_end) do not overlap but may touch; a
    point at a seam takes the earlier one. Points in no segment are left out. Points and segment
    starts are sorted together once; the latest start is the segment, or, at a seam, the one before.
    """
    from chronoloom.functions.scalars import mapped_sample
    from chronoloom.operators.blocked import scanned

    seg = F.struct("view_start", "view_end", "source_start", "source_end")
    s = scanned(segments, keys, "view_start", ["view_end"], width, lag={"_b": seg}).select(*keys, F.col("view_start").alias("_t"), F.lit(0).alias("_side"), F.struct(seg.alias("_s"), F.col("_b")).alias("_q"))
    p = points.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*points.columns).alias("_p"))
    found = scanned(s.unionByName(p, allowMissingColumns=True), keys, "_t", ["_side"], width, last={"_l": F.col("_q")}).where("_side = 1")
    use = F.when(F.col("_l._b.view_end") == F.col("_t"), F.col("_l._b")).otherwise(F.col("_l._s"))
    held = found.withColumn("_u", use).where("_u IS NOT NULL AND _t <= _u.view_end")
    u = lambda n: F.col(f"_u.{n}")
    return held.select("_p.*", mapped_sample(F.col("_t"), u("view_start"), u("view_end"), u("source_start"), u("source_end")).alias("source_us"))


def doubled(samples: DataFrame, keys: list[str], rows: int = 100_000) -> DataFrame:
    """Twice the rate: between each sample (keys, k, x) and the next stands their mean, halves away from zero.

    The last sample of a key is followed by itself. Samples are taken in blocks of *rows*.
    """
    from chronoloom.functions.scalars import half_away_mean
    from chronoloom.operators.blocked import scanned

    near = scanned(samples.select(*keys, "k", "x"), keys, "k", [], rows, lead={"_y": F.col("x")})
    mean = half_away_mean(F.col("x"), F.coalesce("_y", "x"))
    two = F.explode(F.array(F.struct((F.col("k") * 2).alias("k"), F.col("x").alias("x")), F.struct((F.col("k") * 2 + 1).alias("k"), mean.alias("x")))).alias("e")
    return near.select(*keys, two).select(*keys, "e.k", "e.x")
