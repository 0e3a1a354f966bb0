"""Selection under a budget: strata, ranks, knapsack, oracle curves, constrained grids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.blocked import counted_rank, scanned


def evenly_ranked(rows: DataFrame, strata: list[str], axis: str, order: list[str], take: int, width: float) -> DataFrame:
    """Per stratum up to *take* rows whose ranks on *axis* are spread evenly from first to last, halves to even."""
    ranked = counted_rank(rows, strata, axis, [F.col(c) for c in order], width, "_rank")
    n, k = F.col("_size"), F.least(F.col("_size"), F.lit(take))
    at = F.transform(F.sequence(F.lit(0).cast("bigint"), k - 1), lambda i: F.when(k > 1, F.bround(i * (n - 1) / (k - 1))).otherwise(F.lit(0.0)).cast("bigint"))
    return ranked.where(F.array_contains(at, F.col("_rank") - 1)).drop("_rank", "_size")


def best_within(rows: DataFrame, keys: list[str], weight: str, gain: str, row: str, capacity_share: float) -> DataFrame:
    """0/1 knapsack per key: the rows of most gain whose weights fit *capacity_share* of the total.

    A sparse dynamic programme over distinct (weight, gain) states, dominated ones dropped, in one
    grouped Arrow function a key. Of sets with equal gain (to 1e-12) the one whose row numbers come
    first, compared from the first on, is taken.
    """
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        capacity = int(pdf["w"].sum() * capacity_share)
        # a state is (weight, gain, rows taken); it stays while no lighter or equal one is better
        states: list[tuple[int, float, tuple[int, ...]]] = [(0, 0.0, ())]
        for i, (w, g) in enumerate(zip(pdf["w"], pdf["g"], strict=True)):
            if g <= 0 or w > capacity:
                continue
            more = [(a + int(w), b + g, (*c, i)) for a, b, c in states if a + w <= capacity]
            kept: list[tuple[int, float, tuple[int, ...]]] = []
            for s in sorted(states + more, key=lambda s: (s[0], -s[1], s[2])):
                if not kept or s[1] > kept[-1][1] + 1e-12 or (s[1] > kept[-1][1] - 1e-12 and s[2] < kept[-1][2]):
                    kept.append(s)
            states = kept
        top = max(s[1] for s in states)
        chosen = min(s[2] for s in states if s[1] > top - 1e-12)
        return pdf.loc[list(chosen), ["id", "w", "g"]]

    ready = rows.select(*keys, F.col(row).cast("bigint").alias("id"), F.col(weight).cast("bigint").alias("w"), F.col(gain).cast("double").alias("g")).where("id IS NOT NULL AND w IS NOT NULL AND g IS NOT NULL AND w >= 0")
    return ready.groupBy(*keys).applyInPandas(solve, "id BIGINT, w BIGINT, g DOUBLE")


def count_curve(rows: DataFrame, keys: list[str], gain: str, order: str, percents: list[int], width: float) -> DataFrame:
    """Gain kept by the best *percent* of rows, per key and percent (rows rounded down)."""
    ranked = counted_rank(rows.withColumn("_loss", -F.col(gain)), keys, "_loss", [F.col(order)], width, "_rank")
    at = ranked.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    inside = F.col("_rank") <= F.floor(F.col("_size") * F.col("percent") / 100)
    return at.groupBy(*keys, "percent").agg(F.count(F.when(inside, 1)).alias("n_taken"), F.sum(F.when(inside, F.col(gain)).otherwise(0)).alias("gain"), F.sum(gain).alias("total"))


def first_best(arms: DataFrame, eligible: str, order: list, arm: str) -> DataFrame:
    """The best eligible arm by *order*, ties to the first arm; without one, arm 0 as fallback."""
    ranked = arms.withColumn("_e", F.expr(eligible)).where(F.col("_e") | (F.col(arm) == 0))
    best = ranked.agg(F.min_by(F.struct(*[c for c in ranked.columns]), F.struct((~F.col("_e")).alias("_0"), *[o.alias(f"_{k + 1}") for k, o in enumerate(order)], F.col(arm).alias("_z"))).alias("_b"))
    return best.where("_b IS NOT NULL").select("_b.*").withColumnRenamed("_e", "accepted")


def duplicate_risk(rows: DataFrame, keys: list[str], ref_chars: str | None = None, hyp_chars: str | None = None, width: int = 3_600_000_000) -> DataFrame:
    """Risk of duplicated and of lost text per key: n, duplicate_risk, deletion_risk, both within 0 and 1.

    Duplicate: the time that segments, by start and end, have in common with the next one, over the sum
    of their lengths. Deletion: missing characters over expected ones, where a segment has both counts.
    """
    counted = F.lit(False) if ref_chars is None else F.col(ref_chars).isNotNull() & F.col(hyp_chars).isNotNull()
    want, got = (F.lit(0), F.lit(0)) if ref_chars is None else (F.col(ref_chars), F.col(hyp_chars))
    near = scanned(rows.where("start_us IS NOT NULL AND end_us IS NOT NULL"), keys, "start_us", ["end_us"], width, lead={"_n": F.struct("start_us", "end_us")})
    shared = F.greatest(F.lit(0), F.least(F.col("end_us"), F.col("_n.end_us")) - F.greatest(F.col("start_us"), F.col("_n.start_us")))
    sums = near.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("_n").isNotNull(), shared).otherwise(0)).alias("_o"), F.sum(F.col("end_us") - F.col("start_us")).alias("_s"),
        F.sum(F.when(counted, F.greatest(F.lit(0), want - got)).otherwise(0)).alias("_m"), F.sum(F.when(counted, want).otherwise(0)).alias("_e"),
    )
    share = lambda a, b: F.round(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))), 9)
    return sums.select(*keys, "n", share("_o", "_s").alias("duplicate_risk"), share("_m", "_e").alias("deletion_risk"))
