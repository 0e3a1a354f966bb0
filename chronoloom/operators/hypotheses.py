"""One cluster or two: costs, stability under leaving blocks out, and the decision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-300)


def fit_two(x: np.ndarray, weight: np.ndarray, rounds: int = 30, cap: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """Spherical two-means from several starts: labels, centres and the weighted, capped cost.

    Starts pair the heaviest vectors, and those spread over the order of rows, with their farthest
    partner; the cheapest fit wins, ties the earlier start.
    """
    heavy = np.argsort(-weight, kind="stable")[:3]
    spread = np.linspace(0, len(x) - 1, 3).round().astype(int)
    best: tuple[np.ndarray, np.ndarray, float] | None = None
    for a in dict.fromkeys([*heavy.tolist(), *spread.tolist()]):
        centres = x[[a, int((x @ x[a]).argmin())]].copy()
        own = None
        for _ in range(rounds):
            after = (x @ centres.T).argmax(axis=1)
            if own is not None and (after == own).all():
                break
            own = after
            for c in (0, 1):
                if (own == c).any():
                    centres[c] = _unit((weight[own == c, None] * x[own == c]).sum(axis=0))
        cost = float((weight * np.minimum(cap, 1 - (x * centres[own]).sum(axis=1))).sum() / weight.sum())
        if best is None or cost < best[2] - 1e-12:
            best = own, centres, cost
    return best


def cluster_decisions(rows: DataFrame, keys: list[str], vector: str, weight: str, block: str, row: str, least_gain: float = 0.5, least_stability: float = 0.9) -> DataFrame:
    """Per key ONE, TWO or UNDECIDED, with the costs of both fits and the stability of two.

    Two clusters need a cost lower by *least_gain* of the one-cluster cost and labels that agree, in
    the median over refits without one block, with *least_stability* of the rows (labels may be
    swapped). Fewer than four rows are UNDECIDED. One grouped Arrow function a recording.
    """
    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_id")
        head = {k: pdf[k].iloc[0] for k in keys}
        x, w, blocks = _unit(np.stack(pdf["_v"].to_numpy())), pdf["_w"].to_numpy(float), pdf["_b"].to_numpy()
        one = _unit((w[:, None] * x).sum(axis=0))
        cost1 = float((w * (1 - x @ one)).sum() / w.sum())
        if len(x) < 4:
            return pd.DataFrame([head | {"n": len(x), "cost_one": cost1, "cost_two": None, "stability": None, "decision": "UNDECIDED"}])
        own, _, cost2 = fit_two(x, w)
        agree = []
        for b in pd.unique(blocks):
            rest = blocks != b
            if rest.sum() >= 4:
                _, centres, _ = fit_two(x[rest], w[rest])
                again = (x @ centres.T).argmax(axis=1)
                share = float((again == own).mean())
                agree.append(max(share, 1 - share))
        stable = float(np.median(agree)) if agree else 0.0
        gain = (cost1 - cost2) / max(cost1, 1e-12)
        decision = "TWO" if gain >= least_gain and stable >= least_stability else "ONE" if gain < least_gain / 2 else "UNDECIDED"
        return pd.DataFrame([head | {"n": len(x), "cost_one": cost1, "cost_two": cost2, "stability": stable, "decision": decision}])

    ready = rows.select(*keys, F.col(vector).cast("array<double>").alias("_v"), F.col(weight).cast("double").alias("_w"), F.col(block).alias("_b"), F.col(row).alias("_id")).where("_v IS NOT NULL AND _w > 0")
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return ready.groupBy(*keys).applyInPandas(decide, f"{kinds}, n BIGINT, cost_one DOUBLE, cost_two DOUBLE, stability DOUBLE, decision STRING")


def rescued(propagated: DataFrame, unknown: DataFrame, least_score: float = 0.8, least_margin: float = 0.3) -> DataFrame:
    """Labels for unknown rows alone, where propagation is sure enough; all others stay unknown."""
    sure = propagated.where((F.col("score") >= least_score) & (F.col("margin") >= least_margin)).select("id", "label")
    return unknown.select("id").join(sure, "id", "left").select("id", F.coalesce(F.col("label").cast("string"), F.lit("UNKNOWN")).alias("label"))
