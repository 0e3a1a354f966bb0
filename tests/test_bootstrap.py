import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import scoring as S

K = ["recording"]
SPANS = "recording STRING, label STRING, start_us BIGINT, end_us BIGINT"


def quantile(values, p):
    v = sorted(values)
    at = (len(v) - 1) * p
    low = int(at)
    return v[low] * (1 - at + low) + v[min(low + 1, len(v) - 1)] * (at - low)


def drawn(n, iterations=2000, seed=17029):
    return [[int.from_bytes(sha256(f"{seed}:{i}:{j}:{n}".encode()).digest()[:8], "big") % n for j in range(n)] for i in range(iterations)]


def test_draws_and_bounds(spark):
    rng = random.Random(8)
    rows = sorted((f"r{rng.randrange(10**6)}", rng.randrange(50), rng.randrange(1, 90), rng.random() if rng.random() < 0.4 else None) for _ in range(7))
    df = spark.createDataFrame(rows[::-1], "recording STRING, e BIGINT, r BIGINT, v DOUBLE")
    got = {r.metric: r for r in S.bootstrap_suite(df, {"pooled": S._share(F.col("e"), F.col("r")), "worst": F.min("v"), "never": F.min(F.lit(None))}).collect()}
    samples = [[rows[k] for k in ks] for ks in drawn(7)]
    pooled = [sum(x[1] for x in s) / sum(x[2] for x in s) for s in samples]
    worst = [min(x[3] for x in s if x[3] is not None) for s in samples if any(x[3] is not None for x in s)]
    assert set(got) == {"pooled", "worst"} and got["pooled"].iterations == 2000 and got["worst"].iterations == len(worst) and got["pooled"].seed == 17029
    for m, v in (("pooled", pooled), ("worst", worst)):
        assert (got[m].lower, got[m].upper) == pytest.approx((quantile(v, 0.025), quantile(v, 0.975)), abs=2e-9)
    assert got["pooled"].point == pytest.approx(sum(x[1] for x in rows) / sum(x[2] for x in rows), abs=1e-9)


def draws_join(made):
    """The line of the plan that joins draws and recordings."""
    plan = made._jdf.queryExecution().sparkPlan().toString().split("\n")
    (found,) = [x for x in plan if re.search(r"Join \[_[bk]#", x)]
    return found


def test_packed_draws(spark, monkeypatch):
    """Beyond what is broadcast, recordings meet their draws block by block, and draws are not broadcast."""
    for name, most in (("MOST_BROADCAST", 10), ("BLOCK_ROWS", 8), ("DRAWN", 20)):
        monkeypatch.setattr(S, name, most, raising=False)
    rng = random.Random(3)
    rows = [(f"r{k:02}", rng.randrange(50), rng.random() if k % 3 else None) for k in range(53)]
    df = spark.createDataFrame(rng.sample(rows, 53), "recording STRING, e BIGINT, v DOUBLE")
    made = S.bootstrap_suite(df, {"mean": F.avg("e"), "least": F.min("v"), "known": F.count("v")}, 200)
    got = {r.metric: r for r in made.collect()}
    assert "ShuffledHashJoin" in draws_join(made) and "BuildRight" in draws_join(made)
    samples = [[rows[k] for k in ks] for ks in drawn(53, 200)]
    expected = {"mean": [sum(x[1] for x in s) / 53 for s in samples], "least": [min(x[2] for x in s if x[2] is not None) for s in samples], "known": [sum(x[2] is not None for x in s) for s in samples]}
    assert set(got) == set(expected)
    for m, v in expected.items():
        assert (got[m].lower, got[m].upper, got[m].iterations) == pytest.approx((quantile(v, 0.025), quantile(v, 0.975), 200), abs=2e-9)


def changes(turns):
    out = set()
    for at in {s for _, s, _ in turns}:
        earlier = [t for t in turns if t[1] < at]
        there = {x for x, _, e in earlier if e >= at} or {x for x, _, e in earlier if e == max(t[2] for t in earlier)}
        if there and {x for x, s, _ in turns if s == at} - there:
            out.add(at)
    return out


def test_change_boundaries(spark):
    rng = random.Random(9)
    rows = [(str(k), rng.choice("AB"), s, s + rng.randrange(1, 12)) for k in range(30) for s in (rng.randrange(80) for _ in range(rng.randrange(1, 15)))]
    got = {(r.recording, r["at"]) for r in S.change_boundaries(spark.createDataFrame(rows, SPANS), K, ("A", "B")).collect()}
    assert got == {(k, at) for k in {r[0] for r in rows} for at in changes([r[1:] for r in rows if r[0] == k])}


def test_suite_of_three_recordings(spark):
    s = 1_000_000
    mk = lambda *rows: spark.createDataFrame(rows, SPANS)
    # a: two speakers, one found; b: one speaker, two found; c: two speakers, 2 s of them at once, both found but swapped
    ref = mk(("a", "REF_00", 0, 4 * s), ("a", "REF_01", 4 * s, 8 * s), ("b", "REF_00", 0, 10 * s), ("c", "REF_00", 0, 6 * s), ("c", "REF_01", 4 * s, 10 * s))
    hyp = mk(("a", "A", 0, 8 * s), ("b", "A", 0, 7 * s), ("b", "B", 7 * s, 10 * s), ("c", "B", 0, 6 * s), ("c", "A", 5 * s, 10 * s))
    scope = mk(*[(x, "", 0, 10 * s) for x in "abc"])
    sums = S.cell_sums(S.two_label_cells(ref, hyp, scope, K), K)
    found = S.boundary_matches(S.change_boundaries(ref, K, S.REF), S.change_boundaries(hyp, K, S.HYP), K, "at", 500_000)
    words = spark.createDataFrame([("a", "REF_00", "A"), ("a", "REF_01", "A"), ("a", "REF_01", "UNKNOWN_WEAK"), ("c", "REF_00", "B")], "recording STRING, label STRING, word_label STRING")
    got = {r.metric: r.point for r in S.scoring_suite(S.suite_rows(sums, found, words, K), 20).collect()}
    expected = {
        "der_all": (4 + 3 + 1) / (8 + 10 + 12), "der_nonoverlap": (4 + 3) / (8 + 10 + 8), "jer": ((0.5 + 1) / 2 + 0.3 + (0 + 1 / 6) / 2) / 3,
        "acoustic_complete_merge_rate": 0.5, "unsafe_complete_merge_rate": 0, "false_h2_rate": 1, "false_h2_duration_ratio": 0.3,
        "worst_speaker_coverage": 1, "worst_speaker_assigned_accuracy": 0, "scd_f1": 0, "overlap_precision": 1, "overlap_recall": 0.5,
        "word_attribution_precision": 2 / 3, "word_attribution_coverage": 3 / 4,
    }
    assert got == pytest.approx(expected, abs=2e-9)


def test_suite_is_the_same_packed_and_broadcast(spark, monkeypatch):
    rng = random.Random(12)
    count = ("ref_us", "error_us", "n_ref_us", "n_error_us", "split_us", "h1_us", "b_tp", "b_fp", "b_fn", "w_all", "w_given", "w_right")
    maybe, flags = ("coverage", "accuracy", "o_tp", "o_fp", "o_fn"), ("h1", "h2", "merged", "split")
    rows = [(f"r{k}", rng.random(), *[rng.randrange(1, 99) for _ in count], *[rng.randrange(9) if rng.random() < 0.7 else None for _ in maybe], *[rng.random() < 0.5 for _ in flags]) for k in range(40)]
    kinds = ", ".join(["recording STRING, jer DOUBLE", *[f"{c} BIGINT" for c in (*count, *maybe)], *[f"{c} BOOLEAN" for c in flags]])
    df = spark.createDataFrame(rows, kinds)
    one = S.scoring_suite(df, 100)
    assert "BroadcastHashJoin" in draws_join(one)
    for name, most in (("MOST_BROADCAST", 10), ("BLOCK_ROWS", 16), ("DRAWN", 30)):
        monkeypatch.setattr(S, name, most, raising=False)
    other = S.scoring_suite(df, 100)
    assert "ShuffledHashJoin" in draws_join(other) and "BuildRight" in draws_join(other)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect())) and one.count() == 14
