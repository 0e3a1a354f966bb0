"""Rules of order and ties, and scans over hot groups against plain loops."""

import random
from itertools import combinations, permutations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.operators import scoring as S
from chronoloom.operators import selection as P
from chronoloom.operators import sequences as Q
from chronoloom.operators.blocked import counted_width, scanned, with_halo
from chronoloom.operators.evidence import change_points
from chronoloom.operators.intervals import label_runs, order_faults, padded
from chronoloom.operators.texts import cheapest_assignment

ROWS = "recording STRING, row_id BIGINT, label STRING, start_us BIGINT, end_us BIGINT"


def turns(spark, labels, size=100):
    return spark.createDataFrame([("r", i, x, i * size, i * size + size) for i, x in enumerate(labels)], ROWS)


def test_scans_of_a_hot_group(spark):
    """One key has nine tenths of the rows, blocks are narrow, starts have ties and keys are null."""
    rng = random.Random(1)
    rows = [(rng.choice(["a"] * 18 + ["b", None]), rng.randrange(300), i, rng.choice([None, 1, 2, 3, 4])) for i in range(400)]
    df = spark.createDataFrame(rows, "k STRING, t BIGINT, i BIGINT, v BIGINT")
    v, w, u = F.col("v"), Window.partitionBy("k").orderBy("t", "i"), Window.unboundedPreceding
    got = scanned(df, ["k"], "t", ["i"], 17, lag={"a": v}, lead={"b": v}, total={"c": v}, top={"d": v}, top_before={"e": v}, last={"f": v}, after={"g": v})
    want = df.select(
        "*", F.lag(v).over(w).alias("a"), F.lead(v).over(w).alias("b"), F.coalesce(F.sum(v).over(w.rowsBetween(u, 0)), F.lit(0)).alias("c"), F.max(v).over(w.rowsBetween(u, 0)).alias("d"),
        F.max(v).over(w.rowsBetween(u, -1)).alias("e"), F.last(v, True).over(w.rowsBetween(u, -1)).alias("f"), F.first(v, True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("g"),
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert scanned(df.limit(0), ["k"], "t", ["i"], 17, lag={"a": v}).count() == 0
    h, hw = with_halo(df, ["k"], "t", ["i"], 17, 5, 4, rows=10)
    assert sorted(map(str, h.withColumn("m", F.sum("v").over(hw.rowsBetween(-5, 4))).where("_own").select("i", "m").collect())) == sorted(map(str, df.select("i", F.sum("v").over(w.rowsBetween(-5, 4)).alias("m")).collect()))
    assert counted_width(df, ["k"], F.col("t"), 1000, most=100) <= 250 and counted_width(df, ["k"], F.col("t"), 1000) == 1000


def in_place(labels, most, size):
    out = list(labels)
    for i in range(1, len(out) - 1):
        if out[i] in ("A", "B") and out[i - 1] == out[i + 1] and out[i] != out[i - 1] and size <= most:
            out[i] = "UNKNOWN"
    return out


@pytest.mark.parametrize("width", [150, 3_600_000_000])
def test_isolated_runs_change_in_place(spark, width):
    rng = random.Random(9)
    cases = ["ABABA", "AABAA", "AUBUA", "AB", "A", "ABABABAB", "".join(rng.choice("ABU") for _ in range(60)), "AB" * 25]
    for case in cases:
        labels = ["UNKNOWN" if x == "U" else x for x in case]
        got = {r.row_id: r.label for r in Q.isolated_runs(turns(spark, labels), ["recording"], "label", 100, "UNKNOWN", ("A", "B"), width).collect()}
        assert [got[i] for i in range(len(labels))] == in_place(labels, 100, 100), case


def test_decoder_prefers_unknown_then_the_smaller_label(spark):
    df = spark.createDataFrame([("r", 0, 0, 10, 0.0, 0.0, 0.0), ("r", 1, 10, 20, 0.0, 9.0, 0.0)], "recording STRING, row_id BIGINT, start_us BIGINT, end_us BIGINT, switch_cost DOUBLE, u DOUBLE, a DOUBLE")
    got = {r.row_id: r.label for r in Q.decoded_labels(df, ["recording"], {"A": F.col("a"), "UNKNOWN": F.col("u")}).collect()}
    assert got == {0: "UNKNOWN", 1: "A"}
    tie = df.select("recording", "row_id", "start_us", "end_us", "switch_cost")
    got = {r.row_id: r.label for r in Q.decoded_labels(tie, ["recording"], {"B": F.lit(0.5), "A": F.lit(0.5)}).collect()}
    assert got == {0: "A", 1: "A"}


def test_transitions_between_labels(spark):
    rows = [("A", "A", 0, None), ("A", "B", 0, None), ("A", "B", 0, 1.0), ("A", "UNKNOWN", 0, None), ("A", "B", 1_500_000, None), ("A", "B", 750_000, 0.5)]
    df = spark.createDataFrame(rows, "p STRING, c STRING, gap BIGINT, scd DOUBLE")
    got = [r.x for r in df.select(F.round(Q.label_transition(F.col("p"), F.col("c"), F.col("gap"), F.col("scd")), 9).alias("x")).collect()]
    assert got == [0.0, 0.35, 0.15, 0.12, 0.0, 0.2]


def test_knapsack_takes_the_first_of_equal_sets(spark):
    rng = random.Random(8)
    for _ in range(4):
        rows = [("k", i, rng.randrange(1, 6), float(rng.randrange(1, 4))) for i in range(8)]
        capacity = int(sum(r[2] for r in rows) * 0.5)
        sets = [c for n in range(9) for c in combinations(range(8), n) if sum(rows[i][2] for i in c) <= capacity]
        best = max(sum(rows[i][3] for i in c) for c in sets)
        want = min(c for c in sets if sum(rows[i][3] for i in c) == best)
        got = P.best_within(spark.createDataFrame(rows, "k STRING, id BIGINT, w BIGINT, g DOUBLE"), ["k"], "w", "g", "id", 0.5)
        assert tuple(sorted(r.id for r in got.collect())) == want


def test_assignment_of_any_number():
    rng = random.Random(2)
    for n in range(1, 7):
        cost = [[rng.randrange(20) for _ in range(n)] for _ in range(n)]
        assert cheapest_assignment(cost) == min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(n)))
    assert cheapest_assignment([]) == 0
    assert cheapest_assignment([[0 if (i + 3) % 40 == j else 1 for j in range(40)] for i in range(40)]) == 0


def test_third_label_is_reported_and_not_scored(spark):
    spans = lambda rows: spark.createDataFrame(rows, "recording STRING, label STRING, start_us BIGINT, end_us BIGINT")
    ref = spans([("a", "REF_00", 0, 10), ("b", "REF_00", 0, 10), ("b", "REF_02", 10, 20)])
    hyp = spans([("a", "A", 0, 10), ("a", "UNKNOWN", 10, 12), ("c", "C", 0, 5)])
    scope = spans([("a", "", 0, 20), ("b", "", 0, 20), ("c", "", 0, 20)])
    assert sorted(map(tuple, S.label_faults(ref, hyp, ["recording"]).collect())) == [("b", "reference", "REF_02", 1), ("c", "hypothesis", "C", 1)]
    assert {r.recording for r in S.two_label_cells(ref, hyp, scope, ["recording"]).collect()} == {"a"}


def test_longest_speech(spark):
    rows = [("r", i * 100, i * 100 + 100, 0.9 if i < 10 else 0.0) for i in range(30)]
    df = spark.createDataFrame(rows, "recording STRING, start_us BIGINT, end_us BIGINT, p DOUBLE")
    got = sorted((r.start_us, r.end_us) for r in Q.hysteresis_regions(df, ["recording"], min_silence_us=300, most_us=400).collect())
    assert got == [(0, 400), (400, 800), (800, 1000)]


def test_changes_inside_a_scope(spark):
    df = turns(spark, "ABAB")
    scope = spark.createDataFrame([("r", 150, 250)], "recording STRING, start_us BIGINT, end_us BIGINT")
    assert sorted(r.at_us for r in change_points(df, ["recording"]).collect()) == [100, 200, 300]
    assert [r.at_us for r in change_points(df, ["recording"], scope=scope).collect()] == [200]


def test_risks(spark):
    df = spark.createDataFrame([("r", 0, 100, 10, 7), ("r", 50, 150, 10, 12), ("r", 150, 200, 5, None), ("e", None, 5, 1, 1)], "recording STRING, start_us BIGINT, end_us BIGINT, c BIGINT, h BIGINT")
    assert [tuple(r) for r in P.duplicate_risk(df, ["recording"], "c", "h").collect()] == [("r", 3, 0.2, 0.15)]


def test_narrow_blocks_change_nothing(spark):
    rng = random.Random(5)
    rows = [(rng.choice("aaaaaaaab"), i, rng.choice("AB"), s := rng.randrange(5000), s + rng.randrange(1, 60)) for i in range(300)]
    df = spark.createDataFrame(rows, ROWS)
    for f in (
        lambda w: label_runs(df, ["recording"], width=w), lambda w: order_faults(df, ["recording"], width=w), lambda w: Q.transition_costs(df, ["recording"], width=w),
        lambda w: Q.neighbour_consensus(df, ["recording"], "label", "B", 100, width=w), lambda w: Q.interleaving(df, ["recording"], "label", "A", "B", width=w),
        lambda w: padded(df.groupBy("recording", "start_us").agg(F.max("end_us").alias("end_us")), ["recording"], 7, F.lit(0), F.lit(9999), width=w),
        lambda w: change_points(df, ["recording"], width=w), lambda w: Q.separated_peaks(df.withColumn("s", F.col("row_id") % 7), ["recording"], "s", 3, 40, width=w),
    ):
        assert sorted(map(str, f(50).collect())) == sorted(map(str, f(3_600_000_000).collect()))
