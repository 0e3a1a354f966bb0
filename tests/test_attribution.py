"""Attribution, local decisions and audits on cases with known answers."""

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import attribution as A
from chronoloom.operators import audits as U
from chronoloom.operators.sequences import speaker_turns

SPAN = "recording STRING, row_id BIGINT, label STRING, start_us BIGINT, end_us BIGINT"
WORD = "recording STRING, word_id STRING, start_us BIGINT, end_us BIGINT, text STRING, crosses BOOLEAN"


def test_words_find_their_speaker_or_why_not(spark):
    spans = [("r", 1, "A", 0, 100), ("r", 2, "B", 100, 200), ("r", 3, "UNKNOWN", 200, 300), ("r", 4, "OVERLAP", 300, 310), ("r", 5, "OTHER", 400, 500), ("r", 6, None, 600, 700), ("r", 7, "B", 375, 400)]
    words = [
        ("in", 10, 90, False), ("half", 50, 150, False), ("mostly", 30, 113, False), ("edge", 120, 225, False), ("none", 210, 290, False), ("over", 305, 330, False),
        ("other", 410, 420, False), ("null", 610, 620, False), ("seam", 10, 20, True), ("bad", 20, 20, False), ("lost", None, 5, None), ("far", 900, 950, False), ("unknown", 176, 206, False),
    ]
    df = spark.createDataFrame([("r", w, s, e, "t", c) for w, s, e, c in words], WORD)
    got = {r.word_id: (r.speaker, r.status, r.evidence) for r in A.mapped_words(df, spark.createDataFrame(spans, SPAN), ["recording"], crosses="crosses").collect()}
    unknown = ("UNKNOWN", "UNKNOWN_INSUFFICIENT_EVIDENCE")
    assert got == {
        "in": ("A", "ASSIGNED", [1]), "half": ("UNKNOWN", "UNKNOWN_BOUNDARY", [1, 2]), "mostly": ("A", "ASSIGNED", [1, 2]), "edge": (*unknown, [2, 3]), "none": (*unknown, [3]),
        "over": ("OVERLAP", "OVERLAP_UNATTRIBUTED", [4]), "other": ("OTHER", "OTHER", [5]), "null": (*unknown, []), "seam": ("UNKNOWN", "UNKNOWN_TIMEWARP_BOUNDARY", [1]), "bad": ("UNKNOWN", "UNKNOWN_TIMEWARP_BOUNDARY", []),
        "lost": ("UNKNOWN", "UNKNOWN_TIMEWARP_BOUNDARY", []), "far": (*unknown, []), "unknown": ("B", "ASSIGNED", [2, 3]),
    }
    assert A.mapped_words(df.where("false"), spark.createDataFrame(spans, SPAN), ["recording"]).count() == 0
    assert {r.status for r in A.mapped_words(df.where("word_id = 'in'"), spark.createDataFrame([], SPAN), ["recording"]).collect()} == {"UNKNOWN_INSUFFICIENT_EVIDENCE"}
    neutral = {r.word_id: (r.speaker, r.status, r.evidence) for r in A.neutral_words(A.mapped_words(df, spark.createDataFrame(spans, SPAN), ["recording"])).collect()}
    assert neutral["in"] == ("UNKNOWN", "SPEAKER_NEUTRAL", []) and neutral["over"] == got["over"] and neutral["none"] == got["none"]


@pytest.mark.parametrize("width", [40, 3_600_000_000])
def test_turns_end_where_the_evidence_changes(spark, width):
    rows = [("r", f"w{i}", i * 30, i * 30 + 20, f"t{i}", x, y) for i, (x, y) in enumerate([("A", "1"), ("A", "1"), ("A", "2"), ("B", "2"), (None, "2"), (None, "2"), ("A", "1")])]
    df = spark.createDataFrame(rows, "recording STRING, word_id STRING, start_us BIGINT, end_us BIGINT, text STRING, speaker STRING, evidence STRING")
    got = sorted((r.turn, r.label, r.text) for r in speaker_turns(df, ["recording"], "speaker", gap_us=15, width=width, same=("evidence",)).collect())
    assert got == [(1, "A", "t0 t1"), (2, "A", "t2"), (3, "B", "t3"), (4, None, "t4 t5"), (5, "A", "t6")]
    assert speaker_turns(df, ["recording"], "speaker", gap_us=9, width=width).count() == 7


def test_local_gates(spark):
    rows = [
        (1, "ANCHOR", False, False, True, True, 0.2, 0.5), (2, "ANCHOR", False, False, True, True, 0.2, 0.22), (3, "MICRO", False, False, True, True, 0.28, 0.9), (4, "MICRO", False, False, True, True, 0.1, 0.9),
        (5, "SUPPORT", True, True, True, True, 0.1, 0.9), (6, "SUPPORT", False, False, True, False, 0.1, 0.9), (7, "SUPPORT", False, True, True, True, 0.1, 0.9), (8, "SUPPORT", False, False, True, True, None, None), (9, "SUPPORT", False, False, True, True, None, 0.3), (10, "ANCHOR", False, False, True, True, 0.5, 0.51),
    ]
    df = spark.createDataFrame(rows, "id INT, kind STRING, overlap BOOLEAN, mixed BOOLEAN, valid BOOLEAN, confirmed BOOLEAN, d0 DOUBLE, d1 DOUBLE")
    pairs = {"A": ("d0", "d0"), "B": ("d1", "d1")}
    got = {r.id: (r.speaker, r.status, r.reason) for r in A.local_decisions(df, pairs).collect()}
    weak = "UNKNOWN_INSUFFICIENT_EVIDENCE"
    assert got == {
        1: ("A", "LOCAL_CANDIDATE", "LOCAL_CANDIDATE"), 2: ("UNKNOWN", weak, "LOCAL_GATE_MARGIN"), 3: ("UNKNOWN", "UNKNOWN_SHORT", "LOCAL_GATE_STABLE_DISTANCE"), 4: ("A", "CANDIDATE_SPEAKER", "LOCAL_CANDIDATE"),
        5: ("OVERLAP", "OVERLAP", "PROTECTED_OVERLAP"), 6: ("UNKNOWN", weak, "HYPOTHESIS_UNCONFIRMED"), 7: ("UNKNOWN", weak, "MIXED_OR_INVALID_EMBEDDING"), 8: ("UNKNOWN", weak, "NO_SPEAKER_STATE"),
        9: ("B", "LOCAL_CANDIDATE", "LOCAL_CANDIDATE"), 10: ("UNKNOWN", weak, "LOCAL_GATE_STABLE_DISTANCE+ABSOLUTE_DISTANCE+MARGIN"),
    }
    costs = {r.id: r.emissions for r in A.emission_costs(A.local_decisions(df, pairs), ("A", "B")).collect()}
    assert costs[1] == {"A": 0.2, "UNKNOWN": 0.4} and costs[4] == {"A": 0.1, "UNKNOWN": 0.02} and costs[5] == {"UNKNOWN": 0.4, "OVERLAP": 0.0}
    soft = {r.id: r.emissions for r in A.soft_emissions(df, pairs).collect()}
    assert soft[2] == {"A": 0.2, "B": 0.22} and soft[3] == {} and soft[5] == {} and soft[9] == {"B": 0.3}
    near = spark.createDataFrame([(0.3, 0.1), (0.3, None), (0.3, 0.9)], "s DOUBLE, r DOUBLE").select(F.round(A.effective_distance(F.col("s"), F.col("r")), 9)).collect()
    assert [r[0] for r in near] == [0.284, 0.3, 0.3]


def test_stability(spark):
    spans = lambda rows: spark.createDataFrame(rows, "recording STRING, label STRING, start_us BIGINT, end_us BIGINT")
    base = spans([("r", "X", 0, 100), ("r", "Y", 100, 200), ("r", "UNKNOWN", 200, 250), ("s", "UNKNOWN", 0, 10), ("t", "X", 0, 10)])
    swapped = spans([("r", "Y", 0, 100), ("r", "X", 100, 180), ("r", "UNKNOWN", 180, 250), ("s", "A", 0, 10)]).withColumn("variant", F.lit("v"))
    got = {r.recording: r for r in U.stability_metrics(base.withColumn("mid", F.col("start_us") == 100), swapped, ["recording"], central="mid", tolerance_us=5).collect()}
    r = got["r"]
    assert (r.co_assigned_agreement, r.speaker_flip_rate, r.attribution_retention, r.unknown_delta, r.speech_iou, r.central_agreement) == (1.0, 0.1, 0.9, 0.08, 0.9, 0.8)
    assert r.boundary_f1 == pytest.approx(2 / 4)
    assert got["s"].co_assigned_agreement is None and got["s"].speaker_flip_rate is None and got["s"].speech_iou == 0.0 and set(got) == {"r", "s"}


def test_event_matching_takes_the_nearest(spark):
    at = lambda xs: spark.createDataFrame([("r", x) for x in xs], "recording STRING, at BIGINT")
    got = U.matched_events(at([100, 110, 500, None]), at([105, 107, 900]), ["recording"], "at", 20).first()
    assert (got.n_reference, got.n_candidate, got.n_matched) == (3, 3, 2) and got.p95_error_us == pytest.approx(4.9)


def test_quality_ladder(spark):
    names = "unknown_ratio DOUBLE, overlap_ratio DOUBLE, out_of_profile BOOLEAN, ambiguous BOOLEAN, calibration_reasons ARRAY<STRING>, review_reasons ARRAY<STRING>, crossing BOOLEAN, unattributed_overlap BOOLEAN, all_high BOOLEAN, evaluated_overlap BOOLEAN"
    rows = [(0.0, 0.0, False, False, [], [], False, False, True, True), (0.0, 0.0, False, False, [], [], False, False, True, False), (0.3, 0.2, None, None, None, None, None, None, None, None), (0.0, 0.0, False, True, [], ["X"], True, False, True, True), (0.0, 0.0, False, True, ["C"], ["X"], True, False, True, True), (float("nan"), 0.0, True, True, ["C"], [], False, False, False, False)]
    got = [(r.status, r.mode, r.reasons) for r in U.file_quality(spark.createDataFrame(rows, names)).collect()]
    assert got == [
        ("PASS_HIGH", "SPEAKER_AWARE", []), ("PASS_STANDARD", "SPEAKER_AWARE", []), ("PASS_WITH_UNATTRIBUTED", "SPEAKER_NEUTRAL", ["Q_HIGH_UNKNOWN_RATIO", "Q_HIGH_OVERLAP_RATIO"]),
        ("REVIEW_REQUIRED", "MANUAL_REVIEW", ["X", "Q_H1_H2_AMBIGUOUS"]), ("REVIEW_REQUIRED", "MANUAL_REVIEW", ["C", "X"]), ("UNSUPPORTED", "SPEAKER_NEUTRAL", ["Q_INVALID_METRIC"]),
    ]


def test_window_energies_of_short_and_long(spark):
    df = spark.createDataFrame([("a", i, i - 3) for i in range(7)] + [("b", 0, 5)], "recording STRING, k BIGINT, x BIGINT")
    want = {("a", 4, s): sum((i - 3) ** 2 for i in range(s, s + 4)) / 4 for s in (0, 2, 3)} | {("b", 4, 0): 25.0}
    for rows in (2, 100_000):
        assert {(r.recording, r["size"], r.start): r.energy for r in U.window_energies(df, ["recording"], [4], 2, rows).collect()} == want
