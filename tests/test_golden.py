"""Small cases with known answers."""

from pyspark.sql import functions as F

from chronoloom.operators.intervals import corrected, points_inside, subtract, with_silence
from chronoloom.operators.scoring import attributed_words, f_scores
from chronoloom.operators.sequences import interleaving, isolated_runs, neighbour_consensus, speaker_turns, transition_costs
from chronoloom.operators.vectors import conformal_labels

SPANS = "recording STRING, row_id BIGINT, label STRING, start_us BIGINT, end_us BIGINT"


def spans(spark, *rows):
    return spark.createDataFrame([("r", i, *r) for i, r in enumerate(rows)], SPANS)


def test_correction_splits_unknown(spark):
    got = corrected(spans(spark, ("UNKNOWN", 0, 10), ("A", 10, 20)), spans(spark, ("H", 3, 5)), ["recording"])
    assert sorted(map(tuple, got.select("start_us", "end_us", "label").collect())) == [(0, 3, "UNKNOWN"), (3, 5, "H"), (5, 10, "UNKNOWN"), (10, 20, "A")]


def test_one_way_change_is_not_interleaved(spark):
    one = interleaving(spans(spark, ("A", 0, 1), ("A", 1, 2), ("B", 2, 3)), ["recording"], "label", "A", "B").first()
    two = interleaving(spans(spark, ("A", 0, 1), ("B", 1, 2), ("A", 2, 3)), ["recording"], "label", "A", "B").first()
    assert (one.forth, one.back, one.interleaved) == (True, False, False) and two.interleaved


def test_conformal_outcomes(spark):
    cal = spark.createDataFrame([("A", 0.1), ("A", 0.2), ("B", 0.1), ("B", 0.2)], "label STRING, score DOUBLE")
    cand = spark.createDataFrame([(1, "A", 0.1), (1, "B", 0.9), (2, "A", 0.9), (2, "B", 0.9), (3, "A", 0.1), (3, "B", 0.15)], "id BIGINT, label STRING, score DOUBLE")
    got = {r.id: r.outcome for r in conformal_labels(cal, cand, 1 / 3, 0.05).collect()}
    assert got == {1: "A", 2: "OUT_OF_DISTRIBUTION", 3: "AMBIGUOUS"}


def test_words(spark):
    words = spark.createDataFrame([("r", w, s, e, w) for w, s, e in (("a", 0, 10), ("b", 8, 18), ("c", 40, 50), ("d", 20, 30))], "recording STRING, word_id STRING, start_us BIGINT, end_us BIGINT, text STRING")
    got = attributed_words(words, spans(spark, ("A", 0, 12), ("B", 12, 25)), ["recording"])
    assert {r.word_id: r.word_label for r in got.collect()} == {"a": "A", "b": "UNKNOWN_BOUNDARY", "c": "UNKNOWN_WEAK", "d": "UNKNOWN_WEAK"}
    turns = speaker_turns(got.withColumn("word_label", F.lit("A")), ["recording"], gap_us=5, width=7)
    assert sorted((r.start_us, r.end_us, r.text) for r in turns.collect()) == [(0, 30, "a b d"), (40, 50, "c")]


def test_neighbours_runs_and_costs(spark):
    s = spans(spark, ("A", 0, 10), ("UNKNOWN", 10, 12), ("A", 12, 20), ("B", 20, 22), ("A", 22, 30), ("A", 30_000_000, 30_000_001))
    assert [r.row_id for r in neighbour_consensus(s, ["recording"], "label", "UNKNOWN", 5).collect()] == [1]
    assert {r.row_id for r in isolated_runs(s, ["recording"], "label", 5, "X").where("label = 'X'").collect()} == {1, 3}
    costs = {r.row_id: r.switch_cost for r in transition_costs(s, ["recording"]).collect()}
    assert costs[0] == 0.0 and costs[1] == 0.35 and costs[5] == 0.0


def test_scope_and_scores(spark):
    u = spans(spark, ("", 0, 10), ("", 20, 30))
    assert sorted(map(tuple, subtract(u, spans(spark, ("", 5, 25)), ["recording"]).select("start_us", "end_us").collect())) == [(0, 5), (25, 30)]
    p = spark.createDataFrame([("r", x) for x in (0, 9, 10, 25, 30)], "recording STRING, at BIGINT")
    assert sorted(r["at"] for r in points_inside(p, u, ["recording"], "at", 4).collect()) == [0, 9, 25]
    filled = with_silence(spans(spark, ("S", 2, 4)), spans(spark, ("", 0, 10)), ["recording"])
    assert sorted(map(tuple, filled.select("start_us", "end_us", "label").collect())) == [(0, 2, "NON_SPEECH"), (2, 4, "S"), (4, 10, "NON_SPEECH")]
    none = spark.range(1).select(*f_scores(F.lit(0), F.lit(0), F.lit(0))).first()
    assert tuple(none) == (1.0, 1.0, 1.0)
