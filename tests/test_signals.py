import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators.hypotheses import cluster_decisions, rescued
from chronoloom.operators.signals import counter_random, log_mel, mapped_points, resampled, uniform_noise, with_noise
from chronoloom.operators.texts import assigned_word_errors
from chronoloom.sources.strict import corpus_turns, json_issue, json_issues


def test_counter_random():
    assert [hex(int(x)) for x in counter_random(0, 0, 2)] == ["0xe220a8397b1dcdaf", "0x6e789e6aa1b965f4"]
    assert (counter_random(5, 3, 4) == counter_random(5, 0, 7)[3:]).all()
    assert -1 <= uniform_noise(1, 0, 1000).min() and abs(uniform_noise(1, 0, 100_000).mean()) < 0.01


def test_resample_and_noise(spark):
    df = spark.createDataFrame([("r", 0, [0.0, 1.0, 0.0, -1.0] * 50, 8000), ("r", 200, [0.0, 1.0, 0.0, -1.0] * 50, 8000), ("e", 0, [], 8000)], "id STRING, first_frame BIGINT, samples ARRAY<FLOAT>, rate INT")
    up = df.where("first_frame = 0 AND id = 'r'").select(resampled(F.col("samples"), F.col("rate"), 16000).alias("s")).first().s
    assert len(up) == 400 and up[:4] == [0.0, 0.5, 1.0, 0.5]
    noisy = {(r.id, r.first_frame): np.array(r.samples) for r in with_noise(df, 20, 9, ["id"]).collect()}
    diff = np.r_[noisy["r", 0], noisy["r", 200]] - np.array([0.0, 1.0, 0.0, -1.0] * 100)
    inner = diff[::2]  # zeros are never clipped
    assert 20 == pytest.approx(10 * np.log10(0.5 / (inner**2).mean()), abs=1)


def test_log_mel(spark):
    tone = np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)
    x = np.r_[tone[:8000], 0.001 * tone[8000:]].tolist()
    m = np.array(spark.createDataFrame([(x,)], "s ARRAY<FLOAT>").select(log_mel(F.col("s")).alias("m")).first().m)
    assert m.shape == (98, 80) and abs(m.mean(axis=0)).max() < 1e-4
    assert m[:40].mean() > m[60:].mean()


def test_mapped_points(spark):
    seg = spark.createDataFrame([("r", 0, 10, 0, 1000), ("r", 10, 20, 5000, 5500), ("r", 30, 40, 9000, 9001)], "recording STRING, view_start BIGINT, view_end BIGINT, source_start BIGINT, source_end BIGINT")
    pts = spark.createDataFrame([("r", x) for x in (-1, 0, 5, 10, 11, 20, 25, 35, 41)], "recording STRING, at BIGINT")
    got = {r["at"]: r.source_us for r in mapped_points(pts, seg, ["recording"], "at").collect()}
    assert got == {0: 0, 5: 500, 10: 1000, 11: 5050, 20: 5500, 35: 9001}


def test_decisions(spark):
    rng = random.Random(1)
    near = lambda c: [c[0] + rng.gauss(0, 0.05), c[1] + rng.gauss(0, 0.05), rng.gauss(0, 0.05)]
    rows = [("two", i, near((1, 0) if i % 2 else (0, 1)), 1.0, i // 4) for i in range(24)] + [("one", i, near((1, 1)), 1.0, i // 4) for i in range(24)] + [("few", i, near((1, 0)), 1.0, 0) for i in range(3)]
    df = spark.createDataFrame(rows, "rec STRING, id BIGINT, v ARRAY<DOUBLE>, w DOUBLE, b INT")
    got = {r.rec: r.decision for r in cluster_decisions(df, ["rec"], "v", "w", "b", "id").collect()}
    assert got["two"] == "TWO" and got["one"] != "TWO" and got["few"] == "UNDECIDED"


def test_rescued(spark):
    p = spark.createDataFrame([(1, "a", 0.9, 0.8), (2, "b", 0.6, 0.2), (3, "a", 1.0, 1.0)], "id BIGINT, label STRING, score DOUBLE, margin DOUBLE")
    u = spark.createDataFrame([(1,), (2,), (9,)], "id BIGINT")
    assert {r.id: r.label for r in rescued(p, u).collect()} == {1: "a", 2: "UNKNOWN", 9: "UNKNOWN"}


def test_strict_json(spark):
    cases = {'{"a": 1, "a": 2}': "DUPLICATE_KEY", "[NaN]": "NOT_FINITE", "[1": "UNREADABLE", "[" * 40 + "]" * 40: "TOO_DEEP", '{"a": [1, {"b": null}]}': None, "": "UNREADABLE"}
    assert {t: json_issue(t, 32, 100) for t in cases} == cases
    assert json_issue(json.dumps(list(range(200))), 32, 100) == "TOO_LARGE"
    df = spark.createDataFrame(list(enumerate([*cases, None])), "row_id BIGINT, t STRING")
    assert [r.issue for r in json_issues(df, "row_id", "t", nodes=100).orderBy("row_id").collect()] == [*[x for x in cases.values() if x], "MISSING"]


def test_corpus(spark):
    doc = {"document": [{"id": "d1", "utterance": [{"speaker_id": "x", "start": "1.5", "end": "2.000001"}, {"speaker_id": "y", "start": "2", "end": "3"}, {"speaker_id": "x", "start": "0.0000001", "end": "9"}, {"speaker_id": None, "start": "1", "end": "2"}]}]}
    df = spark.createDataFrame([(json.dumps(doc),), ("{}",), (None,)], "t STRING")
    assert sorted(map(tuple, corpus_turns(df, "t").collect())) == [("d1", "SPEAKER_00", 1_500_000, 2_000_001), ("d1", "SPEAKER_01", 2_000_000, 3_000_000)]


def test_assigned_word_errors(spark):
    df = spark.createDataFrame([(1, ["a b c", "d e"], ["d e", "a b x"]), (2, ["a"], []), (3, [], [])], "id BIGINT, refs ARRAY<STRING>, hyps ARRAY<STRING>")
    got = {r.id: (r.errors, r.ref_words, r.rate) for r in assigned_word_errors(df, "refs", "hyps").collect()}
    assert got == {1: (1, 5, 0.2), 2: (1, 1, 1.0), 3: (0, 0, 0.0)}
