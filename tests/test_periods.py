import random

import numpy as np

from chronoloom.operators import periods
from chronoloom.operators.periods import complement, continuous_periods, merge_sorted, periods_and_gaps


def union(rows):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
            out[-1][2] += 1
        else:
            out.append([s, e, 1])
    return [tuple(x) for x in out]


def good(rows):
    return [(s, e) for s, e in rows if s is not None and e is not None and e > s]


def brute(turns, scope):
    out = []
    keys = {(f, c) for f, c, *_ in turns} | {(f, c) for f, c, *_ in scope}
    for f, c in keys:
        for sp in {t[2] for t in turns if t[:2] == (f, c)} - {None}:
            out += [("period", f, c, sp, *p) for p in union(good([t[3:] for t in turns if t[:3] == (f, c, sp)]))]
        cover = union(good([t[3:] for t in turns if t[:2] == (f, c) and t[2] is not None]))
        for s, e, _ in union(good([t[2:] for t in scope if t[:2] == (f, c)])):
            at = s
            for a, b, _ in cover:
                if b <= at or a >= e:
                    continue
                if a > at:
                    out.append(("gap", f, c, "", at, a, 0))
                at = max(at, b)
            if at < e:
                out.append(("gap", f, c, "", at, e, 0))
    return sorted(out, key=repr)


def run(spark, turns, scope, width):
    t = spark.createDataFrame([(*x, "z") for x in turns], "file_id STRING, channel STRING, speaker_id STRING, start_us BIGINT, end_us BIGINT, starts STRING")
    u = spark.createDataFrame(scope, "file_id STRING, channel STRING, start_us BIGINT, end_us BIGINT")
    rows = periods_and_gaps(t, u, width=width).collect()
    return sorted(((r.kind, r.file_id, r.channel, r.speaker_id, r.start_us, r.end_us, r.n_rows) for r in rows), key=repr)


def test_random(spark):
    rng = random.Random(9)
    span = lambda n: (a := rng.randrange(-20, 300), rng.choice([None, a, a - 3, a + rng.randrange(1, n)]) if rng.random() < 0.2 else a + rng.randrange(1, n))
    turns = [(rng.choice(["f", "f", "g", None, ""]), rng.choice(["1", "2", None]), rng.choice(["a", "b", None]), *span(rng.choice([4, 90]))) for _ in range(250)]
    scope = [(rng.choice(["f", "g", "h", None, ""]), rng.choice(["1", "2", None]), *span(rng.choice([10, 200]))) for _ in range(40)]
    for width in (7, 50):
        assert run(spark, turns, scope, width) == brute(turns, scope)


def test_far_apart_touching_and_empty(spark):
    turns = [("f", "1", "a", 0, 10), ("f", "1", "a", 10, 10**15), ("f", "1", "a", 10**14, 10**14 + 5), ("f", "1", "a", 10**15 + 1, 10**15 + 2)] * 2
    scope = [("f", "1", -5, 10**16)]
    assert run(spark, turns, scope, 1000) == brute(turns, scope)
    assert run(spark, [], scope, 1000) == brute([], scope)
    assert run(spark, [], [], 1000) == []


def test_one_hot_key(spark):
    df = spark.range(50_000).selectExpr("'f' AS file_id", "id * 10 AS start_us", "id * 10 + 11 AS end_us")
    assert [(r.start_us, r.end_us, r.n_rows) for r in continuous_periods(df, ["file_id"], 1000).collect()] == [(0, 500_001, 50_000)]


def test_tree_of_many_levels(spark, monkeypatch):
    """Lists unite two lanes at a time, from every partition, and the result is the same."""
    monkeypatch.setattr(periods, "FAN", 2)
    monkeypatch.setattr(periods, "HELD_ROWS", 3)
    monkeypatch.setattr(periods, "tree_levels", lambda df: 4)
    rng = random.Random(4)
    turns = [(rng.choice("ffg"), "1", rng.choice("ab"), a := rng.randrange(300), a + rng.randrange(1, 30)) for _ in range(200)]
    scope = [(rng.choice("fg"), "1", a := rng.randrange(300), a + rng.randrange(1, 90)) for _ in range(40)]
    assert run(spark, turns, scope, 50) == brute(turns, scope)
    df = spark.createDataFrame(turns, "file_id STRING, channel STRING, speaker_id STRING, start_us BIGINT, end_us BIGINT").repartition(9)
    assert sum(r.n_rows for r in continuous_periods(df, ["file_id"], 40).collect()) == 200


def test_merge_and_complement():
    rng = np.random.default_rng(3)
    for big in (1, 1 << 58):  # the second does not fit a joint number
        codes, start = rng.integers(0, 5, 80), rng.integers(-50, 300, 80) * big // (1 if big == 1 else 300)
        end = start + rng.integers(1, 20, 80)
        c, s, e, n = merge_sorted(codes, start, end, np.ones(80, np.int64))
        assert sorted(zip(c.tolist(), s.tolist(), e.tolist(), n.tolist())) == sorted((k, *x) for k in range(5) for x in union([(a, b) for q, a, b in zip(codes.tolist(), start.tolist(), end.tolist()) if q == k]))
    scope, cover = (np.array([0, 40, 90]), np.array([30, 80, 95])), (np.array([5, 20, 60]), np.array([10, 50, 92]))
    assert [x.tolist() for x in complement(scope, cover, 0)] == [[0, 10, 50, 92], [5, 20, 60, 95]]
    assert [x.tolist() for x in complement(scope, (np.zeros(0, np.int64),) * 2, 0)] == [[0, 40, 90], [30, 80, 95]]


def test_gaps_come_from_the_complement(spark, monkeypatch):
    turns, scope = [("f", "1", "a", 10, 20)], [("f", "1", 0, 30)]
    assert [x[0] for x in run(spark, turns, scope, 8)] == ["gap", "gap", "period"]
    monkeypatch.setattr(periods, "gap_lists", lambda scope, cover, keys: cover.select(*keys, periods.BLOCK, "starts", "ends", "counts").where("false"))
    assert [x[0] for x in run(spark, turns, scope, 8)] == ["period"]
