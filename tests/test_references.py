import datetime as dt
import random

from chronoloom.operators.references import Reference, orphan_references, orphan_report

T0 = dt.datetime(2025, 1, 1)


def day(n):
    return None if n is None else T0 + dt.timedelta(hours=n)


def run(spark, parents, children):
    p = spark.createDataFrame([(k, day(a), day(b), 0) for k, a, b in parents], "k STRING, a TIMESTAMP, b TIMESTAMP, row_id INT")
    c = spark.createDataFrame([(i, k, day(t), "x") for i, (k, t) in enumerate(children)], "id BIGINT, k STRING, t TIMESTAMP, key STRING")
    return orphan_references([Reference(c, "c", "id", "k", "t", p, "p", "k", "a", "b")])


def plain(k):
    if k is None:
        return None
    letters = "".join(x for x in k.lower() if x.isalpha())
    digits = "".join(str(int(x)) for x in k if x.isdigit())
    return (letters + (str(int(digits)) if digits else "")) or None


def brute(parents, children):
    out = []
    for i, (k, t) in enumerate(children):
        if plain(k) and (t is None or not any(plain(p) == plain(k) and a is not None and a <= t and (b is None or t < b) for p, a, b in parents)):
            out.append(i)
    return out


def test_random(spark):
    rng = random.Random(3)
    names = ["aud-1", "AUD_001", "aud2", "(Aud 2)", "x", "aud-０１", "", None, "--"]
    parents = [(rng.choice(names), rng.choice([None, *range(0, 100, 5)]), rng.choice([None, None, *range(0, 100, 5)])) for _ in range(60)]
    children = [(rng.choice(names), rng.choice([None, *range(0, 110, 5)])) for _ in range(300)] + [("aud-1", 50)] * 50
    parents = [p for p in parents if p[0] != "aud2" or p[1] != 0]
    assert sorted(r.row_id for r in run(spark, parents, children).collect()) == brute(parents, children)


def test_ties_and_empty(spark):
    assert [r.row_id for r in run(spark, [("a1", 5, 7)], [("a1", 4), ("a1", 5), ("a1", 7)]).orderBy("row_id").collect()] == [0, 2]
    assert run(spark, [], [("a", 1), (None, 1)]).count() == 1
    assert run(spark, [("a", 1, None)], []).count() == 0


def test_report(spark):
    got = orphan_report(run(spark, [], [("a1", 1), ("A01", 2), ("b", None)])).collect()
    assert sorted((r.period, r.orphan_rows, r.missing_keys) for r in got) == [("2025-01", 2, 1), ("unknown", 1, 1)]
