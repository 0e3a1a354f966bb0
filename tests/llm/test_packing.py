import random
from collections import defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from chronoloom.llm.packing import _repack, best_fit_decreasing, lower_bound, packed, packing_checks, packing_report, token_counts


def optimum(sizes, capacity):
    best = len(sizes)
    for order in set(permutations(sizes)):
        bins = []
        for s in order:
            for k, b in enumerate(bins):
                if b + s <= capacity:
                    bins[k] += s
                    break
            else:
                bins.append(s)
        best = min(best, len(bins))
    return best


def test_bound_and_fit():
    rng = random.Random(6)
    for _ in range(150):
        capacity = rng.randrange(2, 40)
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 7))]
        bins = best_fit_decreasing(np.array(sizes), capacity)
        fill = defaultdict(int)
        for b, s in zip(bins.tolist(), sizes, strict=True):
            fill[b] += s
        assert max(fill.values()) <= capacity
        assert lower_bound(np.array(sizes), capacity) <= optimum(sizes, capacity) <= len(fill)
    assert lower_bound(np.array([6, 6, 6]), 10) == 3
    assert lower_bound(np.zeros(0, np.int64), 10) == 0


def test_packed(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["gain", "noise", "화자", "the"]) for _ in range(rng.choice([1, 5, 20, 90, 400]))), "q") for i in range(300)] + [(900, None, "q"), (901, "", "q"), (5, "same", "q"), (5, "same", "q")]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, part STRING")
    specs = spark.createDataFrame([(1, 64), (2, 500), (3, None)], "spec_id INT, capacity_tokens INT")
    sizes = defaultdict(list)
    for r in token_counts(df).collect():
        if r.n_tokens:
            sizes[r.doc_id].append(r.n_tokens)
    rows = packed(df, specs, part_items=40, fan=2).collect()
    for spec, capacity in ((1, 64), (2, 500)):
        own = [r for r in rows if r.spec_id == spec]
        fill, pieces = defaultdict(int), defaultdict(int)
        for r in own:
            fill[r.container] += r["size"]
            pieces[r.doc_id] += r["size"]
        assert max(fill.values()) <= capacity
        assert {d: n for d, n in pieces.items()} == {d: sum(n) for d, n in sizes.items()}
        cut = sum(-(-n // capacity) for v in sizes.values() for n in v)
        assert len(own) == cut
        assert len(fill) <= 1.1 * sum(fill.values()) / capacity + 3
    report = {r.spec_id: r.n_tokens for r in packing_report(packed(df, specs, part_items=40, fan=2)).collect()}
    assert report == {s: sum(map(sum, sizes.values())) for s in (1, 2)}
    assert packed(df.where("false"), specs).count() == 0


def test_repacking_saves_bins_and_is_what_saves_them(spark, monkeypatch):
    """Without the exchange every one of the partitions keeps a bin of its own open."""
    from chronoloom.llm import packing

    docs = spark.createDataFrame([(i, " ".join(["the"] * n)) for i, n in enumerate([3, 5, 2, 7, 4, 6, 1, 8] * 12)], "doc_id BIGINT, text STRING")
    specs = spark.createDataFrame([(1, 40)], "spec_id INT, capacity_tokens INT")
    with_exchange = packing_report(packed(docs, specs)).first()
    assert with_exchange.certified and with_exchange.n_containers == -(-with_exchange.n_tokens // 40)
    closed = packed(docs, specs).select("container", "bins", "bound").collect()
    assert all(r.bins >= r.bound >= 1 for r in closed) and any(not r.container.startswith(("0-", "full-")) for r in closed)
    alone = packing_report(packed(docs, specs, slack=1.0)).first()  # no bin has that much room, so none is exchanged
    assert alone.n_containers > with_exchange.n_containers and alone.n_tokens == with_exchange.n_tokens


def test_crowded_exchanges_are_spread_not_left(spark):
    docs = spark.createDataFrame([(i, " ".join(["the"] * (3 + i % 5))) for i in range(400)], "doc_id BIGINT, text STRING")
    specs = spark.createDataFrame([(1, 13), (2, 29)], "spec_id INT, capacity_tokens INT")
    rows = packed(docs, specs, part_items=10, fan=2)
    assert sorted(tuple(r)[2:] for r in packing_checks(rows, docs).collect()) == [(400, 0, 0, 0, 0)] * 2
    for r in packing_report(rows).collect():
        assert r.n_containers <= 1.12 * r.bound


def test_certified_bins_stay():
    t = pa.table({"part_was": [0, 0, 1], "bin": [0, 1, 0], "size": pa.array([6, 6, 6], pa.int64()), "capacity": [10, 10, 10], "bins": pa.array([0, 0, 0], pa.int64()), "bound": pa.array([0, 0, 0], pa.int64())})
    got = _repack(t)
    assert got.column("bin").to_pylist() == [0, 1, 2] and set(got.column("bound").to_pylist()) == {3}


def test_too_many_capacities(spark):
    docs = spark.createDataFrame([(1, "the")], "doc_id BIGINT, text STRING")
    with pytest.raises(ValueError, match="capacities"):
        packed(docs, spark.range(1, 10_003).selectExpr("id AS spec_id", "id AS capacity_tokens"))
