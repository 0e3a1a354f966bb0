import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import cross_split, split_assign
from chronoloom.llm.components import representatives, tied_rows
from chronoloom.llm.cross_split import coverage, cross_split_pairs, keyed_rows, matched_intervals, originals, row_links
from chronoloom.llm.event_runs import collapse_runs
from chronoloom.llm.split_assign import Flow, allocate, assign_splits, moved_rows, split_balance, whole_quotas

SCHEMA = "row_id BIGINT, recording_id STRING, session_id STRING, split STRING, source_recording_id STRING, augmentation_group STRING, component STRING"


def brute_components(rows):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in rows:
        for kind, k in zip("rsg", (r[1], r[2], r[5]), strict=True):
            if k:
                up[find((kind, k))] = find(("row", r[0]))
        find(("row", r[0]))
    out = defaultdict(list)
    for r in rows:
        out[find(("row", r[0]))].append(r[0])
    return out.values()


def rows_of(rng, n=120):
    pick = lambda kind, m: rng.choice([None, "", *[f"{kind}{x}" for x in range(m)]])
    splits = ["CALIBRATION", "calibration ", "RELEASE-HOLDOUT", "DEVELOPMENT_HOLDOUT", None, "PENDING"]
    return [(i, pick("r", 90), pick("s", 110), rng.choice(splits), pick("r", 120) if rng.random() < 0.4 else None, pick("g", 110), "c") for i in range(n)]


def test_components_and_splits(spark):
    rows = rows_of(random.Random(3))
    df = spark.createDataFrame(rows, SCHEMA)
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    tied = tied_rows(df, "row_id", {"r": blank("recording_id"), "s": blank("session_id"), "g": blank("augmentation_group")})
    expected = sorted((min(c), x) for c in brute_components(rows) for x in c if x != min(c))
    assert sorted(map(tuple, representatives(tied).collect())) == expected
    targets = spark.createDataFrame([("A", 0.7), ("B", 0.2), ("C", 0.1)], "split_name STRING, share DOUBLE")
    new = {r.row_id: r.split for r in assign_splits(df, targets).collect()}
    assert sorted(new) == list(range(len(rows)))
    for c in brute_components(rows):
        assert len({new[x] for x in c}) == 1
    biggest = max(map(len, brute_components(rows)))
    for s, w in (("A", 0.7), ("B", 0.2), ("C", 0.1)):
        assert abs(Counter(new.values())[s] - w * len(rows)) <= biggest
    assert assign_splits(df.where("false"), targets).count() == 0
    with pytest.raises(ValueError):
        assign_splits(df, targets.where("false"))


def test_long_chain(spark):
    rows = [(i, f"r{i}", f"s{i // 2}", None, None, f"g{(i + 1) // 2}", "c") for i in range(65)]
    tied = tied_rows(spark.createDataFrame(rows, SCHEMA), "row_id", {"s": F.col("session_id"), "g": F.col("augmentation_group")})
    assert sorted(map(tuple, representatives(tied).collect())) == [(0, i) for i in range(1, 65)]


def test_allocation():
    shares = {"A": 0.7, "B": 0.15, "C": 0.15}
    for bundles in ([("x", 1, 1000)], [("x", 30, 3), ("x", 7, 20), ("y", 2, 50), ("y", 1, 30)], [("x", 1000, 1), ("x", 1, 5)], []):
        out = allocate(bundles, shares)
        total = sum(s * n for _, s, n in bundles)
        got = Counter()
        for (label, size), given in out.items():
            assert sum(given.values()) == next(n for b, s, n in bundles if (b, s) == (label, size))
            for s, n in given.items():
                assert n >= 0
                got[s] += n * size
        if bundles and bundles[0][1] < 100:
            assert all(abs(got[s] - q) <= 1 for s, q in whole_quotas(total, shares).items())


def test_flow_is_cheapest():
    """Against all ways to send small flows from two sources to three sinks."""
    from itertools import product

    rng = random.Random(7)
    for _ in range(20):
        supply, room = [rng.randrange(1, 4) for _ in range(2)], [rng.randrange(4) for _ in range(3)]
        cost = [[rng.randrange(6) for _ in range(3)] for _ in range(2)]
        flow = Flow()
        arcs = {(a, b): flow.arc(("a", a), ("b", b), 9, cost[a][b]) for a in range(2) for b in range(3)}
        for a in range(2):
            flow.arc("source", ("a", a), supply[a], 0)
        for b in range(3):
            flow.arc(("b", b), "sink", room[b], 0)
        flow.run("source", "sink")
        got = {k: flow.flow(e) for k, e in arcs.items()}
        ways = [w for w in product(range(4), repeat=6) if all(sum(w[3 * a : 3 * a + 3]) <= supply[a] for a in range(2)) and all(w[b] + w[3 + b] <= room[b] for b in range(3))]
        most = max(map(sum, ways))
        assert sum(got.values()) == most
        assert sum(got[a, b] * cost[a][b] for a, b in got) == min(sum(w[3 * a + b] * cost[a][b] for a in range(2) for b in range(3)) for w in ways if sum(w) == most)


def test_bundles_keep_their_shares():
    """Size and profile decide: each bundle is spread in the target shares, not only the whole."""
    shares = {"A": 0.5, "B": 0.5}
    out = allocate([("8,0", 1, 100), ("0,8", 1, 60), ("8,0", 5, 20), ("4,4", 3, 40)], shares)
    assert out == {("8,0", 5): {"A": 10, "B": 10}, ("4,4", 3): {"A": 20, "B": 20}, ("0,8", 1): {"A": 30, "B": 30}, ("8,0", 1): {"A": 50, "B": 50}}


def test_planted_targets(spark):
    rows = [(i, f"r{i}", f"s{i // 7}" if i < 70 else None, "A" if i % 3 else "B", None, None, "c") for i in range(200)]
    targets = spark.createDataFrame([("A", 0.8), ("B", 0.15), ("C", 0.05), (None, 3.0)], "split_name STRING, share DOUBLE")
    got = assign_splits(spark.createDataFrame(rows, SCHEMA), targets)
    assert Counter(r.split for r in got.collect()) == {"A": 160, "B": 30, "C": 10}
    assert sorted(map(tuple, split_balance(got, targets).collect())) == [("A", 160, True, 0), ("B", 30, True, 0), ("C", 10, True, 0)]


def test_size_switches_nothing(spark, monkeypatch):
    """Neither the number of bundles nor that of components in one changes what is assigned."""
    rows = [(i, None, f"s{i}", "AB"[i % 2], None, None, "c") for i in range(120)] + [(200 + i, None, f"t{i // 3}", "AB"[i // 3 % 2], None, None, "c") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    targets = spark.createDataFrame([("A", 0.5), ("B", 0.5)], "split_name STRING, share DOUBLE")
    new = sorted(map(tuple, assign_splits(df, targets).collect()))
    # singles and threes of either label are halved each
    label = {r[0]: r[3] for r in rows}
    assert Counter((i < 200, label[i], s) for i, _, s in new) == {(single, x, s): 30 if single else 15 for single in (True, False) for x in "AB" for s in "AB"}
    for name, least in (("MOST_BUNDLES", 2), ("RANKED", 7)):
        with monkeypatch.context() as m:
            m.setattr(split_assign, name, least, raising=False)
            assert sorted(map(tuple, assign_splits(df, targets).collect())) == new


def test_few_nodes_cost_as_little():
    """The flow with a node a split is as cheap as that with a node a bundle."""
    rng = random.Random(13)
    for _ in range(20):
        shares = {s: rng.random() for s in "ABCD"[: rng.randrange(2, 5)]}
        supply = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 25))]
        quotas, own = whole_quotas(sum(supply), shares), [whole_quotas(n, shares) for n in supply]
        flow, beyond, over = Flow(), [], []
        for s, q in quotas.items():
            flow.arc(("split", s), "sink", q, 0)
            over.append(flow.arc(("split", s), "sink", sum(supply), 1000))
        for b, n in enumerate(supply):
            flow.arc("source", ("bundle", b), n, 0)
            for s, q in own[b].items():
                flow.arc(("bundle", b), ("split", s), q, 0)
                beyond.append(flow.arc(("bundle", b), ("split", s), n, 1))
        flow.run("source", "sink")
        assert sum(map(flow.flow, over)) == 0
        moves = moved_rows([sum(x[s] for x in own) for s in shares], list(quotas.values()))
        assert sum(n for m in moves for _, n in m) == sum(map(flow.flow, beyond))


def test_shares_of_nothing_are_equal(spark):
    rows = [(i, None, None, "A", None, None, "c") for i in range(20)]
    targets = spark.createDataFrame([("A", 0.0), ("B", None)], "split_name STRING, share DOUBLE")
    got = assign_splits(spark.createDataFrame(rows, SCHEMA), targets)
    assert Counter(r.split for r in got.collect()) == {"A": 10, "B": 10}


def brute_pairs(rows):
    plain = lambda x: "".join(c for c in (x or "").lower() if c.isalnum()) or None
    src = {}
    for r in rows:
        if r[1]:
            src.setdefault(r[1], set()).add(r[4] or None)
    src = {k: min((x for x in v if x), default=None) for k, v in src.items()}

    def original(r):
        at, seen = r[1] or None, []
        if at is None:
            return r[4] or None
        while at in src and src[at] and src[at] != at:
            if at in seen:
                return min(seen[seen.index(at) :])
            seen.append(at)
            at = src[at]
        return at

    out = set()
    for a in rows:
        for b in rows:
            if plain(a[3]) == "calibration" and plain(b[3]) in ("developmentholdout", "releaseholdout"):
                if any(x and x == y for x, y in ((a[2], b[2]), (a[5], b[5]), (original(a), original(b)))):
                    out.add((a[0], b[0]))
    return sorted(out)


def test_cross_split(spark, monkeypatch):
    monkeypatch.setattr(cross_split, "SALT_ROWS", 5)
    monkeypatch.setattr(cross_split, "SHARD_ROWS", 40)
    rows = rows_of(random.Random(11))
    rows += [(900 + i, f"c{i}", None, "CALIBRATION" if i % 2 else "RELEASE_HOLDOUT", f"c{(i + 1) % 3}", None, "c") for i in range(3)]
    rows += [(950 + i, f"h{i}", "HOT", "CALIBRATION" if i % 2 else "RELEASE_HOLDOUT", f"h{i - 1}" if i else "h0", None, "c") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = cross_split_pairs(df).collect()
    assert sorted((r.train_row, r.eval_row) for r in got) == brute_pairs(rows)
    assert {r.rec: r.original for r in originals(df).where("rec LIKE 'h%' OR rec LIKE 'c%'").collect()} == {**{f"h{i}": "h0" for i in range(30)}, **{f"c{i}": "c0" for i in range(3)}}
    cover = {r.row_id: r.covered for r in coverage(df).collect()}
    assert {k for k, v in cover.items() if v > 0} == {b for _, b in brute_pairs(rows)}
    assert cross_split_pairs(df.where("false")).count() == 0
    links = Counter(x for pair in brute_pairs(rows) for x in pair)
    assert {r.row_id: r.n_links for r in row_links(df).collect() if r.n_links} == links


def test_automata_decide(spark, monkeypatch):
    """Keys that only end alike share a shard; what stands in a text is told by the automaton."""
    rows = [(i, None, f"{'ab'[i % 2]}same{i // 2}ending", "CALIBRATION" if i % 2 else "RELEASE_HOLDOUT", None, None, "c") for i in range(20)] + [(50, None, "asame3ending", "CALIBRATION", None, None, "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [(r.train_row, r.eval_row) for r in cross_split_pairs(df).collect()]
    assert got == brute_pairs(rows) == [(50, 6)]
    at = matched_intervals(keyed_rows(df)).collect()
    assert [(r.passage, r.at, r.n_rows) for r in at] == [("\u0001s:asameending3\u0001", 0, 1)]

    def all_of_a_shard(t):
        passages = [r["text"] for r in t.to_pylist() if r["passage"]]
        hits = [(r["text"], p, 0, 1) for r in t.to_pylist() if not r["passage"] for p in passages]
        return pa.table({n: pa.array([h[k] for h in hits], x) for k, (n, x) in enumerate((("text", pa.string()), ("passage", pa.string()), ("at", pa.int64()), ("n_rows", pa.int64())))})

    monkeypatch.setattr(cross_split, "_scan", all_of_a_shard)
    assert {(r.passage, r.text) for r in matched_intervals(keyed_rows(df)).collect()} > {(r.passage, r.text) for r in at}


def brute_runs(rows, pause):
    out = []
    for key in {(f, c) for f, c, *_ in rows}:
        own = sorted((s, e, i, sp) for f, c, sp, s, e, i in rows if (f, c) == key and sp is not None and s is not None and e is not None and e > s)
        run = []
        for x in own:
            if run and run[-1][3] == x[3] and x[0] <= max(y[1] for y in run) + pause:
                run.append(x)
            else:
                if run:
                    out.append((*key, run[0][3], run[0][2], run[-1][2], len(run), run[0][0], max(y[1] for y in run)))
                run = [x]
        if run:
            out.append((*key, run[0][3], run[0][2], run[-1][2], len(run), run[0][0], max(y[1] for y in run)))
    return sorted(out, key=repr)


def test_runs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        s = rng.choice([None, *range(0, 900)])
        rows.append((rng.choice(["f", "f", "f", None]), rng.choice(["1", None]), rng.choice(["a", "a", "a", "b", None]), s, rng.choice([None, (s or 0) - 1, *[(s or 0) + x for x in (1, 5, 5, 9, 300)]]), i))
    df = spark.createDataFrame([(*r, "k") for r in rows], "file_id STRING, channel STRING, speaker STRING, start_us BIGINT, end_us BIGINT, row_id BIGINT, label STRING")
    for width in (10, 128, 10**6):
        got = collapse_runs(df, ["file_id", "channel"], "speaker", "start_us", "end_us", "row_id", pause=3, width=width).collect()
        assert sorted(((r.file_id, r.channel, r.label, r.first_row, r.last_row, r.n_events, r.start, r.end) for r in got), key=repr) == brute_runs(rows, 3)
    assert collapse_runs(df.where("false"), ["file_id"], "speaker", "start_us", "end_us", "row_id").count() == 0
