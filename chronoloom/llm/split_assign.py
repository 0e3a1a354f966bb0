"""Splits that keep related records together: a min-cost flow over bundles of components."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.ids import plain_form
from chronoloom.llm.components import tied_rows
from chronoloom.operators.blocked import BLOCK, across, before, inside
from chronoloom.session import counted_cut, cut

#: Steps in which the share of a label in a component is told, components a task ranks, splits at most.
STEPS, RANKED, MOST_SPLITS = 8, 50_000, 100


class Flow:
    """Min-cost flow, all shortest paths of one length at a time; integer capacities and costs."""

    def __init__(self) -> None:
        self.out: dict[object, list[int]] = {}
        self.to: list[object] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: object, b: object, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.to))
            self.out.setdefault(y, [])
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def _lengths(self, source: object) -> dict[object, int]:
        best, queue, waiting = {source: 0}, deque([source]), {source}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in self.out.get(a, ()):
                if self.room[e]:
                    b, d = self.to[e], best[a] + self.cost[e]
                    if d < best.get(b, 1 << 62):
                        best[b] = d
                        if b not in waiting:
                            waiting.add(b)
                            queue.append(b)
        return best

    def _push(self, source: object, sink: object, best: dict[object, int]) -> bool:
        """One path of shortest arcs after the other until none is left; nodes that lead nowhere are left out."""
        tried, pushed = dict.fromkeys(best, 0), False
        while True:
            path, on, at = [], {source}, source
            while at != sink:
                arcs = self.out[at]
                while tried[at] < len(arcs):
                    e = arcs[tried[at]]
                    b = self.to[e]
                    if self.room[e] and b not in on and best.get(b) == best[at] + self.cost[e]:
                        break
                    tried[at] += 1
                else:
                    if at == source:
                        return pushed
                    on.discard(at)
                    at = self.to[path.pop() ^ 1]
                    tried[at] += 1
                    continue
                path.append(e)
                on.add(b)
                at = b
            moved = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= moved
                self.room[e ^ 1] += moved
            pushed = True

    def run(self, source: object, sink: object) -> None:
        while True:
            best = self._lengths(source)
            if sink not in best or not self._push(source, sink, best):
                return


def whole_quotas(total: int, shares: dict[str, float]) -> dict[str, int]:
    """Integers in proportion to the shares that add up to *total*; largest remainders, ties by name.

    Shares that are all 0 count as equal ones.
    """
    if not any(shares.values()):
        shares = dict.fromkeys(shares, 1.0)
    whole = sum(shares.values())
    exact = {s: total * w / whole for s, w in shares.items()}
    out = {s: int(x) for s, x in exact.items()}
    for s in sorted(shares, key=lambda s: (out[s] - exact[s], s))[: total - sum(out.values())]:
        out[s] += 1
    return out


def moved_rows(own: list[int], quotas: list[int]) -> list[list[tuple[int, int]]]:
    """For each split, the splits that rows of its own shares move to, and how many, by min-cost flow.

    In the flow from bundles to splits, rows of a bundle beyond its own share of a split cost 1, rows
    beyond the quota of the split 1000. Each bundle's own shares are all of its rows, at no cost, so what
    the cheapest flow changes depends on the sums of the own shares alone: the nodes of all bundles fall
    into one a split, and the optimum stays what it is, however many bundles there are.
    """
    flow, arcs = Flow(), {}
    for s, (n, q) in enumerate(zip(own, quotas, strict=True)):
        flow.arc("source", ("own", s), n, 0)
        flow.arc(("split", s), "sink", q, 0)
        flow.arc(("split", s), "sink", sum(own), 1000)
    for s, n in enumerate(own):
        for t in range(len(own)):
            arcs[s, t] = flow.arc(("own", s), ("split", t), n, int(s != t))
    flow.run("source", "sink")
    return [[(t, flow.flow(arcs[s, t])) for t in range(len(own)) if t != s and flow.flow(arcs[s, t])] for s in range(len(own))]


def allotted(bundles: Iterable[tuple[str, int, int, list[int]]], weights: list[float], own: list[int], moves: list[list[tuple[int, int]]]) -> Iterator[tuple[str, int, list[int]]]:
    """(profile, size, components for each split) of bundles (profile, size, number, own shares), one after the other.

    *bundles* come from the largest size down; only a few numbers a split are held. The rows that
    :func:`moved_rows` moves lie evenly among those of the bundles in this order.

    Components cannot be parted, so the flow is rounded to whole ones: each bundle gives every split
    its flow and what larger ones owe it, in whole components, the rest one by one to the split that
    is owed most. Small components thereby settle what large ones leave.
    """
    k = range(len(weights))
    owed, seen = [0] * len(weights), [0] * len(weights)
    for profile, size, n, shares in bundles:
        flow = [0] * len(weights)
        for s in k:
            at, left, total = seen[s], shares[s], own[s]
            for t, x in moves[s]:
                # of every *total* rows *x* move; the others go on to the next split
                if left:
                    a = x * at // total
                    m = x * (at + left) // total - a
                    flow[t] += m
                    at, left, total = at - a, left - m, total - x
            flow[s] += left
            seen[s] += shares[s]
        want = [max(0, flow[s] + owed[s]) for s in k]
        whole = sum(want)  # at least size * n, since what is owed adds up to nothing
        given = [min(n, w * n // whole) if whole else 0 for w in want]
        for _ in range(n - sum(given)):  # fewer than there are splits
            given[max(k, key=lambda s: (want[s] - given[s] * size, weights[s], s))] += 1
        for s in k:
            owed[s] += flow[s] - given[s] * size
        yield profile, size, given


def allocate(bundles: list[tuple[str, int, int]], shares: dict[str, float]) -> dict[tuple[str, int], dict[str, int]]:
    """How many components of each bundle (profile, size, number of components) go to each split.

    The same steps as :func:`assign_splits` takes, over a list: own shares of the bundles, the cheapest
    flow that meets the quotas, and whole components from the largest size down.
    """
    names = sorted(shares)
    split = lambda n: [whole_quotas(n, shares)[s] for s in names]
    held = [(profile, size, n, split(size * n)) for profile, size, n in sorted(bundles, key=lambda b: (-b[1], b[0]))]
    own = [sum(x[s] for *_, x in held) for s in range(len(names))]
    out = allotted(held, [shares[s] for s in names], own, moved_rows(own, split(sum(own))))
    return {(profile, size): dict(zip(names, given, strict=True)) for profile, size, given in out}


def assign_splits(rows: DataFrame, targets: DataFrame, row: str = "row_id", session: str = "session_id", group: str = "augmentation_group", recording: str = "recording_id", label: str = "split") -> DataFrame:
    """A new split for every row, shares met as closely as possible, tied rows never parted.

    Returns row_id, component, split.

    Method: components of rows tied by session, group or recording are bundled by size and label
    profile: which share of their rows each target split had, in eighths. The own shares of the bundles
    are told and summed on the cluster, the sums alone reach the driver, and :func:`moved_rows` solves
    the quotas by min-cost flow. One task then reads the bundles, a row each, from the largest size
    down and rounds the flow to whole components (:func:`allotted`); it holds none of them, so every
    number of bundles takes the same way. The members of a bundle are assigned by the order of their
    hash, whose ranks are counted in blocks of at most about :data:`RANKED` components, stretches of that
    order, so a bundle of all single rows is never in one task and blocks do not change what is assigned.

    Defined cases: null keys and keys without letters or digits tie nothing; rows without keys are
    components of their own; repeated rows are tied by their recording; no rows give no rows; a
    component larger than any quota goes to the largest; shares are taken in proportion to their sum,
    null and negative ones count as 0, and if all are 0 as equal; without targets there is nothing to assign to, and beyond
    :data:`MOST_SPLITS` they are no table of targets: an error.
    """
    named = targets.select("split_name", "share").where("split_name IS NOT NULL").limit(MOST_SPLITS + 1).collect()
    shares = {r.split_name: max(0.0, r.share or 0.0) for r in named}
    if not shares or len(named) > MOST_SPLITS:
        raise ValueError("no target splits" if not shares else "too many target splits")
    keys = {"r": plain_form(F.col(recording)), "s": plain_form(F.col(session)), "g": plain_form(F.col(group))}
    tied = cut(tied_rows(rows, row, keys), "tied")
    spark = rows.sparkSession
    # what a target is called in plain form, as the old splits are
    plain = [r.p for r in spark.createDataFrame([(s,) for s in sorted(shares)], "s STRING").select(plain_form(F.col("s")).alias("p")).collect()]
    old = rows.select(F.col(row).cast("bigint").alias("row_id"), plain_form(F.col(label)).alias("old"))
    parts = [F.count(F.when(F.col("old") == p, 1)).alias(f"_n{k}") for k, p in enumerate(plain)]
    counts = tied.join(old, "row_id").groupBy("component").agg(F.count("*").alias("size"), *parts)
    eighths = F.concat_ws(",", *[F.round(F.col(f"_n{k}") * STEPS / F.col("size")).cast("int") for k in range(len(plain))])
    profile = cut(counts.select("component", "size", eighths.alias("profile")), "profile")
    names = sorted(shares)

    def own_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            quotas = [whole_quotas(size * n, shares) for size, n in zip(b.column("size").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([[q[s] for s in names] for q in quotas], pa.list_(pa.int64()))], [*b.schema.names, "own"])

    counted = profile.groupBy("profile", "size").agg(F.count("*").alias("n"))
    sums = [F.sum(F.get("own", F.lit(k))).alias(f"own{k}") for k in range(len(names))]
    bundled, seen = counted_cut(counted.mapInArrow(own_shares, "profile STRING, size BIGINT, n BIGINT, own ARRAY<BIGINT>"), "bundles", F.max("n").alias("most"), *sums)
    own = [seen.get(f"own{k}") or 0 for k in range(len(names))]
    quotas = whole_quotas(sum(own), shares)
    moves = moved_rows(own, [quotas[s] for s in names])

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles = ((r["profile"], r["size"], r["n"], r["own"]) for b in batches for r in b.to_pylist())
        given = ((p, size, list(accumulate(g))) for p, size, g in allotted(bundles, [shares[s] for s in names], own, moves))
        while some := list(islice(given, 10_000)):
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*some, strict=True), (pa.string(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["profile", "size", "ends"])

    ends = cut(bundled.repartition(1).sortWithinPartitions(F.desc("size"), "profile").mapInArrow(give, "profile STRING, size BIGINT, ends ARRAY<BIGINT>"), "given")
    bits = ((seen.get("most") or 0) // RANKED).bit_length()
    placed = profile.withColumn("_h", F.xxhash64("component")).withColumn(BLOCK, F.shiftright("_h", 63 - bits))
    k = ["profile", "size"]
    blocks = placed.groupBy(*k, BLOCK).agg(F.count("*").alias("_n"))
    blocks = blocks.select(*k, BLOCK, F.coalesce(F.sum("_n").over(before(across(k))), F.lit(0)).alias("_before")).join(ends, k)
    ranked = placed.withColumn("_rank", F.row_number().over(inside(k, "_h", "component")) - 1).join(blocks, [*k, BLOCK]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    new = F.get(F.array(*map(F.lit, names)), F.size(F.filter("ends", lambda x: x <= F.col("_rank"))))
    chosen = ranked.select("component", new.alias("split"))
    return tied.join(chosen, "component").select("row_id", "component", "split")


def split_balance(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target split: quota (whole rows), whether its rows are within the largest component of it, and
    how many components were parted."""
    named = targets.select("split_name", "share").where("split_name IS NOT NULL").limit(MOST_SPLITS + 1).collect()
    spark = assigned.sparkSession
    quotas = whole_quotas(assigned.count(), {r.split_name: max(0.0, r.share or 0.0) for r in named})
    quota = spark.createDataFrame(sorted(quotas.items()), "split STRING, quota BIGINT")
    of_component = assigned.groupBy("component").agg(F.count("*").alias("n"), F.min("split").alias("a"), F.max("split").alias("z"))
    whole = of_component.agg(F.max("n").alias("_most"), F.count(F.when(F.col("a") != F.col("z"), 1)).alias("n_parted"))
    got = assigned.groupBy("split").agg(F.count("*").alias("n"))
    near = F.abs(F.coalesce("n", F.lit(0)) - F.col("quota")) <= F.coalesce("_most", F.lit(0))
    return quota.join(got, "split", "left").join(F.broadcast(whole)).select("split", "quota", near.alias("within"), "n_parted")
