"""Continuous periods and gaps of interval sets: a mergeable aggregate of sorted disjoint lists."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.operators.blocked import BLOCK, across, before, block_of, counted_width, inside, null_safe_keys, restored, upto
from chronoloom.session import cut

HOUR_US = 3_600_000_000
LISTS = "starts ARRAY<BIGINT>, ends ARRAY<BIGINT>, counts ARRAY<BIGINT>"
#: Lanes that meet in a node of the tree, bytes of a map task, rows it lists at a time.
FAN, SPLIT_BYTES, HELD_ROWS = 64, 128 << 20, 200_000
LANE = "_lane"


def _joint(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, int, int] | None:
    """Codes and values in one number that orders as the pair does: (numbers, least value, span), if 64 bits hold it."""
    low = int(values.min())
    span = int(values.max()) - low + 1
    return ((codes * span + (values - low)), low, span) if (int(codes.max()) + 1) * span < 1 << 62 else None


def merge_sorted(codes: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Linear merge: per code, overlapping or touching intervals become one and their counts add up.

    Returns codes, starts, ends and counts of the merged intervals, by code and start. Lists that are
    sorted, laid end to end, are runs to the merge sort, which merges them without comparing within a
    run. The running latest end restarts with each code.
    """
    if not len(codes):
        return codes, start, end, count
    joint = _joint(codes, start)
    order = np.argsort(joint[0], kind="stable") if joint else np.lexsort((start, codes))
    codes, start, end, count = codes[order], start[order], end[order], count[order]
    fresh = np.r_[True, codes[1:] != codes[:-1]]
    # one running maximum serves all codes, since any end of a later code exceeds all of earlier ones
    joint = _joint(codes, end)
    if joint:
        latest = np.maximum.accumulate(joint[0]) - codes * joint[2] + joint[1]
    else:
        group = np.cumsum(fresh) - 1
        values, rank = np.unique(end, return_inverse=True)
        latest = values[np.maximum.accumulate(group * np.int64(len(values)) + rank) - group * np.int64(len(values))]
    fresh[1:] |= start[1:] > latest[:-1]
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(codes)] - 1
    return codes[first], start[first], latest[last], np.add.reduceat(count, first)


def _lists(codes: np.ndarray, start: np.ndarray, end: np.ndarray, count: np.ndarray, n: int) -> list[pa.Array]:
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(codes, minlength=n))].astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int64))) for x in (start, end, count)]


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: the rows of some batches become one partial list a (group, block)."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= HELD_ROWS:
            yield from _listed(held)
            held = []
    yield from _listed(held)


def _listed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pa.Table.from_batches(held).combine_chunks().to_batches() if held else []:
        names = [x for x in b.schema.names if x not in ("start_us", "end_us")]
        codes = np.zeros(b.num_rows, np.int64)
        for x in names:
            d = b.column(x).dictionary_encode()
            c = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(d.dictionary) + d.null_count > 1:
                codes = np.unique(codes * (len(d.dictionary) + 1) + c, return_inverse=True)[1]
        lead = np.zeros(codes.max() + 1, np.int64)
        lead[codes[::-1]] = np.arange(b.num_rows)[::-1]
        merged = merge_sorted(codes, b.column("start_us").to_numpy(zero_copy_only=False), b.column("end_us").to_numpy(zero_copy_only=False), np.ones(b.num_rows, np.int64))
        heads = b.select(names).take(pa.array(lead))
        yield pa.RecordBatch.from_arrays([*heads.columns, *_lists(*merged, len(lead))], [*names, "starts", "ends", "counts"])


def _flat(lists: pa.Array, n: int) -> tuple[np.ndarray, ...]:
    """Codes (the row), starts, ends and counts of all lists that a column of lists of states holds."""
    outer = np.diff(lists.offsets.to_numpy())
    parts = lists.flatten()
    sizes = np.diff(parts.field("starts").offsets.to_numpy()) if len(parts) else np.zeros(0, np.int64)
    codes = np.repeat(np.repeat(np.arange(n), outer), sizes)
    return codes, *[parts.field(x).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in ("starts", "ends", "counts")]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reduce side: the partial lists that meet in a node of the tree become one list by linear merge."""
    for b in batches:
        names = [x for x in b.schema.names if x != "lists"]
        yield pa.RecordBatch.from_arrays([*b.select(names).columns, *_lists(*merge_sorted(*_flat(b.column("lists"), b.num_rows)), b.num_rows)], [*names, "starts", "ends", "counts"])


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def tree_levels(df: DataFrame) -> int:
    """Levels of a tree of :data:`FAN` that unites what the map tasks of *df* make, by its size in bytes."""
    tasks = -(-int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // SPLIT_BYTES)
    levels = 1
    while FAN**levels < tasks and levels < 6:
        levels += 1
    return levels


def partial_lists(df: DataFrame, keys: list[str], width: int = HOUR_US) -> DataFrame:
    """Partial states before any shuffle: keys, block of the start, lane (map task), sorted disjoint lists."""
    rows = df.select(*keys, block_of(F.col("start_us"), width).alias(BLOCK), F.spark_partition_id().alias(LANE), F.col("start_us").cast("bigint").alias("start_us"), F.col("end_us").cast("bigint").alias("end_us"))
    return rows.mapInArrow(_partial, f"{_fields(rows, [*keys, BLOCK, LANE])}, {LISTS}")


def merged_lists(states: DataFrame, keys: list[str], levels: int = 1) -> DataFrame:
    """The reduction tree: states of the same keys and block merge into one, lane by lane.

    Every level but the last unites :data:`FAN` neighbouring lanes, so no node has more lists than these
    left. Fewer keys than the states carry merge across the dropped ones (speakers into any speaker).
    """
    state = F.collect_list(F.struct("starts", "ends", "counts")).alias("lists")
    for _ in range(levels - 1):
        states = states.withColumn(LANE, F.floor(F.col(LANE) / FAN).cast("int")).groupBy(*keys, BLOCK, LANE).agg(state)
        states = states.mapInArrow(_merge, f"{_fields(states, [*keys, BLOCK, LANE])}, {LISTS}")
    gathered = states.groupBy(*keys, BLOCK).agg(state)
    return gathered.mapInArrow(_merge, f"{_fields(states, [*keys, BLOCK])}, {LISTS}")


def emitted(states: DataFrame, keys: list[str]) -> DataFrame:
    """Continuous periods from the block states: keys, start_us, end_us, n_rows.

    The tops of the tree never hold a group's whole list: a block carries only the latest end so
    far into the next. Intervals that begin under the carry are absorbed; what a block absorbs and
    its last interval meet the same of other blocks, two rows a block, all others are final.
    """
    e, ks = null_safe_keys(states, keys)
    e = e.drop(*keys)
    cover = e.select(*ks, BLOCK, F.element_at("ends", -1).alias("_top")).withColumn("_carry", F.max("_top").over(before(across(ks)))).drop("_top")
    rows = (
        e.join(cover, [*ks, BLOCK])
        .select(*ks, BLOCK, "_carry", F.size("starts").alias("_n"), F.posexplode(F.arrays_zip("starts", "ends", "counts")).alias("_pos", "_i"))
        .select(*ks, BLOCK, F.col("_i.starts").alias("start_us"), F.col("_i.ends").alias("end_us"), F.col("_i.counts").alias("n_rows"),
                F.when(F.coalesce(F.col("_i.starts") <= F.col("_carry"), F.lit(False)), 0).when(F.col("_pos") == F.col("_n") - 1, 1).otherwise(2).alias("_role"))
    )
    ends = (
        rows.where("_role < 2").groupBy(*ks, BLOCK, "_role").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_rows").alias("n_rows"))
        .withColumn("_chain", F.sum("_role").over(upto(across(ks).orderBy(BLOCK, "_role"))))
        .groupBy(*ks, "_chain").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.sum("n_rows").alias("n_rows"))
    )
    names = [*restored(keys), "start_us", "end_us", "n_rows"]
    return rows.where("_role = 2").select(*names).unionByName(ends.select(*names))


def usable(df: DataFrame, *needed: str) -> DataFrame:
    """Rows with all needed columns, a start, and an end after it."""
    for c in ("start_us", "end_us", *needed):
        df = df.where(F.col(c).isNotNull())
    return df.where("end_us > start_us")


def continuous_periods(df: DataFrame, keys: list[str], width: int = HOUR_US) -> DataFrame:
    """Union of the intervals of each key: overlapping, nested and touching ones become one period.

    Method: a mergeable aggregate whose state is a sorted list of disjoint intervals. Partial lists
    are made on the map side, some batches at a time, and combined by linear merge in a reduction tree
    over (key, block of time), whose upper levels pass only the latest end on. Every list is bounded by
    what begins in one block, so a key that holds a third of all rows is spread over its blocks.

    Defined cases: intervals that are null, empty or end before they start are ignored; null keys
    form a group of their own; repeated rows count in n_rows; an interval of any length is one entry,
    never cut into pieces; no rows give no periods; other columns are never read.
    """
    rows = usable(df).select(*keys, "start_us", "end_us")
    return emitted(merged_lists(partial_lists(rows, keys, width), keys, tree_levels(rows)), keys)


def sweep(sets: dict[str, DataFrame], keys: list[str], width: int = HOUR_US) -> DataFrame:
    """Atomic cells of several interval sets: keys, start_us, end_us and how many of each set hold there.

    One column a set, named as it. Running sums of what begins and ends, in time order, by block with
    carried sums; a cell lasts to the next event, in this block or the next that has one. No interval
    is compared with another, so there is no range join, and a hot key is spread over its blocks.
    """
    names = list(sets)
    parts = []
    for name, df in sets.items():
        both = F.explode(F.array(F.struct(F.col("start_us").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("t"), F.lit(-1).alias("d"))))
        parts.append(df.select(*keys, both.alias("_e")).select(*keys, F.col("_e.t").alias("t"), *[(F.col("_e.d") if n == name else F.lit(0)).alias(f"_d{k}") for k, n in enumerate(names)]))
    events, ks = null_safe_keys(reduce(DataFrame.unionByName, parts), keys)
    steps = [f"_d{k}" for k in range(len(names))]
    at = events.groupBy(*ks, "t").agg(*[F.sum(c).alias(c) for c in steps]).withColumn(BLOCK, block_of(F.col("t"), width))
    w = inside(ks, "t")
    local = at.select("*", F.lead("t").over(w).alias("_next"), *[F.sum(c).over(upto(w)).alias(f"_s{c}") for c in steps])
    blocks = at.groupBy(*ks, BLOCK).agg(F.min("t").alias("_bt"), *[F.sum(c).alias(f"_b{c}") for c in steps])
    a = across(ks)
    carry = blocks.select(*ks, BLOCK, F.lead("_bt").over(a).alias("_after"), *[F.coalesce(F.sum(f"_b{c}").over(before(a)), F.lit(0)).alias(f"_i{c}") for c in steps])
    return (
        local.join(carry, [*ks, BLOCK])
        .select(*restored(keys), F.col("t").alias("start_us"), F.coalesce("_next", "_after").alias("end_us"), *[(F.col(f"_s{c}") + F.col(f"_i{c}")).alias(n) for n, c in zip(names, steps, strict=True)])
        .where("end_us IS NOT NULL")
    )


def uncovered(scope: DataFrame, cover: DataFrame, keys: list[str], width: int = HOUR_US) -> DataFrame:
    """Complement of *cover* within *scope*, per key: longest stretches in scope and in no cover.

    Both are periods as :func:`continuous_periods` gives them, so that neighbouring cells differ in
    one of the two and each cell in scope and in no cover is a longest stretch.
    """
    return sweep({"_u": scope, "_c": cover}, keys, width).where("_u > 0 AND _c = 0").drop("_u", "_c")


def _united(start: np.ndarray, end: np.ndarray, lead: tuple[int, int] | None) -> tuple[np.ndarray, np.ndarray]:
    """A sorted list with what earlier blocks reach into it, as disjoint intervals that do not touch."""
    if lead:
        start, end = np.r_[lead[0], start], np.r_[lead[1], end]
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[first], reach[np.r_[first[1:], len(start)] - 1]


def complement(scope: tuple[np.ndarray, np.ndarray], cover: tuple[np.ndarray, np.ndarray], low: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of *scope* from *low* on in no interval of *cover*; both are sorted and disjoint lists.

    The complement of the cover is the list of what lies between its intervals; each interval of the
    scope meets consecutive entries of it, which two binary searches give.
    """
    free_from, free_to = np.r_[low, cover[1]], np.r_[cover[0], np.iinfo(np.int64).max]
    lo, hi = np.searchsorted(free_to, scope[0], "right"), np.searchsorted(free_from, scope[1], "left")
    n = np.maximum(hi - lo, 0)
    own = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    start, end = np.maximum(scope[0][own], free_from[at]), np.minimum(scope[1][own], free_to[at])
    keep = end > start
    return start[keep], end[keep]


def _gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The complement in each zone: from the first start of a block to that of the next block that has any."""
    top = np.iinfo(np.int64).max
    for b in batches:
        names = [x for x in b.schema.names if x not in ("c_starts", "c_ends", "s_starts", "s_ends", "_zone", "_next", "_reach_c", "_reach_s")]
        flat = {x: (b.column(x).flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.r_[0, np.cumsum(np.diff(b.column(x).offsets.to_numpy()))]) for x in ("c_starts", "c_ends", "s_starts", "s_ends")}
        after, reach_c, reach_s, zone = (b.column(x).to_pylist() for x in ("_next", "_reach_c", "_reach_s", "_zone"))
        codes, starts, ends = [], [], []
        for k in range(b.num_rows):
            cs, ce, ss, se = (v[o[k] : o[k + 1]] for v, o in flat.values())
            low = zone[k]
            lead = [(low, r) if r is not None and r > low else None for r in (reach_c[k], reach_s[k])]
            if not len(ss) and not lead[1]:
                continue
            s0, s1 = _united(ss, se, lead[1])
            g0, g1 = complement((s0, np.minimum(s1, top if after[k] is None else after[k])), _united(cs, ce, lead[0]), low)
            codes.append(np.full(len(g0), k))
            starts.append(g0)
            ends.append(g1)
        if codes and sum(map(len, codes)):
            code = np.concatenate(codes)
            held, code = np.unique(code, return_inverse=True)
            out = _lists(code, np.concatenate(starts), np.concatenate(ends), np.zeros(len(code), np.int64), len(held))
            yield pa.RecordBatch.from_arrays([*b.select(names).take(pa.array(held)).columns, *out], [*names, "starts", "ends", "counts"])


def _two_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = [x for x in b.schema.names if x not in ("covers", "scopes")]
        cover, scope = (_lists(*merge_sorted(*_flat(b.column(x), b.num_rows)), b.num_rows)[:2] for x in ("covers", "scopes"))
        yield pa.RecordBatch.from_arrays([*b.select(names).columns, *cover, *scope], [*names, "c_starts", "c_ends", "s_starts", "s_ends"])


def gap_lists(scope: DataFrame, cover: DataFrame, keys: list[str]) -> DataFrame:
    """States of the gaps: per key and block the stretches of *scope* in no interval of *cover*.

    Both are block states of lists, of any lanes or further keys. They merge in one node of the tree,
    which emits the scope's list less the cover's. A block's zone lasts until the next block that has
    anything; what earlier ones reach into it comes as two numbers, and gaps that go on over the end of
    a zone touch, so :func:`emitted` joins them.
    """
    state = F.struct("starts", "ends", "counts")
    both = scope.select(*keys, BLOCK, F.lit(False).alias("_c"), state.alias("_s")).unionByName(cover.select(*keys, BLOCK, F.lit(True).alias("_c"), state.alias("_s")))
    gathered = both.groupBy(*keys, BLOCK).agg(F.collect_list(F.when(F.col("_c"), F.col("_s"))).alias("covers"), F.collect_list(F.when(~F.col("_c"), F.col("_s"))).alias("scopes"))
    kinds = ", ".join(f"{x} ARRAY<BIGINT>" for x in ("c_starts", "c_ends", "s_starts", "s_ends"))
    lists = cut(gathered.mapInArrow(_two_lists, f"{_fields(gathered, [*keys, BLOCK])}, {kinds}"), "lists")
    e, ks = null_safe_keys(lists, keys)
    e = e.drop(*keys)
    a = across(ks)
    zone = F.least(F.get("c_starts", F.lit(0)), F.get("s_starts", F.lit(0)))
    ends = e.select(*ks, BLOCK, zone.alias("_zone"), F.try_element_at("c_ends", F.lit(-1)).alias("_ec"), F.try_element_at("s_ends", F.lit(-1)).alias("_es"))
    carry = ends.select(*ks, BLOCK, "_zone", F.lead("_zone").over(a).alias("_next"), F.max("_ec").over(before(a)).alias("_reach_c"), F.max("_es").over(before(a)).alias("_reach_s"))
    found = e.join(carry, [*ks, BLOCK]).mapInArrow(_gaps, f"{_fields(e, [*ks, BLOCK])}, {LISTS}")
    return found.select(*restored(keys), BLOCK, "starts", "ends", "counts")


def periods_and_gaps(turns: DataFrame, scope: DataFrame, file: str = "file_id", channel: str = "channel", speaker: str = "speaker_id", width: int | None = None) -> DataFrame:
    """Periods of every speaker and the stretches of each file and channel that no turn covers.

    Rows (kind, file, channel, speaker, start_us, end_us, n_rows): ``period`` with the number of turns
    in it; ``gap``, speaker ``''``, for stretches of the scope. The lists of speakers merge, one level
    up the tree, into the cover of a file and channel; gaps are the complement of that list within the
    list of the scope. *speaker* is expected in plain form; turns without one are ignored. Blocks are
    an hour wide, or as narrow as the densest hour asks for.
    """
    names = [file, channel]
    rows = usable(turns, speaker).select(*names, speaker, "start_us", "end_us")
    within = usable(scope).select(*names, "start_us", "end_us")
    width = counted_width(rows, names, F.col("start_us"), HOUR_US) if width is None else width
    # the lists feed two levels of the tree, so they are kept rather than made again
    by_speaker = cut(merged_lists(partial_lists(rows, [*names, speaker], width), [*names, speaker], tree_levels(rows)), "lists")
    periods = emitted(by_speaker, [*names, speaker])
    of_scope, levels = partial_lists(within, names, width), tree_levels(within)
    gaps = emitted(cut(gap_lists(merged_lists(of_scope, names, levels) if levels > 1 else of_scope, by_speaker, names), "gaps"), names)
    out = [file, channel, speaker, "start_us", "end_us", "n_rows"]
    return periods.select(F.lit("period").alias("kind"), *out).unionByName(gaps.select(F.lit("gap").alias("kind"), *names, F.lit("").alias(speaker), "start_us", "end_us", F.lit(0).cast(T.LongType()).alias("n_rows")))
