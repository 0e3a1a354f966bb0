"""Filling containers of fixed capacity: best-fit decreasing, certified by lower bounds and repacked."""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The published pre-tokenisation pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items that are packed together on average, partitions that exchange, room that is left alone, capacities at most.
PART_ITEMS, FAN, SLACK, MOST_SPECS = 50_000, 8, 0.005, 10_000


def token_counts(documents: DataFrame, doc: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and n_tokens of every whole text; null texts have none, and so have empty ones.

    The vocabulary file of the driver travels to the executors with the application.
    """
    name = os.path.basename(tokenizer)
    documents.sparkSession.sparkContext.addFile(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id BIGINT, n_tokens BIGINT")


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: largest first, each into the fullest bin that takes it.

    Open bins are kept by remaining room; a bit a room says which rooms occur, so the best fit is one
    shift and one lowest bit.
    """
    order = np.argsort(-sizes, kind="stable")
    bins = np.zeros(len(sizes), np.int64)
    rooms: dict[int, list[int]] = defaultdict(list)
    mask, n = 0, 0
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            held = rooms[room]
            b = held.pop()
            if not held:
                mask &= ~(1 << room)
        else:
            room, b, n = capacity, n, n + 1
        bins[i] = b
        left = room - s
        if left:
            rooms[left].append(b)
            mask |= 1 << left
    return bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that no packing can do without: the best of the area and dual feasible functions.

    The functions are the thresholds (items above C - t count whole, below t not at all), for every
    t up to C/2, and the rounding functions with k = 1..30 steps. Exact integers throughout.
    """
    return counted_bound(np.bincount(sizes, minlength=capacity + 1), capacity) if len(sizes) else 0


def counted_bound(counts: np.ndarray, capacity: int) -> int:
    """:func:`lower_bound` of so many items of each size from 0 to *capacity*."""
    if not counts.any():
        return 0
    count = counts.astype(object)
    value = count * np.arange(capacity + 1)
    n_upto, v_upto = np.cumsum(count), np.cumsum(value)
    best = -(-int(v_upto[-1]) // capacity)
    for t in np.flatnonzero(count[: capacity // 2 + 1]).tolist() + [capacity // 2 + 1]:
        if t == 0:
            continue
        big = int(n_upto[-1] - n_upto[capacity - t]) if t <= capacity else 0
        if capacity - t >= t - 1:
            mid = int(v_upto[capacity - t] - v_upto[t - 1])
            best = max(best, big + -(-mid // capacity))
    best = max(best, int(n_upto[-1] - n_upto[capacity // 2]))
    x = np.arange(capacity + 1)
    for k in range(1, 31):
        scaled = (k + 1) * x
        u = np.where(scaled % capacity == 0, x * k, scaled // capacity * capacity)  # in units of 1/k
        best = max(best, -(-int((count * u).sum()) // (k * capacity)))
    return best


def _pack(t: pa.Table) -> pa.Table:
    sizes = t.column("size").to_numpy().astype(np.int64)
    order = np.lexsort((t.column("copy").to_numpy(), t.column("piece").to_numpy(), t.column("doc_id").to_numpy(), -sizes))
    t, sizes = t.take(pa.array(order)), sizes[order]
    capacity = int(t.column("capacity")[0].as_py())
    bins = best_fit_decreasing(sizes, capacity)
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    n, bound = len(fill), lower_bound(sizes, capacity)
    for name, x in (("bin", bins), ("fill", fill[bins]), ("bins", np.full(len(bins), n)), ("bound", np.full(len(bins), bound))):
        t = t.set_column(t.schema.get_field_index(name), name, pa.array(x.astype(np.int64)))
    return t


def _repack(t: pa.Table) -> pa.Table:
    """Best-fit decreasing over what partitions put together, kept only where it needs fewer bins.

    Where the bins meet the bound of what is in them nothing can be saved and nothing is packed again.
    Else each bin stays as it was, under a number of its own in the joint partition.
    """
    pair = np.stack([t.column("part_was").to_numpy(), t.column("bin").to_numpy()])
    _, old = np.unique(pair, axis=1, return_inverse=True)
    old = old.ravel()
    n, bound = int(old.max()) + 1, lower_bound(t.column("size").to_numpy().astype(np.int64), int(t.column("capacity")[0].as_py()))
    if n > bound:
        new = _pack(t)
        if new.column("bins")[0].as_py() < n:
            return new
    for name, x in (("bin", old), ("bins", np.full(t.num_rows, n)), ("bound", np.full(t.num_rows, bound))):
        t = t.set_column(t.schema.get_field_index(name), name, pa.array(x.astype(np.int64)))
    return t


_COLS = "spec_id INT, capacity INT, part BIGINT, part_was BIGINT, round INT, doc_id BIGINT, piece INT, copy INT, size BIGINT, bin BIGINT, fill BIGINT, bins BIGINT, bound BIGINT"
_OUT = ("spec_id", "capacity", "doc_id", "piece", "copy", "size", "container", "fill", "bins", "bound")


def packed(documents: DataFrame, specs: DataFrame, doc: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, part_items: int = PART_ITEMS, fan: int = FAN, slack: float = SLACK) -> DataFrame:
    """Containers of every capacity of *specs* (spec_id, capacity_tokens) filled with whole texts.

    Method: bound-certified repacking. Texts are counted in tokens once. One longer than a container
    is cut into full containers and a rest, nothing else is. Items are spread by hash over partitions,
    *fan* at least and more than *part_items* in none on average, and packed best-fit decreasing; dual
    feasible functions give a lower bound that certifies a partition where its bins meet it: alone it can do no
    better. Partitions exchange the documents of their bins with more than *slack* of room: *fan*
    partitions put them together and, unless their bins meet the bound of what they hold together,
    best-fit decreasing is run again, kept where it needs fewer bins; then over ever more partitions,
    until all that is open has met. What meets is spread, bin by bin, over as
    many exchanges as *part_items* asks for; exchanges of the last round go on, mixed anew, as long as
    a round saves bins. A partition that meets no other is carried on to the next round.

    Returns spec_id, capacity, doc_id, piece, copy (of a repeated document), size, container (a key
    unique in its spec), fill, and the bins and lower bound of the partition it was closed in: where
    they are equal, no packing of that partition's items needs fewer.

    Defined cases: null and empty texts have no tokens and stand in no container; equal sizes are
    ordered by doc_id and piece; no documents give no containers; capacities that are null or not
    positive are left out, and of one spec_id the greatest capacity counts; more than 10,000 specs are
    an error; repeated rows of a document are items each.
    """
    named = specs.select(F.col("spec_id").cast("int").alias("s"), F.col("capacity_tokens").cast("int").alias("c")).where("s IS NOT NULL AND c > 0").groupBy("s").agg(F.max("c").alias("c"))
    held = named.limit(MOST_SPECS + 1).collect()
    if len(held) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} capacities")
    copies = Window.partitionBy("doc_id", "n_tokens").orderBy("n_tokens")
    counts = cut(token_counts(documents, doc, text, tokenizer).where("n_tokens > 0").withColumn("copy", F.row_number().over(copies)), "tokens")
    parts = max(fan, -(-counts.count() // part_items))
    wanted = [F.struct(F.lit(r.s).alias("spec_id"), F.lit(r.c).alias("capacity")) for r in sorted(held)]
    each = F.explode(F.array(*wanted) if wanted else F.array().cast("array<struct<spec_id:int,capacity:int>>"))
    items = counts.select(each.alias("_s"), "doc_id", "n_tokens", "copy").select("_s.*", "doc_id", "n_tokens", "copy").withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("int")))
    ).withColumn("size", F.least(F.col("capacity").cast("bigint"), F.col("n_tokens") - F.col("piece").cast("bigint") * F.col("capacity")))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    full = items.where("size = capacity").select("spec_id", "capacity", "doc_id", "piece", "copy", "size", F.concat_ws("-", F.lit("full"), "doc_id", "piece", "copy").alias("container"), F.col("size").alias("fill"), one.alias("bins"), one.alias("bound"))
    loose = items.where("size < capacity").select(
        "spec_id", "capacity", F.pmod(F.xxhash64("doc_id", "piece", "copy"), F.lit(parts)).alias("part"), zero.alias("part_was"), F.lit(0).alias("round"), "doc_id", "piece", "copy", "size", zero.alias("bin"), zero.alias("fill"), zero.alias("bins"), zero.alias("bound")
    )
    now = cut(loose.groupBy("spec_id", "part").applyInArrow(_pack, _COLS), "packed")
    # a certificate is the partition's own: what room it has left may still be filled from another
    open_ = F.col("capacity") - F.col("fill") > F.lit(slack) * F.col("capacity")
    done, n, spread, step, last = [], parts, 1, 0, None
    while True:
        step += 1
        rows, bins = now.where(open_).agg(F.count("*"), F.count_distinct("spec_id", "part", "bin")).first()
        if not rows or (last is not None and bins >= last):
            break
        last = bins if n == 1 else None  # all has met: only what saves bins goes on
        group = F.floor(F.col("part") / (spread * fan))
        n = -(-n // fan)
        spread = max(1, -(-rows // (part_items * n * max(1, len(held)))))
        part = group * spread + F.pmod(F.xxhash64("part", "bin", F.lit(step)), F.lit(spread))
        again = now.where(open_).select("spec_id", "capacity", part.cast("bigint").alias("part"), F.col("part").alias("part_was"), F.lit(step).alias("round"), "doc_id", "piece", "copy", "size", "bin", "fill", "bins", "bound")
        done.append(now.where(~open_))
        now = cut(again.groupBy("spec_id", "part").applyInArrow(_repack, _COLS), "packed")
        if n == 1 and spread == 1:
            break
    out = reduce(DataFrame.unionByName, [now, *done])
    out = out.select("spec_id", "capacity", "doc_id", "piece", "copy", "size", F.concat_ws("-", "round", "part", "bin").alias("container"), "fill", "bins", "bound")
    return out.unionByName(full).select(*_OUT)


def packing_report(rows: DataFrame) -> DataFrame:
    """Containers, tokens and unused room per capacity, beside containers that no packing does without.

    The bound is the best of the area and the dual feasible functions over the sizes of all pieces; a
    capacity has at most as many different sizes as tokens, and only their counts meet.
    """
    sizes = rows.groupBy("spec_id", "capacity", "size").agg(F.count("*").alias("n"))

    def bound(t: pa.Table) -> pa.Table:
        capacity = int(t.column("capacity")[0].as_py())
        counts = np.zeros(capacity + 1, np.int64)
        counts[t.column("size").to_numpy()] = t.column("n").to_numpy()
        return pa.table({"spec_id": t.column("spec_id").slice(0, 1), "bound": pa.array([counted_bound(counts, capacity)], pa.int64())})

    bounds = sizes.groupBy("spec_id").applyInArrow(bound, "spec_id INT, bound BIGINT")
    bins = rows.groupBy("spec_id", "capacity", "container").agg(F.sum("size").alias("used"), F.count("*").alias("n"))
    totals = bins.groupBy("spec_id", "capacity").agg(
        F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.round(1 - F.sum("used") / (F.count("*") * F.col("capacity")), 9).alias("unused_share")
    )
    return totals.join(bounds, "spec_id").withColumn("certified", F.col("n_containers") == F.col("bound"))


def packing_checks(rows: DataFrame, documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """What must hold of every packing, per capacity: spec_id, capacity, n_texts (rows with text that stand
    in containers), n_lost, n_overfull, n_parted (texts cut though they fit a container), n_misfilled
    (containers whose stated fill is not what is in them)."""
    bins = rows.groupBy("spec_id", "capacity", "container").agg(F.sum("size").alias("used"), F.min("fill").alias("low"), F.max("fill").alias("high"))
    of_bins = bins.groupBy("spec_id", "capacity").agg(F.count(F.when(F.col("used") > F.col("capacity"), 1)).alias("n_overfull"), F.count(F.when((F.col("low") != F.col("used")) | (F.col("high") != F.col("used")), 1)).alias("n_misfilled"))
    # a text of more than one piece fills a container with each but the last
    texts = rows.groupBy("spec_id", "doc_id", "copy", "capacity").agg(F.count("*").alias("p"), F.count(F.when(F.col("size") == F.col("capacity"), 1)).alias("f"), F.max("piece").alias("last"), F.sum("size").alias("n"))
    wrong = (F.col("p") != F.col("last") + 1) | (F.col("f") < F.col("p") - 1) | ((F.col("p") > 1) & (F.col("n") <= F.col("capacity")))
    of_texts = texts.groupBy("spec_id", "capacity").agg(F.count("*").alias("n_texts"), F.count(F.when(wrong, 1)).alias("n_parted"))
    whole = documents.where(F.length(text) > 0).agg(F.count("*").alias("_all"))
    return of_texts.join(of_bins, ["spec_id", "capacity"]).join(F.broadcast(whole)).select("spec_id", "capacity", "n_texts", (F.col("_all") - F.col("n_texts")).alias("n_lost"), "n_overfull", "n_parted", "n_misfilled")
