"""Long exact spans shared between records: a sparse De Bruijn graph of the texts' own k-mers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.texthash import Rolling, U, chunks, code_points, mix
from chronoloom.session import counted_cut, cut, drop

LEAST, KMER, HOT = 320, 96, 4096
#: Parts into which the occurrences of a hot k-mer or edge are split where they are joined.
SALTS = 8


def _anchored(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int, k: int) -> dict[str, np.ndarray]:
    """The edges of texts laid end to end.

    Each window of *least* characters is owned by its smallest k-mer, the leftmost of equals, so the
    owner depends on nothing but the window. Windows of one owner are consecutive: together they are
    an edge, the text from the first window's start to the last one's end.
    """
    w = least - k + 1
    one, two = Rolling(points, 0), Rolling(points, 1)
    h = one.every(k)
    bits = U(32)  # the same for all calls: ties of the upper half go to the leftmost k-mer
    key = ((h >> bits) << bits) | np.arange(len(h), dtype=U)
    full = np.full(-(-len(key) // w) * w + w, ~U(0))
    full[: len(key)] = key
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(points) - least + 1
    owner = (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & ((U(1) << bits) - U(1))).astype(np.int64)
    # places where a window lies inside one text
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.minimum(starts + sizes - least + 1, n), -1)
    at = np.flatnonzero(np.cumsum(inside)[:n] > 0)
    own = owner[at]
    fresh = np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(fresh)
    last = np.r_[first[1:], len(at)] - 1
    p1, p2, s = at[first], at[last], own[first]
    lead, span = s - p1, p2 - p1
    seg = mix(two.slices(p1, p2 + least) + (lead.astype(U) << U(32)) + span.astype(U))
    doc = np.searchsorted(starts, p1, "right") - 1
    return {"doc": doc, "seed": h[s], "seg": seg, "at": p1 - starts[doc], "lead": lead, "span": span}


def _edges(least: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = ((i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t is not None and len(t) >= least)
            for held in chunks(rows, 1):
                sizes = np.array([len(t) for _, t in held], np.int64)
                starts = np.r_[0, np.cumsum(sizes)[:-1]]
                e = _anchored(code_points([t for _, t in held]), starts, sizes, least, k)
                ident = mix(e["seed"] ^ (e["seg"] * U(3))).view(np.int64)
                after = np.r_[np.where(e["doc"][1:] == e["doc"][:-1], ident[1:], 0), 0]
                ids = np.array([i for i, _ in held], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (e["seed"].view(np.int64), e["seg"].view(np.int64), ident, after, ids[e["doc"]], e["at"], e["lead"].astype(np.int32), e["span"].astype(np.int32))],
                    ["seed", "seg", "edge", "after", "doc_id", "at", "lead", "span"],
                )

    return run


def _windows(seeds: np.ndarray, texts: list[str], spans: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, edge and offset of every window of the edges; equal keys mean equal text and k-mer."""
    points = code_points(texts)
    starts = np.r_[0, np.cumsum(spans + least)[:-1]]
    edge = np.repeat(np.arange(len(texts)), spans + 1)
    offset = np.arange(len(edge)) - np.repeat(np.r_[0, np.cumsum(spans + 1)[:-1]], spans + 1)
    h = Rolling(points, 1).every(least)[starts[edge] + offset]
    return mix(h ^ mix(seeds.view(U)[edge])), edge, offset


def _runs(edge: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive offsets of an edge as (edge, first, last)."""
    fresh = np.r_[True, (edge[1:] != edge[:-1]) | (offset[1:] != offset[:-1] + 1)] if len(edge) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    return edge[first], offset[first], offset[np.r_[first[1:], len(edge)] - 1] if len(first) else offset[:0]


def _compare(t: pa.Table, least: int) -> pa.RecordBatch:
    """Windows of single-record edges that another record's edge of the same k-mer has too."""
    doc = t.column("doc_id").to_numpy()
    everywhere = t.column("common").to_numpy(zero_copy_only=False)
    lead, span = t.column("lead").to_numpy().astype(np.int64), t.column("span").to_numpy().astype(np.int64)
    key, edge, offset = _windows(t.column("seed").to_numpy().astype(np.int64), t.column("body").to_pylist(), span, least)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
    d = doc[edge[order]]
    shared = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    shared |= np.maximum.reduceat(everywhere[edge[order]].astype(np.int8), first) > 0
    hit = np.zeros(len(key), bool)
    hit[order] = np.repeat(shared, np.diff(np.r_[first, len(key)]))
    hit &= ~everywhere[edge]
    e, a, z = _runs(edge[hit], offset[hit])
    take = pa.array(e)
    return pa.RecordBatch.from_arrays([t.column("doc_id").take(take).combine_chunks(), t.column("places").take(take).combine_chunks(), pa.array(a.astype(np.int64)), pa.array((z + least).astype(np.int64))], ["doc_id", "places", "low", "high"])


def _compared(least: int, most: int = 1500):
    """Partitions sorted by k-mer, compared piece by piece; a k-mer's edges are never parted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows > most:
                seeds = held.column("seed").to_numpy()
                upto = int(np.searchsorted(seeds, seeds[most], "left")) or int(np.searchsorted(seeds, seeds[0], "right"))
                if upto >= held.num_rows:
                    break
                yield _compare(held.slice(0, upto), least)
                held = held.slice(upto)
        if held is not None and held.num_rows:
            yield _compare(held, least)

    return run


def _exploded(least: int):
    """Every window of an edge as a row, for k-mers with too many different edges to meet in one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                t = b.slice(lo, 200)
                key, edge, offset = _windows(t.column("seed").to_numpy().astype(np.int64), t.column("body").to_pylist(), t.column("span").to_numpy().astype(np.int64), least)
                take = pa.array(edge)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), t.column("seed").take(take), t.column("seg").take(take), t.column("doc_id").take(take), t.column("common").take(take), pa.array(offset.astype(np.int64))], ["key", "seed", "seg", "doc_id", "common", "offset"])

    return run


def graph_edges(documents: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST, k: int = KMER) -> DataFrame:
    """Occurrences of edges: seed (k-mer), seg (content), edge (both), after (edge that follows in the record,
    0: none), doc_id, at (character), lead (from there to the k-mer), span (windows less one)."""
    if not 0 < k <= least:
        raise ValueError("a k-mer must fit a window")
    kinds = "seed BIGINT, seg BIGINT, edge BIGINT, after BIGINT, doc_id BIGINT, at BIGINT, lead INT, span INT"
    return documents.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") >= least).mapInArrow(_edges(least, k), kinds)


def _salted(many: DataFrame, few: DataFrame, keys: list[str], by: str, how: str = "inner") -> DataFrame:
    """Join of hot keys: rows of *many* are spread by *by*, the one row a key of *few* stands in each part."""
    left = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    right = few.withColumn("_salt", F.explode(F.array(*[F.lit(x).cast("bigint") for x in range(SALTS)])))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def repeated_seeds(edges: DataFrame) -> DataFrame:
    """Occurrences of edges whose k-mer is in two or more records: most occurrences are not.

    The k-mers are counted by the least and greatest record alone, combined before the shuffle.
    """
    seeds = edges.groupBy("seed").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b").select("seed")
    return _salted(edges, seeds, ["seed"], "doc_id", "left_semi")


def distinct_edges(edges: DataFrame, hot: int = HOT) -> DataFrame:
    """One row an edge: seed, seg, edge, lead, span, n (occurrences), rep (one of them: doc_id, at), next,
    common, alone, crowded.

    ``next``: the edge that follows all of its occurrences, if it is one. ``common``: it is in two
    records. ``alone``: no other edge has its k-mer. ``crowded``: more than *hot* have.
    """
    segs = edges.groupBy("seed", "seg", "edge", "lead", "span").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "at")).alias("rep"), F.max("doc_id").alias("_d"), F.min("after").alias("_a"), F.max("after").alias("_z")
    )
    seeds = segs.groupBy("seed").agg(F.count("*").alias("_n"))
    follows = F.when((F.col("_a") == F.col("_z")) & (F.col("_a") != 0), F.col("_a"))
    return _salted(segs, seeds, ["seed"], "seg").select(
        "seed", "seg", "edge", "lead", "span", "n", "rep", follows.alias("next"), (F.col("rep.doc_id") < F.col("_d")).alias("common"), F.expr("_n = 1").alias("alone"), (F.col("_n") > hot).alias("crowded")
    )


def compact_paths(common: DataFrame, least: int = LEAST) -> DataFrame:
    """Nonbranching paths of *common* (edge, next, n, span): edge (the first), n_edges, size in characters.

    An edge continues another where all occurrences of the one are followed by it and it has no others:
    both occur equally often. Each edge points to the one before it; pointers are joined to the pointers
    they point to until none moves, so a path takes the logarithm of its edges in rounds.
    """
    ahead = common.select(F.col("edge").alias("next"), F.col("n").alias("_n"))
    back = common.where("next IS NOT NULL").join(ahead, "next").where("n = _n AND edge <> next")
    now = cut(back.select(F.col("next").alias("edge"), F.col("edge").alias("head"), (F.col("span").cast("bigint") + 1).alias("off"), F.lit(1).cast("bigint").alias("place")), "pointers")
    moved = 1
    while moved:
        far = now.select(F.col("edge").alias("head"), F.col("head").alias("_h"), F.col("off").alias("_o"), F.col("place").alias("_p"))
        step = now.join(far, "head", "left").select("edge", F.coalesce("_h", "head").alias("head"), (F.col("off") + F.coalesce("_o", F.lit(0))).alias("off"), (F.col("place") + F.coalesce("_p", F.lit(0))).alias("place"), F.col("_h").isNotNull().alias("moved"))
        after, seen = counted_cut(step, "pointers", F.count(F.when(F.col("moved"), 1)).alias("n"))
        drop(now)
        now, moved = after.drop("moved"), seen["n"]
        now._cut_path = after._cut_path  # type: ignore[attr-defined]
    placed = common.join(now, "edge", "left").select(F.coalesce("head", "edge").alias("edge"), (F.coalesce("off", F.lit(0)) + F.col("span") + least).alias("_end"), (F.coalesce("place", F.lit(0)) + 1).alias("_place"))
    return placed.groupBy("edge").agg(F.max("_place").alias("n_edges"), F.max("_end").alias("size"))


def verified_paths(documents: DataFrame, edges: DataFrame, segs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Occurrences of the compacted paths, as far as their texts, read at the source, agree in two records.

    Returns path, n_edges, doc_id, low, high. For use on its own; :func:`shared_stretches` reads the
    texts of paths and edges at once.
    """
    asked = _path_places(edges, segs, least)
    source = documents.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") >= least)
    return _agreed(asked.join(source, "doc_id").select("path", "n_edges", "doc_id", "low", "size", _digest(F.col("low"), F.col("size")).alias("digest")))


def _path_places(edges: DataFrame, segs: DataFrame, least: int) -> DataFrame:
    """Where the first edges of the paths occur: path, n_edges, doc_id, low, size."""
    paths = compact_paths(segs.where("common").select("edge", "next", "n", "span"), least)
    return _salted(edges.select("edge", "doc_id", "at"), paths, ["edge"], "doc_id").select(F.col("edge").alias("path"), "n_edges", "doc_id", F.col("at").alias("low"), "size")


def _piece(low: Column, size: Column) -> Column:
    return F.substring(F.col("text"), (low + 1).cast("int"), size.cast("int"))


def _digest(low: Column, size: Column) -> Column:
    return F.md5(_piece(low, size).cast("binary"))


def _agreed(read: DataFrame) -> DataFrame:
    """Of the occurrences of each path those whose text is also that of another record."""
    same = read.groupBy("path", "digest").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b").select("path", "digest")
    return _salted(read, same, ["path", "digest"], "doc_id").select("path", "n_edges", "doc_id", "low", (F.col("low") + F.col("size")).alias("high"))


def shared_graph(documents: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST, k: int = KMER, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The occurrences of edges with a repeated k-mer, and the distinct edges; both as tables."""
    all_edges = cut(graph_edges(documents, doc, text, least, k), "edges")
    edges = cut(repeated_seeds(all_edges), "repeated")
    drop(all_edges)
    return edges, cut(distinct_edges(edges, hot), "distinct")


def shared_stretches(documents: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST, k: int = KMER, hot: int = HOT) -> DataFrame:
    """Stretches of each record that stand verbatim in another: doc_id, start_char, end_char.

    A stretch is a union of overlapping or touching windows of *least* characters, each of which is,
    as a whole, in some one other record. Exact: no window is missed and none is chained together
    from several records.

    Method: De Bruijn compaction. Tokens are characters; of the k-mers only those that are smallest
    in some window become nodes, and the text owned by such a k-mer is its edge (a sparse graph with
    one edge in about (least-k)/2 characters). Edges are counted by k-mer and content; those whose
    k-mer is in two records stay. Edges of two records that follow each other without branching are
    compacted by joins into paths; where a path begins in a record it runs to its end, so a record
    has one row a path, whose text is read at the source coordinates and must agree in two records.
    Edges that only one record has may share a part: their text is read too and verified window by
    window against the other edges of the k-mer, linear in their number. A k-mer with more than
    *hot* different edges is verified as windows spread by content instead, so it meets in no one
    task. Occurrences of hot k-mers and paths are salted where they are joined; copies cost one row a
    path and no pair of records is formed.

    Defined cases: null and empty texts and such below *least* characters share nothing; repeats
    within one record alone do not count; two rows of one doc_id are one record; offsets are in
    Unicode characters; ties between equal k-mers go to the leftmost; other columns are not read.
    """
    edges, segs = shared_graph(documents, doc, text, least, k, hot)
    known = ["seed", "seg", "common", "crowded", "lead", "span"]
    part = segs.where("NOT alone")
    at_rep = part.select(*known, F.col("rep.doc_id").alias("doc_id"), F.col("rep.at").alias("low"), F.when(~F.col("common"), F.when(F.col("n") == 1, F.array("rep.at"))).alias("places"), "n")
    # an edge that one record alone has several times
    again = edges.join(part.where("NOT common AND n > 1").select("seed", "seg"), ["seed", "seg"], "left_semi").groupBy("seed", "seg").agg(F.collect_list("at").alias("_p"))
    parts = at_rep.join(again, ["seed", "seg"], "left").select(*known, "doc_id", "low", F.coalesce("places", "_p", F.array().cast("array<bigint>")).alias("places"))
    nothing = lambda kind: F.lit(None).cast(kind)
    asked = parts.select(nothing("bigint").alias("path"), nothing("bigint").alias("n_edges"), "doc_id", "low", (F.col("span") + least).cast("bigint").alias("size"), *known, "places").unionByName(_path_places(edges, segs, least), allowMissingColumns=True)
    source = documents.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.length("text") >= least)
    low, size, is_path = F.col("low"), F.col("size"), F.col("path").isNotNull()
    read = cut(asked.join(source, "doc_id").select(*asked.columns, F.when(~is_path, _piece(low, size)).alias("body"), F.when(is_path, _digest(low, size)).alias("digest")), "read")
    paths = _agreed(read.where(is_path)).select("doc_id", "low", "high")

    bodies = read.where(~is_path)
    few = bodies.where("NOT crowded").select("seed", "common", "doc_id", "places", "lead", "span", "body").repartition("seed").sortWithinPartitions("seed")
    verified = few.mapInArrow(_compared(least), "doc_id BIGINT, places ARRAY<BIGINT>, low BIGINT, high BIGINT")
    verified = verified.select("doc_id", F.explode("places").alias("p"), "low", "high").select("doc_id", (F.col("p") + F.col("low")).alias("low"), (F.col("p") + F.col("high")).alias("high"))

    many = bodies.where("crowded").select("seed", "seg", "common", "doc_id", "span", "body").mapInArrow(_exploded(least), "key BIGINT, seed BIGINT, seg BIGINT, doc_id BIGINT, common BOOLEAN, offset BIGINT")
    equal = many.groupBy("key").agg(F.min("doc_id").alias("d1"), F.max("doc_id").alias("d2"), F.max("common").alias("any")).where("d1 < d2 OR any").select("key")
    wide = (
        _salted(many.where("NOT common"), equal, ["key"], "doc_id").select("seed", "seg", "offset")
        .join(bodies.where("crowded AND NOT common").select("seed", "seg", "doc_id", F.explode("places").alias("p")), ["seed", "seg"])
        .select("doc_id", (F.col("p") + F.col("offset")).alias("low"), (F.col("p") + F.col("offset") + least).alias("high"))
    )
    return merged_stretches(reduce(DataFrame.unionByName, [paths, verified, wide]))


def merged_stretches(intervals: DataFrame) -> DataFrame:
    """Overlapping and touching intervals of a record merge; a record's are bounded by its length."""
    w = Window.partitionBy("doc_id").orderBy("low", "high")
    reach = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("low") <= F.col("_reach"), 0).otherwise(1)).over(w)
    return intervals.withColumn("_reach", reach).withColumn("_r", run).groupBy("doc_id", "_r").agg(F.min("low").alias("start_char"), F.max("high").alias("end_char")).select("doc_id", "start_char", "end_char")


def shared_share(documents: DataFrame, stretches: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """For each record: characters, stretches, shared characters and their share of the text."""
    sums = stretches.groupBy("doc_id").agg(F.count("*").alias("n_stretches"), F.sum(F.col("end_char") - F.col("start_char")).alias("shared_chars"))
    sized = documents.select(F.col(doc).cast("bigint").alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("text_chars"))
    return sized.join(sums, "doc_id", "left").select(
        "doc_id", "text_chars", F.coalesce("n_stretches", F.lit(0)).alias("n_stretches"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.round(F.coalesce(F.try_divide("shared_chars", "text_chars"), F.lit(0.0)), 9).alias("share")
    )
