"""Vector analytics: cosine neighbours, centroids, propagation, conformal ranks, two clusters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.blocked import BLOCK, across, before, block_of, inside, upto
from chronoloom.session import counted_cut, cut, drop


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """L2-normalised; a zero vector stays as it is."""
    d = v.cast("array<double>")
    norm = F.sqrt(dot(d, d))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


def weighted_centroids(rows: DataFrame, keys: list[str], vector: str, weight: str) -> DataFrame:
    """Unit resultant of weighted vectors per key; sums by dimension, combined before the shuffle."""
    long = rows.select(*keys, F.col(weight).alias("_w"), F.posexplode(F.col(vector).cast("array<double>")).alias("_d", "_x"))
    sums = long.groupBy(*keys, "_d").agg(F.sum(F.col("_w") * F.col("_x")).alias("_s"))
    return sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_d", "_s"))).alias("_v")).select(*keys, unit(F.transform("_v", lambda x: x["_s"])).alias("centroid"))


def nearest_neighbours(queries: DataFrame, rows: DataFrame, k: int, vector: str = "embedding", row: str = "vec_id", block_rows: int = 2_000) -> DataFrame:
    """The *k* rows nearest to each query by cosine distance (rounded to 6 places, ties by id), itself left out.

    Exact: a stated query set against all rows. The queries are taken in blocks of about *block_rows*,
    each block broadcast as one matrix while every partition of the rows keeps its own best *k*; those,
    k a query and partition, are ranked after one shuffle. Of several blocks each is written and its
    matrix destroyed before the next is collected. For all rows as queries use
    :func:`indexed_neighbours`.
    """
    spark = rows.sparkSession
    total = queries.count()
    blocks = max(1, -(-total // block_rows))
    base = rows.select(F.col(row).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    asked = queries.select(F.col(row).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    parts = []
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toPandas()
        if block.empty:
            continue
        q = np.stack(block["v"].to_numpy())
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = spark.sparkContext.broadcast((block["id"].to_numpy(), q))

        def best(batches, shared=shared):  # noqa: ANN001, ANN202
            ids, qm = shared.value
            held_id, held_d = None, None
            for t in batches:
                x = np.asarray(t.column("v").flatten().to_numpy()).reshape(t.num_rows, -1)
                x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
                own = t.column("id").to_numpy()
                d = np.round(1 - qm @ x.T, 6)
                d[ids[:, None] == own[None, :]] = np.inf
                i = np.broadcast_to(own, d.shape)
                if held_id is not None:
                    d, i = np.hstack([held_d, d]), np.hstack([held_id, i])
                order = np.lexsort((i, d), axis=1)[:, :k]
                held_d, held_id = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)
            if held_id is not None:
                n = held_id.shape[1]
                keep = np.isfinite(held_d).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)[keep]), pa.array(held_id.ravel()[keep]), pa.array(held_d.ravel()[keep])], ["query_id", "id", "distance"])

        found = base.mapInArrow(best, "query_id BIGINT, id BIGINT, distance DOUBLE")
        if blocks > 1:
            found = cut(found, "neighbours")
            shared.destroy()
        parts.append(found)
    if not parts:
        return spark.createDataFrame([], "query_id BIGINT, rank INT, id BIGINT, distance DOUBLE")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


#: Rows an index is fitted on at most, cells at most, members of a cell that one task compares, queries beside them.
SAMPLE_ROWS, MOST_CELLS, CELL_ROWS, CELL_QUERIES = 20_000, 4_096, 1_000, 20_000


def _unit_rows(column: pa.Array, n: int) -> np.ndarray:
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fitted_cells(rows: DataFrame, vector: str = "embedding", row: str = "vec_id", rounds: int = 12) -> np.ndarray:
    """Unit centres of the cells of an index: spherical k-means over a bounded sample.

    The sample is the :data:`SAMPLE_ROWS` rows whose ids hash lowest, so it is the same on any cluster.
    There is a cell for about :data:`CELL_ROWS` / 4 rows of the table, within :data:`MOST_CELLS`.
    """
    base = rows.select(F.col(row).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    n = base.count()
    taken = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toPandas()
    if taken.empty:
        return np.zeros((0, 0))
    x = np.stack(taken["v"].to_numpy())
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    k = max(1, min(MOST_CELLS, len(x), 4 * -(-n // CELL_ROWS)))
    centres = x[:k].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        after = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
        if np.allclose(after, centres):
            break
        centres = after
    return centres


def indexed_neighbours(queries: DataFrame, rows: DataFrame, k: int, vector: str = "embedding", row: str = "vec_id", probes: int = 8, centres: np.ndarray | None = None) -> DataFrame:
    """The *k* rows nearest to each query among those of the *probes* cells nearest to it: query_id, rank, id, distance.

    An inverted file: every row stands in the cell of its nearest centre (:func:`fitted_cells`, broadcast,
    bounded), every query visits several cells, and only what meets in a cell is compared. Cells with
    many members or queries are split by hash into pieces of at most about :data:`CELL_ROWS` members and
    :data:`CELL_QUERIES` queries, so a hot cell is many tasks and nothing is left out. Approximate:
    neighbours in cells not visited are missed; with as many probes as cells it is exact. Distances are
    rounded to 6 places, ties by id, a row is not its own neighbour; null vectors are left out.
    """
    spark = rows.sparkSession
    kinds = "query_id BIGINT, rank INT, id BIGINT, distance DOUBLE"
    centres = fitted_cells(rows, vector, row) if centres is None else centres
    if not len(centres):
        return spark.createDataFrame([], kinds)
    shared = spark.sparkContext.broadcast(centres)
    probes = min(probes, len(centres))

    def placed(n: int):  # noqa: ANN202
        def run(batches):  # noqa: ANN001, ANN202
            for b in batches:
                if b.num_rows:
                    near = np.argsort(-(_unit_rows(b.column("v"), b.num_rows) @ shared.value.T), axis=1, kind="stable")[:, :n].astype(np.int32)
                    take = pa.array(np.repeat(np.arange(b.num_rows), n))
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), b.column("id").take(take), b.column("v").take(take)], ["cell", "id", "v"])

        return run

    base = lambda df: df.select(F.col(row).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    members = cut(base(rows).mapInArrow(placed(1), "cell INT, id BIGINT, v ARRAY<DOUBLE>"), "cells")
    asked = cut(base(queries).mapInArrow(placed(probes), "cell INT, id BIGINT, v ARRAY<DOUBLE>"), "asked")
    pieces = lambda df, most, name: df.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    plan = pieces(members, CELL_ROWS, "_m").join(pieces(asked, CELL_QUERIES, "_q"), "cell")  # a row a cell
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = members.join(F.broadcast(plan), "cell").select("cell", part("_m").alias("m"), each("_q").alias("q"), F.lit(False).alias("asks"), "id", "v")
    right = asked.join(F.broadcast(plan), "cell").select("cell", each("_m").alias("m"), part("_q").alias("q"), F.lit(True).alias("asks"), "id", "v")

    def compare(t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy(zero_copy_only=False)
        ids = t.column("id").to_numpy()
        x = _unit_rows(t.column("v").combine_chunks(), t.num_rows)
        own, out = ids[~asks], []
        for lo in range(0, int(asks.sum()), 500):
            who = ids[asks][lo : lo + 500]
            d = np.round(1 - x[asks][lo : lo + 500] @ x[~asks].T, 6)
            d[who[:, None] == own[None, :]] = np.inf
            order = np.lexsort((np.broadcast_to(own, d.shape), d), axis=1)[:, :k]
            dist = np.take_along_axis(d, order, 1)
            keep = np.isfinite(dist).ravel()
            out.append(pa.table({"query_id": np.repeat(who, order.shape[1])[keep], "id": own[order].ravel()[keep], "distance": dist.ravel()[keep]}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})

    found = left.unionByName(right).groupBy("cell", "m", "q").applyInArrow(compare, "query_id BIGINT, id BIGINT, distance DOUBLE")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def neighbour_recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """Share of the exact neighbours that were found: n_queries, n_exact, n_found, recall (1 where there are none)."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("_h")), ["query_id", "id"], "left")
    return hit.agg(F.countDistinct("query_id").alias("n_queries"), F.count("*").alias("n_exact"), F.count("_h").alias("n_found"), F.round(F.coalesce(F.try_divide(F.count("_h").cast("double"), F.count("*").cast("double")), F.lit(1.0)), 9).alias("recall"))


def mutual_neighbours(neighbours: DataFrame) -> DataFrame:
    """Edges a < b where each is among the other's neighbours."""
    a = neighbours.select(F.col("query_id").alias("a"), F.col("id").alias("b"), "distance")
    return a.join(neighbours.select(F.col("query_id").alias("b"), F.col("id").alias("a")), ["a", "b"]).where("a < b")


def propagated_labels(edges: DataFrame, seeds: DataFrame, steps: int = 3) -> DataFrame:
    """Clamped label propagation: (id, label, score, margin) of every node that a seed reaches.

    *edges* (a, b, weight) are undirected, *seeds* (id, label) keep their label. Each step is one join
    and one aggregate over (node, label); lineage is cut by tables in the shared folder.
    """
    both = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    clamped = seeds.select("id", "label", F.lit(1.0).alias("score"))
    now = cut(clamped, "labels")
    for _ in range(steps):
        sent = now.join(both, now.id == both.a).groupBy(F.col("b").alias("id"), "label").agg(F.sum(F.col("score") * F.col("weight")).alias("score"))
        fresh = sent.join(seeds.select("id"), "id", "left_anti")
        norm = fresh.groupBy("id").agg(F.sum("score").alias("_n"))
        after = cut(fresh.join(norm, "id").select("id", "label", (F.col("score") / F.col("_n")).alias("score")).unionByName(clamped), "labels")
        drop(now)
        now = after
    w = Window.partitionBy("id").orderBy(F.desc("score"), "label")
    ranked = now.withColumn("score", F.round("score", 9)).withColumn("_r", F.row_number().over(w)).withColumn("_s", F.coalesce(F.lead("score").over(w), F.lit(0.0)))
    return ranked.where("_r = 1").select("id", "label", "score", F.round(F.col("score") - F.col("_s"), 9).alias("margin"))


def nearest_centroid(rows: DataFrame, centroids: DataFrame, vector: str, row: str, most: int = 1_000) -> DataFrame:
    """Nearest centroid of each row, its distance and the margin to the next; ties by label.

    *centroids* (label, centroid) are taken as one array where there are *most* at most, and compared
    where the row lives, without a shuffle; more are taken in blocks of about *most*, and the two best of
    each block are compared again.
    """
    c = centroids.where("centroid IS NOT NULL").select("label", "centroid")
    blocks = max(1, -(-c.count() // most))
    own = rows.select(F.col(row).alias("id"), unit(F.col(vector)).alias("_v"))

    def two_best(cs: DataFrame) -> DataFrame:
        held = F.broadcast(cs.agg(F.collect_list(F.struct("label", "centroid")).alias("_c")))  # one row, bounded
        near = F.slice(F.array_sort(F.transform("_c", lambda x: F.struct(F.round(1 - dot(F.col("_v"), x["centroid"]), 6).alias("d"), x["label"].alias("label")))), 1, 2)
        return own.join(held).select("id", near.alias("_l"))

    if blocks == 1:
        listed = two_best(c)
    else:
        parts = [two_best(c.where(F.pmod(F.xxhash64("label"), F.lit(blocks)) == b)) for b in range(blocks)]
        listed = reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_l"))), 1, 2).alias("_l"))
    first, second = F.get("_l", F.lit(0)), F.get("_l", F.lit(1))
    return listed.where(F.size("_l") > 0).select("id", first["label"].alias("label"), first["d"].alias("distance"), F.round(second["d"] - first["d"], 6).alias("margin"))


def conformal_labels(calibration: DataFrame, candidates: DataFrame, epsilon: float, width: float) -> DataFrame:
    """p = (1 + calibration scores at or over the candidate's) / (n + 1) per class; eligible if p > epsilon.

    *calibration* (label, score), *candidates* (id, label, score). One eligible label is the answer;
    none is OUT_OF_DISTRIBUTION, several AMBIGUOUS. Both are ranked together, per class in blocks of
    *width* on the score, so no score is compared pairwise and no class meets in one task.
    """
    both = calibration.select("label", F.col("score").cast("double").alias("score"), F.lit(None).cast("bigint").alias("id"), F.lit(1).alias("c")).unionByName(candidates.select("label", F.col("score").cast("double").alias("score"), F.col("id").cast("bigint").alias("id"), F.lit(0).alias("c")))
    both = both.where("score IS NOT NULL AND label IS NOT NULL").withColumn(BLOCK, -block_of(F.col("score"), width))
    blocks = both.groupBy("label", BLOCK).agg(F.sum("c").alias("_n"))
    carry = blocks.select("label", BLOCK, F.coalesce(F.sum("_n").over(before(across(["label"]))), F.lit(0)).alias("_c"), F.sum("_n").over(Window.partitionBy("label")).alias("n"))
    w = inside(["label"], F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    p = both.withColumn("_ge", F.sum("c").over(w)).where("c = 0").join(carry, ["label", BLOCK]).select("id", "label", F.round((1 + F.col("_ge") + F.col("_c")) / (F.col("n") + 1), 9).alias("p"))
    fits = F.collect_list(F.when(F.col("p") > epsilon, F.col("label")))
    return p.groupBy("id").agg(fits.alias("_f"), F.max("p").alias("p")).select("id", F.when(F.size("_f") == 1, F.get("_f", F.lit(0))).when(F.size("_f") == 0, "OUT_OF_DISTRIBUTION").otherwise("AMBIGUOUS").alias("outcome"), "p")


def average_ranks(rows: DataFrame, keys: list[str], value: str, width: float, name: str = "rank") -> DataFrame:
    """Adds *name*, the rank of *value* with ties averaged, counted over the distinct values by block."""
    values = rows.groupBy(*keys, value).agg(F.count("*").alias("_n")).where(F.col(value).isNotNull()).withColumn(BLOCK, block_of(F.col(value), width))
    blocks = values.groupBy(*keys, BLOCK).agg(F.sum("_n").alias("_b"))
    carry = blocks.select(*keys, BLOCK, F.coalesce(F.sum("_b").over(before(across(keys))), F.lit(0)).alias("_c"))
    local = values.withColumn("_upto", F.sum("_n").over(upto(inside(keys, value)))).join(carry, [*keys, BLOCK])
    ranks = local.select(*keys, value, (F.col("_upto") + F.col("_c") - (F.col("_n") - 1) / 2).alias(name))
    return rows.join(ranks, [*keys, value])


def spearman(rows: DataFrame, keys: list[str], a: str, b: str, width_a: float, width_b: float) -> DataFrame:
    """Correlation of the averaged ranks of two columns per key."""
    ranked = average_ranks(average_ranks(rows.select(*keys, a, b), keys, a, width_a, "_ra"), keys, b, width_b, "_rb")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.corr("_ra", "_rb"), 6).alias("rho"))


def _cluster_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side of a round: rows go to the nearer of their key's centres, and are summed by key and cluster."""
    for b in batches:
        if not b.num_rows:
            continue
        x, c = _unit_rows(b.column("v"), b.num_rows), [np.asarray(b.column(f"c{k}").flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, -1) for k in range(2)]
        own = ((x * c[1]).sum(axis=1) > (x * c[0]).sum(axis=1)).astype(np.int64)
        code = b.column("key").dictionary_encode()
        group = code.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + own
        held, group = np.unique(group, return_inverse=True)
        sums = np.zeros((len(held), x.shape[1]))
        np.add.at(sums, group, x)
        dim, n = x.shape[1], len(held)
        yield pa.RecordBatch.from_arrays(
            [code.dictionary.take(pa.array(np.repeat(held // 2, dim))), pa.array(np.repeat(held % 2, dim).astype(np.int32)), pa.array(np.tile(np.arange(dim), n).astype(np.int32)), pa.array(sums.ravel())],
            ["key", "cluster", "dim", "x"],
        )


def two_clusters(rows: DataFrame, keys: list[str], vector: str, row: str, iterations: int = 30) -> DataFrame:
    """Spherical two-means per key: id, cluster, distance to its centre. Cluster 0 has the smallest row id.

    The first seed is the row farthest from the one with the smallest id, the other that farthest from
    it. Each round sums what goes to either centre where the rows live, combined before the shuffle, so
    a key's vectors never meet in one task; only centres, two a key, are joined back. Rounds end when no
    centre moves by more than 1e-9 or after *iterations*. Ties go to cluster 0; an empty cluster keeps
    its centre; a key of one row is one cluster; null vectors are left out.
    """
    held = rows.select(F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key"), F.col(row).cast("bigint").alias("id"), unit(F.col(vector)).alias("v")).where("v IS NOT NULL")
    base = cut(held, "vectors")
    far = lambda c: F.min_by(F.struct("id", "v"), F.struct(F.round(dot(F.col("v"), c), 12).alias("d"), "id"))
    start = base.groupBy("key").agg(F.min_by("v", "id").alias("s"))
    second = base.join(start, "key").groupBy("key").agg(far(F.col("s")).alias("b"))
    pair = base.join(second, "key").groupBy("key").agg(F.first("b").alias("b"), far(F.col("b.v")).alias("a"))
    ordered = F.col("a.id") <= F.col("b.id")
    centres = cut(pair.select("key", F.when(ordered, F.col("a.v")).otherwise(F.col("b.v")).alias("c0"), F.when(ordered, F.col("b.v")).otherwise(F.col("a.v")).alias("c1")), "centres")
    for _ in range(iterations):
        sums = base.join(centres, "key").select("key", "v", "c0", "c1").mapInArrow(_cluster_sums, "key STRING, cluster INT, dim INT, x DOUBLE").groupBy("key", "cluster", "dim").agg(F.sum("x").alias("x"))
        made = sums.groupBy("key", "cluster").agg(unit(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"])).alias("c"))
        new = made.groupBy("key").agg(*[F.max(F.when(F.col("cluster") == k, F.col("c"))).alias(f"n{k}") for k in range(2)])
        moved = lambda k: F.exists(F.zip_with(F.coalesce(f"n{k}", f"c{k}"), f"c{k}", lambda p, q: F.abs(p - q)), lambda d: d > 1e-9)
        step = centres.join(new, "key").select("key", F.coalesce("n0", "c0").alias("c0"), F.coalesce("n1", "c1").alias("c1"), (moved(0) | moved(1)).alias("moved"))
        after, seen = counted_cut(step, "centres", F.count(F.when(F.col("moved"), 1)).alias("n"))
        drop(centres)
        centres = after
        if not seen["n"]:
            break
    near = [dot(F.col("v"), F.col(f"c{k}")) for k in range(2)]
    told = base.join(centres.select("key", "c0", "c1"), "key").select("key", "id", (F.round(near[1], 12) > F.round(near[0], 12)).cast("int").alias("cluster"), F.greatest(*near).alias("_d"))
    least = told.groupBy("key").agg(F.min_by("cluster", "id").alias("_flip"))
    return told.join(least, "key").select("id", F.when(F.col("_flip") == 1, 1 - F.col("cluster")).otherwise(F.col("cluster")).alias("cluster"), (1 - F.col("_d")).alias("distance"))
