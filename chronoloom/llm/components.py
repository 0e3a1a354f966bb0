"""Connected components of rows tied by shared keys, by alternating stars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.session import counted_cut, drop


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _print() -> tuple[Column, Column]:
    """What tells one edge table from another: number of edges and a digest without order."""
    return F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("digest")


def star_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of *edges* (u, v); a component's name is its smallest node.

    Large and small stars alternate until nothing changes. Each is an aggregate of minima, combined
    before the shuffle, and a join against one row a node, so hubs are split where they are skewed.
    The lineage of each round is cut by a table in the shared folder, and the test whether it changed
    anything is counted while the table is written; only counts reach the driver.
    """
    now, seen = counted_cut(edges.where("u <> v").distinct(), "edges", *_print())
    while True:
        after, found = counted_cut(_small_star(_large_star(now)), "stars", *_print())
        drop(now)
        now, was, seen = after, seen, found
        if seen == was:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))


def tied_rows(rows: DataFrame, row: str, keys: dict[str, Column]) -> DataFrame:
    """(row_id, component) of all rows: rows with an equal key are tied, at any distance.

    Keys are compared by kind and value; null ones tie nothing, and a row without any is a component
    of its own. The graph has keys as its nodes, an edge for each two keys of one row: its size is
    that of the distinct keys, however many rows share one.
    """
    tagged = [F.when(k.isNotNull(), F.concat(F.lit(f"{name}:"), k)) for name, k in keys.items()]
    held = rows.select(F.col(row).cast("bigint").alias("row_id"), F.array_compact(F.array(*tagged)).alias("_keys"))
    edges = held.where(F.size("_keys") > 1).select(F.get("_keys", F.lit(0)).alias("u"), F.explode(F.slice("_keys", 2, len(keys))).alias("v"))
    named = star_components(edges)
    first = held.select("row_id", F.get("_keys", F.lit(0)).alias("node"))
    found = first.where("node IS NOT NULL").join(named, "node", "left").select("row_id", F.coalesce("component", "node").alias("component"))
    return reduce(DataFrame.unionByName, [found, first.where("node IS NULL").select("row_id", F.concat(F.lit("row:"), "row_id").alias("component"))])


def representatives(tied: DataFrame) -> DataFrame:
    """For each component of two or more rows: its smallest row and each other one."""
    least = tied.groupBy("component").agg(F.min("row_id").alias("row_a"))
    return tied.join(least, "component").where("row_id <> row_a").select("row_a", F.col("row_id").alias("row_b"))
