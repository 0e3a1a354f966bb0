"""Timelines derived from the driver tables, for Spark and, as CTEs, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.ids import plain_form
from chronoloom.operators.blocked import counted_rank
from chronoloom.operators.periods import usable
from chronoloom.plans.training_data import sql_plain, table
from chronoloom.session import cut

WORD_US = 300_000


def ref_spans(spark: SparkSession, d: str) -> DataFrame:
    """Usable turns: row_id, recording, label (two labels by the parity of the speaker), start, end."""
    t = usable(table(spark, d, "rttm"), "speaker_id")
    odd = F.coalesce(F.right(plain_form(F.col("speaker_id")), F.lit(1)), F.lit("")).isin("1", "3", "5", "7", "9")
    return t.select("row_id", F.concat_ws("/", "file_id", "channel").alias("recording"), F.when(odd, "REF_01").otherwise("REF_00").alias("label"), "start_us", "end_us")


def hyp_spans(spark: SparkSession, d: str) -> DataFrame:
    """The turns as a system might give them: shifted, some labels swapped, some unknown."""
    start = F.greatest(F.lit(0), F.col("start_us") + (F.col("row_id") % 7 - 3) * 100_000)
    label = F.when(F.col("row_id") % 13 == 0, "UNKNOWN").when((F.col("label") == "REF_00") != (F.col("row_id") % 11 == 0), "A").otherwise("B")
    return ref_spans(spark, d).select("row_id", "recording", label.alias("label"), start.alias("start_us"), (start + F.col("end_us") - F.col("start_us")).alias("end_us"))


def scope(spark: SparkSession, d: str) -> DataFrame:
    return usable(table(spark, d, "uem")).select("row_id", F.concat_ws("/", "file_id", "channel").alias("recording"), "start_us", "end_us")


def words(spark: SparkSession, d: str) -> DataFrame:
    """Words of 300 ms laid end to end in every turn, to its end."""
    n = F.floor((F.col("end_us") - F.col("start_us")) / WORD_US).cast("int")
    w = ref_spans(spark, d).withColumn("_k", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))))
    return w.select("recording", "label", F.concat_ws("-", "row_id", "_k").alias("word_id"), (F.col("start_us") + F.col("_k") * WORD_US).alias("start_us"), (F.col("start_us") + (F.col("_k") + 1) * WORD_US).alias("end_us"), F.concat(F.lit("w"), F.pmod(F.col("row_id") * 31 + F.col("_k"), F.lit(97))).alias("text"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Contiguous 32 ms frames with a probability, one recording a supplier."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    ties = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")]
    k = (F.col("_k") - 1).cast("bigint")
    numbered = counted_rank(li, ["l_suppkey"], "l_orderkey", ties, 1_000_000, "_k")
    # scans read their rows more than once, and numbering them is dearer than a table
    return cut(numbered.select(F.col("l_suppkey").alias("recording"), (k * 32_000).alias("start_us"), ((k + 1) * 32_000).alias("end_us"), F.round(F.col("l_discount").cast("double") * 10, 1).alias("p")), "frames")


VIEWS = f"""
ref AS (SELECT row_id, concat_ws('/', file_id, channel) AS recording, CASE WHEN right(coalesce({sql_plain('speaker_id')}, ''), 1) IN ('1', '3', '5', '7', '9') THEN 'REF_01' ELSE 'REF_00' END AS label, start_us, end_us
  FROM rttm WHERE speaker_id IS NOT NULL AND start_us IS NOT NULL AND end_us > start_us),
hyp AS (SELECT row_id, recording, CASE WHEN row_id % 13 = 0 THEN 'UNKNOWN' WHEN (label = 'REF_00') <> (row_id % 11 = 0) THEN 'A' ELSE 'B' END AS label, s AS start_us, s + n AS end_us
  FROM (SELECT row_id, recording, label, greatest(0, start_us + (row_id % 7 - 3) * 100000) AS s, end_us - start_us AS n FROM ref)),
scope AS (SELECT row_id, concat_ws('/', file_id, channel) AS recording, start_us, end_us FROM uem WHERE start_us IS NOT NULL AND end_us > start_us),
words AS (SELECT recording, label, row_id || '-' || k AS word_id, start_us + k * {WORD_US} AS start_us, start_us + (k + 1) * {WORD_US} AS end_us, 'w' || ((row_id * 31 + k) % 97) AS text
  FROM (SELECT *, unnest(range((end_us - start_us) // {WORD_US})) AS k FROM ref)),
frames AS (SELECT l_suppkey AS recording, k * 32000 AS start_us, (k + 1) * 32000 AS end_us, p FROM (SELECT l_suppkey, round(CAST(l_discount AS DOUBLE) * 10, 1) AS p,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount) - 1 AS k FROM lineitem))"""


def sql_union(name: str, source: str, keys: str = "recording", gap: int = 0) -> str:
    """CTEs that merge overlapping and touching intervals, within *gap*: {name}(keys, start, end, n_rows)."""
    return f"""
{name}_1 AS (SELECT *, CASE WHEN start_us <= {gap} + max(end_us) OVER (PARTITION BY {keys} ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM ({source})),
{name}_2 AS (SELECT *, sum(f) OVER (PARTITION BY {keys} ORDER BY start_us, end_us, f DESC ROWS UNBOUNDED PRECEDING) AS g FROM {name}_1),
{name} AS (SELECT {keys}, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_rows FROM {name}_2 GROUP BY {keys}, g)"""


def sql_cells(name: str, sets: dict[str, str], keys: str = "recording") -> str:
    """CTEs of the atomic cells of several sets of intervals, with the number of each that hold."""
    events = " UNION ALL ".join(f"SELECT {keys}, {t} AS t, " + ", ".join(f"{step if c == own else 0} AS {c}" for c in sets) + f" FROM ({src})" for own, src in sets.items() for t, step in (("start_us", 1), ("end_us", -1)))
    return f"""
{name}_e AS (SELECT {keys}, t, {', '.join(f'sum({c}) AS {c}' for c in sets)} FROM ({events}) GROUP BY {keys}, t),
{name} AS (SELECT * FROM (SELECT {keys}, t AS start_us, lead(t) OVER w AS end_us, {', '.join(f'sum({c}) OVER w AS {c}' for c in sets)} FROM {name}_e WINDOW w AS (PARTITION BY {keys} ORDER BY t)) WHERE end_us IS NOT NULL)"""
