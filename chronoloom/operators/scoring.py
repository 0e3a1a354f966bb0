"""Evaluation of two-label timelines: error rates, coverage, overlap, mapping, turns, corpus tables."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.operators.blocked import BLOCK, before, scanned
from chronoloom.operators.intervals import interval_join, overlap_us
from chronoloom.operators.periods import HOUR_US, continuous_periods, sweep
from chronoloom.session import cut

REF = ("REF_00", "REF_01")
HYP = ("A", "B")
#: Labels that name no speaker and are scored as silence.
NEUTRAL = ("UNKNOWN", "NON_SPEECH", "OVERLAP", "OTHER")
#: Least time of a speaker who counts; recordings that are broadcast at most.
FLOOR_US, MOST_BROADCAST = 250_000, 50_000
#: Draws made at a time and, about, in a task; recordings of a block that draws are packed for.
DRAWN, TASK_DRAWS, BLOCK_ROWS = 100_000, 4_000_000, 4_096


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b in doubles to nine places; *empty* where b is 0."""
    r = F.round(F.try_divide(a.cast("double"), b.cast("double")), 9)
    return r if empty is None else F.coalesce(r, F.lit(empty))


def f_scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1; all 1 where there is nothing to find and nothing found."""
    none = (tp + fp + fn) == 0
    one = lambda x: F.when(none, F.lit(1.0)).otherwise(x)
    return [one(ratio(tp, tp + fp)).alias("precision"), one(ratio(tp, tp + fn)).alias("recall"), one(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1")]


def label_faults(ref: DataFrame, hyp: DataFrame, keys: list[str], ref_labels: tuple[str, ...] = REF, hyp_labels: tuple[str, ...] = HYP, neutral: tuple[str, ...] = NEUTRAL) -> DataFrame:
    """Labels of a recording that the two-label scorer cannot take: keys, side, label, n_rows.

    A label is one if it is neither among the two of its side nor *neutral*; null labels count as one.
    """
    def odd(df: DataFrame, side: str, known: tuple[str, ...]) -> DataFrame:
        strange = df.where(~F.coalesce(F.col("label").isin(*known, *neutral), F.lit(False)))
        return strange.groupBy(*keys, "label").agg(F.count("*").alias("n_rows")).select(*keys, F.lit(side).alias("side"), "label", "n_rows")

    return odd(ref, "reference", ref_labels).unionByName(odd(hyp, "hypothesis", hyp_labels))


def scorable(rows: DataFrame, faults: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the recordings without :func:`label_faults`; the scorer takes no others."""
    return rows.join(faults.select(*keys).distinct(), keys, "left_anti")


def two_label_cells(ref: DataFrame, hyp: DataFrame, scope: DataFrame, keys: list[str], ref_labels: tuple[str, str] = REF, hyp_labels: tuple[str, str] = HYP) -> DataFrame:
    """Atomic cells inside *scope* with r0, r1, h0, h1 (1 where the label is active) and dur.

    Recordings with a further label have no cells: they are in :func:`label_faults`, with the label.
    """
    pick = lambda df, label: df.where(F.col("label") == label).select(*keys, "start_us", "end_us")
    odd = lambda df, known: df.where(~F.coalesce(F.col("label").isin(*known, *NEUTRAL), F.lit(False))).select(*keys, "start_us", "end_us")
    cells = sweep({"r0": pick(ref, ref_labels[0]), "r1": pick(ref, ref_labels[1]), "h0": pick(hyp, hyp_labels[0]), "h1": pick(hyp, hyp_labels[1]), "u": scope.select(*keys, "start_us", "end_us")}, keys)
    flag = lambda c: F.when(F.col(c) > 0, 1).otherwise(0).alias(c)
    found = cells.where("u > 0 AND r0 + r1 + h0 + h1 > 0").select(*keys, "start_us", "end_us", *[flag(c) for c in ("r0", "r1", "h0", "h1")], (F.col("end_us") - F.col("start_us")).alias("dur"))
    return scorable(found, odd(ref, ref_labels).unionByName(odd(hyp, hyp_labels)), keys)


def cell_sums(cells: DataFrame, keys: list[str]) -> DataFrame:
    """All sums the scores of a recording need, in one aggregate of its cells."""
    d, r, h = F.col("dur"), F.col("r0") + F.col("r1"), F.col("h0") + F.col("h1")
    c = {x: F.col(x) for x in ("r0", "r1", "h0", "h1")}
    one = F.when(r == 1, d).otherwise(0)
    sums = {
        "ref_us": d * r, "hyp_us": d * h, "miss_us": d * F.greatest(F.lit(0), r - h), "fa_us": d * F.greatest(F.lit(0), h - r), "both_us": d * F.least(r, h),
        "r0_us": d * c["r0"], "r1_us": d * c["r1"], "h0_us": d * c["h0"], "h1_us": d * c["h1"],
        "c00": d * c["r0"] * c["h0"], "c01": d * c["r0"] * c["h1"], "c10": d * c["r1"] * c["h0"], "c11": d * c["r1"] * c["h1"],
        "s0_us": one * c["r0"], "s1_us": one * c["r1"],
        "a0_us": one * c["r0"] * F.least(h, F.lit(1)), "a1_us": one * c["r1"] * F.least(h, F.lit(1)),
        "k00": one * c["r0"] * c["h0"] * (1 - c["h1"]), "k01": one * c["r0"] * c["h1"] * (1 - c["h0"]), "k10": one * c["r1"] * c["h0"] * (1 - c["h1"]), "k11": one * c["r1"] * c["h1"] * (1 - c["h0"]),
        "e00": one * c["r0"] * c["h0"], "e01": one * c["r0"] * c["h1"], "e10": one * c["r1"] * c["h0"], "e11": one * c["r1"] * c["h1"],
        "n_ref_us": one * r, "n_miss_us": F.when(r <= 1, d * F.greatest(F.lit(0), r - h)).otherwise(0), "n_fa_us": F.when(r <= 1, d * F.greatest(F.lit(0), h - r)).otherwise(0), "n_both_us": F.when(r <= 1, d * F.least(r, h)).otherwise(0),
        "o_tp": F.when((r == 2) & (h == 2), d).otherwise(0), "o_fp": F.when((r < 2) & (h == 2), d).otherwise(0), "o_fn": F.when((r == 2) & (h < 2), d).otherwise(0),
    }
    return cells.groupBy(*keys).agg(*[F.sum(x).cast("bigint").alias(n) for n, x in sums.items()])


def _mapped(straight: Column, crossed: Column) -> Column:
    return F.when(F.col("swapped"), crossed).otherwise(straight)


def recording_scores(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Mapping by most time in common (ties straight), error rate, label error, coverage, accuracy."""
    c = F.col
    m = sums.withColumn("swapped", c("c01") + c("c10") > c("c00") + c("c11"))
    right0, right1 = _mapped(c("c00"), c("c01")), _mapped(c("c11"), c("c10"))
    conf = c("both_us") - right0 - right1
    iou = lambda right, ref, hyp: 1 - F.try_divide(right.cast("double"), (ref + hyp - right).cast("double"))
    j0 = F.when(c("r0_us") > 0, iou(right0, c("r0_us"), _mapped(c("h0_us"), c("h1_us"))))
    j1 = F.when(c("r1_us") > 0, iou(right1, c("r1_us"), _mapped(c("h1_us"), c("h0_us"))))
    n = F.when(c("r0_us") > 0, 1).otherwise(0) + F.when(c("r1_us") > 0, 1).otherwise(0)
    return m.select(
        *keys, "swapped", "ref_us", "miss_us", "fa_us", conf.alias("conf_us"), ratio(c("miss_us") + c("fa_us") + conf, c("ref_us")).alias("der"),
        F.coalesce(F.round(F.try_divide(F.coalesce(j0, F.lit(0.0)) + F.coalesce(j1, F.lit(0.0)), n.cast("double")), 9), F.lit(0.0)).alias("jer"),
        ratio(c("a0_us"), c("s0_us")).alias("coverage_0"), ratio(c("a1_us"), c("s1_us")).alias("coverage_1"),
        ratio(_mapped(c("k00"), c("k01")), c("a0_us")).alias("accuracy_0"), ratio(_mapped(c("k11"), c("k10")), c("a1_us")).alias("accuracy_1"),
        "o_tp", "o_fp", "o_fn",
    )


def label_durations(rows: DataFrame, hyp: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Per row (a turn or a word) and hypothesis label, the time in common; hyp labels made disjoint first."""
    flat = continuous_periods(hyp.select(*keys, "label", "start_us", "end_us"), [*keys, "label"]).drop("n_rows").withColumnRenamed("label", "hyp_label")
    pairs = interval_join(rows, flat, keys)
    common = overlap_us(F.col("start_us"), F.col("end_us"), F.col("other_start_us"), F.col("other_end_us"))
    return pairs.groupBy(*keys, row, "hyp_label").agg(F.sum(common).cast("bigint").alias("common_us"))


def attributed_words(words: DataFrame, hyp: DataFrame, keys: list[str], row: str = "word_id", labels: tuple[str, str] = HYP, material: int = 20, dominant: int = 80) -> DataFrame:
    """A label for each word, or why it has none.

    In percent of the word's length: two labels of *material* share or more give UNKNOWN_BOUNDARY, one
    of *dominant* share or more is the label (ties: the first), anything else is UNKNOWN_WEAK.
    """
    flat = continuous_periods(hyp.where(F.col("label").isin(*labels)).select(*keys, "label", "start_us", "end_us"), [*keys, "label"]).drop("n_rows").withColumnRenamed("label", "_label")
    common = overlap_us(F.col("start_us"), F.col("end_us"), F.col("other_start_us"), F.col("other_end_us"))
    touched = interval_join(words.select(*keys, row, "start_us", "end_us"), flat, keys)
    wide = touched.groupBy(*keys, row).agg(*[F.sum(F.when(F.col("_label") == x, common).otherwise(0)).cast("bigint").alias(f"_c{k}") for k, x in enumerate(labels)])
    size = F.col("end_us") - F.col("start_us")
    c = [F.coalesce(f"_c{k}", F.lit(0)) for k in range(2)]
    label = (
        F.when((c[0] * 100 >= size * material) & (c[1] * 100 >= size * material), "UNKNOWN_BOUNDARY")
        .when((c[0] * 100 >= size * dominant) & (c[0] >= c[1]), labels[0]).when(c[1] * 100 >= size * dominant, labels[1]).otherwise("UNKNOWN_WEAK")
    )
    return words.join(wide, [*keys, row], "left").select(*words.columns, c[0].alias("first_us"), c[1].alias("second_us"), label.alias("word_label"))


def turn_votes(durations: DataFrame, keys: list[str], row: str) -> DataFrame:
    """The hypothesis label with most of a turn's time; ties go to the first label."""
    w = Window.partitionBy(*keys, row).orderBy(F.desc("common_us"), "hyp_label")
    return durations.withColumn("_n", F.row_number().over(w)).where("_n = 1 AND common_us > 0").drop("_n")


def duration_bucket(size: Column) -> Column:
    return F.when(size < 1_000_000, "lt_1s").when(size < 3_000_000, "1_3s").when(size < 10_000_000, "3_10s").otherwise("ge_10s")


def boundary_matches(ref: DataFrame, hyp: DataFrame, keys: list[str], at: str, collar_us: int) -> DataFrame:
    """Most boundaries that can be matched one to one within *collar_us*: keys, tp, fp, fn.

    Points are cut into clusters where neighbours are more than the collar apart; none can match
    across. Inside a cluster the greedy pass over both sides in time order is optimal and linear.
    """
    both = ref.select(*keys, F.col(at).cast("bigint").alias("t"), F.lit(0).alias("side")).unionByName(hyp.select(*keys, F.col(at).cast("bigint").alias("t"), F.lit(1).alias("side"))).where("t IS NOT NULL")
    near = scanned(both, keys, "t", ["side"], HOUR_US, lag={"_p": F.col("t")}).withColumn("_f", F.when(F.col("t") - F.col("_p") <= collar_us, F.lit(None)).otherwise(F.col("t")))
    clusters = scanned(near, keys, "t", ["side"], HOUR_US, top={"_c": F.col("_f")}).groupBy(*keys, "_c").agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == k, F.col("t")))).alias(n) for k, n in enumerate("rh")])

    @F.pandas_udf("bigint")
    def matched(refs: pd.Series, hyps: pd.Series) -> pd.Series:
        def one(r, h) -> int:  # noqa: ANN001
            i = k = n = 0
            while i < len(r) and k < len(h):
                if abs(h[k] - r[i]) <= collar_us:
                    i, k, n = i + 1, k + 1, n + 1
                elif h[k] < r[i]:
                    k += 1
                else:
                    i += 1
            return n

        return pd.Series([one(r, h) for r, h in zip(refs, hyps, strict=True)], dtype="int64")

    # points of one side alone match nothing and need no Python
    lone = (F.size("r") == 0) | (F.size("h") == 0)
    counted = clusters.select(*keys, F.when(lone, F.lit(0).cast("bigint")).otherwise(matched("r", "h")).alias("tp"), F.size("r").alias("nr"), F.size("h").alias("nh"))
    return counted.groupBy(*keys).agg(F.sum("tp").alias("tp"), F.sum(F.col("nh") - F.col("tp")).alias("fp"), F.sum(F.col("nr") - F.col("tp")).alias("fn"))


def subgroup_scores(scores: DataFrame, dims: list[str]) -> DataFrame:
    """Pooled and mean rates overall and for each value of each dimension, in one grouping."""
    long = scores.withColumn("_g", F.explode(F.array(F.struct(F.lit("all").alias("dim"), F.lit("").alias("value")), *[F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("")).alias("value")) for d in dims])))
    errors = F.sum(F.col("miss_us") + F.col("fa_us") + F.col("conf_us"))
    return long.groupBy("_g.dim", "_g.value").agg(F.count("*").alias("n_recordings"), ratio(errors, F.sum("ref_us")).alias("pooled_der"), F.round(F.avg("der"), 9).alias("mean_der"), F.round(F.max("der"), 9).alias("worst_der"))


def _drawn(seed: int, i: int, low: int, high: int, n: int) -> np.ndarray:
    """Population indices of draws *low* to *high* of iteration *i*."""
    head, tail = f"{seed}:{i}:".encode(), f":{n}".encode()
    first = b"".join([sha256(head + b"%d" % j + tail).digest()[:8] for j in range(low, high)])
    return (np.frombuffer(first, ">u8") % np.uint64(n)).astype(np.int64)


def bootstrap_draws(spark: SparkSession, n: int, iterations: int, seed: int, block: int | None = None) -> DataFrame:
    """(_i, _k): the population index that each of the *n* draws of every iteration takes.

    Draw j of iteration i is the first 8 bytes of sha256("seed:i:j:n") modulo n. Draws are made in Arrow
    batches where the iteration lives, so an iteration's rows stay together until they are summed. With
    *block* the draws of a batch that fall into the same *block* indices (32,768 at most) are one row:
    (_i, _b, _o), the block and the places in it.
    """
    parts = -(-n // DRAWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column(0).to_pylist():
                i, low = at // parts, at % parts * DRAWN
                k = _drawn(seed, i, low, min(n, low + DRAWN), n)
                if block is None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), i, np.int64)), pa.array(k)], ["_i", "_k"])
                    continue
                k.sort()
                own = k // block
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(k)].astype(np.int32)), pa.array((k % block).astype(np.int16)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), i, np.int64)), pa.array(own[first]), places], ["_i", "_b", "_o"])

    tasks = min(iterations * parts, max(spark.sparkContext.defaultParallelism, iterations * n // TASK_DRAWS))
    return spark.range(0, iterations * parts, 1, tasks).mapInArrow(run, "_i BIGINT, _k BIGINT" if block is None else "_i BIGINT, _b BIGINT, _o ARRAY<SMALLINT>")


def drawn_rows(indexed: DataFrame, n: int, iterations: int, seed: int) -> DataFrame:
    """The rows of *indexed* (numbered by _k from 0 to *n* - 1) that every iteration _i draws.

    Few rows are broadcast. Of more, blocks of :data:`BLOCK_ROWS` meet the draws of the block, packed: a
    draw costs two bytes of shuffle. Spark takes the draws for as small as the range that they are made
    from, so either join says which side is built.
    """
    spark = indexed.sparkSession
    if n <= MOST_BROADCAST:
        return bootstrap_draws(spark, n, iterations, seed).join(F.broadcast(indexed), "_k")
    values = [c for c in indexed.columns if c != "_k"]
    row = F.struct("_k", *values)
    lists = indexed.groupBy(F.expr(f"_k DIV {BLOCK_ROWS}").alias("_b")).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    columns = lists.select("_b", *[F.col("_rows")[c].alias(c) for c in values])
    packed = bootstrap_draws(spark, n, iterations, seed, BLOCK_ROWS).join(columns.hint("shuffle_hash"), "_b")
    return packed.select("_i", *values, F.explode("_o").alias("_at")).select("_i", *[F.col(c)[F.col("_at")].alias(c) for c in values])


def bootstrap_suite(rows: DataFrame, statistics: dict[str, Column], iterations: int = 2_000, seed: int = 17_029, level: float = 0.95) -> DataFrame:
    """Percentile intervals of *statistics* (aggregates) over recordings resampled with replacement.

    A row a statistic: metric, confidence_level, point, lower, upper, iterations (samples in which it is
    defined), seed, n (recordings). A statistic that is null over all recordings has no row.

    Draws are hashes, so the result is the same on any cluster. Recordings are numbered by name; draws
    are joined by index (:func:`drawn_rows`) and iterations meet only in sums, combined before the
    shuffle. All statistics use the same draws.
    """
    spark = rows.sparkSession
    named = cut(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "recording").withColumn(BLOCK, F.spark_partition_id()), "scores")
    n = named.count()
    kinds = "metric STRING, confidence_level DOUBLE, point DOUBLE, lower DOUBLE, upper DOUBLE, iterations BIGINT, seed BIGINT, n BIGINT"
    if n == 0 or iterations <= 0:
        return spark.createDataFrame([], kinds)
    # numbered by name, range by range of the names
    blocks = named.groupBy(BLOCK).agg(F.count("*").alias("_n")).select(BLOCK, F.coalesce(F.sum("_n").over(before(Window.orderBy(BLOCK))), F.lit(0)).alias("_before"))
    indexed = named.withColumn("_r", F.row_number().over(Window.partitionBy(BLOCK).orderBy("recording")) - 1).join(F.broadcast(blocks), BLOCK).withColumn("_k", F.col("_r") + F.col("_before")).drop("recording", BLOCK, "_r", "_before")
    stats = [x.cast("double").alias(f"_s{k}") for k, x in enumerate(statistics.values())]
    samples = drawn_rows(indexed, n, iterations, seed).groupBy("_i").agg(*stats)
    tail = (1 - level) / 2
    entries = lambda f: F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), *f(f"_s{k}")) for k, m in enumerate(statistics)])).alias("e")
    bounds = samples.agg(*[x for k in range(len(stats)) for x in (F.percentile(f"_s{k}", F.lit(tail)).alias(f"_s{k}l"), F.percentile(f"_s{k}", F.lit(1 - tail)).alias(f"_s{k}u"), F.count(f"_s{k}").alias(f"_s{k}n"))])
    bounds = bounds.select(entries(lambda c: (F.round(c + "l", 9).alias("lower"), F.round(c + "u", 9).alias("upper"), F.col(c + "n").alias("iterations")))).select("e.*").where("iterations > 0")
    points = named.agg(*stats).select(entries(lambda c: (F.round(c, 9).alias("point"),))).select("e.*").where("point IS NOT NULL")
    return points.join(bounds, "metric").select("metric", F.lit(float(level)).alias("confidence_level"), "point", "lower", "upper", "iterations", F.lit(seed).cast("bigint").alias("seed"), F.lit(n).cast("bigint").alias("n"))


def bootstrap_ci(scores: DataFrame, value: str, iterations: int = 2_000, seed: int = 17_029, level: float = 0.95) -> DataFrame:
    """As :func:`bootstrap_suite` for the mean of one column: n, mean, low, high."""
    own = bootstrap_suite(scores.select("recording", F.col(value).cast("double").alias("_v")), {value: F.avg("_v")}, iterations, seed, level)
    return own.select("n", F.col("point").alias("mean"), F.col("lower").alias("low"), F.col("upper").alias("high"))


def change_boundaries(turns: DataFrame, keys: list[str], labels: tuple[str, str]) -> DataFrame:
    """Starts (keys, at) at which a label begins that was not there just before.

    There before a point are the labels of earlier turns that reach it; if there are none, those whose
    turns ended last. At the first turn of a key nothing changes.
    """
    at = lambda x, what: F.max(F.when(F.col("label") == x, what))
    points = turns.where(F.col("label").isin(*labels)).groupBy(*keys, F.col("start_us").alias("at")).agg(*[at(x, F.col("end_us")).alias(f"_e{k}") for k, x in enumerate(labels)])
    seen = scanned(points, keys, "at", [], HOUR_US, top_before={f"_m{k}": F.col(f"_e{k}") for k in range(2)}).withColumn("_last", F.greatest("_m0", "_m1"))
    there = lambda k: F.coalesce(F.when(F.col("_last") >= F.col("at"), F.col(f"_m{k}") >= F.col("at")).otherwise(F.col(f"_m{k}") == F.col("_last")), F.lit(False))
    fresh = [F.col(f"_e{k}").isNotNull() & ~there(k) for k in range(2)]
    return seen.where(F.col("_last").isNotNull() & (fresh[0] | fresh[1])).select(*keys, "at")


def suite_rows(sums: DataFrame, changes: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """What the statistics of :func:`scoring_suite` need of each recording.

    *sums* of :func:`cell_sums`, *changes* of :func:`boundary_matches`, *words* with label and word_label.
    Speakers count from :data:`FLOOR_US` on. Where both mappings have as much in common, the one whose
    pairs come first by name is taken.
    """
    c = F.col
    counted = cut(words.groupBy(*keys).agg(F.count("*").alias("w_all"), F.count(F.when(c("word_label").isin(*HYP), 1)).alias("w_given"), *[F.count(F.when((c("label") == REF[0]) & (c("word_label") == a) | (c("label") == REF[1]) & (c("word_label") == b), 1)).alias(n) for n, a, b in (("w_straight", *HYP), ("w_crossed", *HYP[::-1]))]), "counted")
    more, less = c("c01") + c("c10"), c("c00") + c("c11")
    crossed_first = (c("h0_us") == 0) & (c("h1_us") > 0) & (c("r0_us") > 0) | (c("r0_us") == 0) & (c("r1_us") > 0) & (c("h0_us") > 0)
    m = sums.join(changes, keys, "left").join(counted, keys, "left").withColumn("swapped", (more > less) | (more == less) & crossed_first)
    material = {x: c(f"{x}_us") >= FLOOR_US for x in ("r0", "r1", "h0", "h1")}
    number = lambda a, b: material[a].cast("int") + material[b].cast("int")
    right = [_mapped(c("c00"), c("c01")), _mapped(c("c11"), c("c10"))]
    hyp = [_mapped(c("h0_us"), c("h1_us")), _mapped(c("h1_us"), c("h0_us"))]
    # correct time where the reference has one speaker; from it, that of the cells without overlap
    sole = [_mapped(c("e00"), c("e01")), _mapped(c("e11"), c("e10"))]
    jer = [F.when(c(f"r{k}_us") > 0, 1 - right[k] / (c(f"r{k}_us") + hyp[k] - right[k])) for k in range(2)]
    per = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    one, two = number("r0", "r1") == 1, number("r0", "r1") == 2
    zero = lambda x: F.coalesce(c(x), F.lit(0))
    return m.select(
        c(keys[0]).alias("recording"), "ref_us", (c("miss_us") + c("fa_us") + c("both_us") - right[0] - right[1]).alias("error_us"),
        "n_ref_us", (c("n_miss_us") + c("n_fa_us") + c("n_both_us") - sole[0] - sole[1]).alias("n_error_us"),
        per(F.coalesce(jer[0], F.lit(0.0)) + F.coalesce(jer[1], F.lit(0.0)), (c("r0_us") > 0).cast("int") + (c("r1_us") > 0).cast("int")).alias("jer"),
        one.alias("h1"), two.alias("h2"), (two & (number("h0", "h1") == 1)).alias("merged"), (one & (number("h0", "h1") == 2)).alias("split"),
        F.when(one, F.least("h0_us", "h1_us")).otherwise(0).alias("split_us"), F.when(one, F.when(material["r0"], c("s0_us")).otherwise(c("s1_us"))).otherwise(0).alias("h1_us"),
        F.least(*[F.when(material[f"r{k}"], per(c(f"a{k}_us"), c(f"s{k}_us"))) for k in range(2)]).alias("coverage"), F.least(*[F.when(material[f"r{k}"], per(sole[k], c(f"a{k}_us"))) for k in range(2)]).alias("accuracy"),
        *[zero(x).alias(f"b_{x}") for x in ("tp", "fp", "fn")], *[F.when(c("o_tp") + c("o_fn") > 0, c(x)).alias(x) for x in ("o_tp", "o_fp", "o_fn")],
        zero("w_all").alias("w_all"), zero("w_given").alias("w_given"), F.coalesce(_mapped(c("w_straight"), c("w_crossed")), F.lit(0)).alias("w_right"),
    )


def _share(a: Column, b: Column, none: Column | None = None) -> Column:
    """sum(a) / sum(b): null where nothing is summed, and where the sum of b is 0 or, with *none*, 1 if that is 0 too, else 0."""
    share = F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double"))
    return share if none is None else F.when(F.sum(none).isNotNull(), F.when(F.sum(none) == 0, 1.0).otherwise(F.coalesce(share, F.lit(0.0))))


def _suite() -> dict[str, Column]:
    c = F.col
    rate = lambda x, of: F.avg(F.when(c(of), c(x).cast("int")))
    overlap, changes = c("o_tp") + c("o_fp") + c("o_fn"), c("b_tp") + c("b_fp") + c("b_fn")
    return {
        "der_all": _share(c("error_us"), c("ref_us")), "der_nonoverlap": _share(c("n_error_us"), c("n_ref_us")), "jer": F.avg("jer"),
        "acoustic_complete_merge_rate": rate("merged", "h2"), "unsafe_complete_merge_rate": F.avg(F.when(c("h2"), 0)), "false_h2_rate": rate("split", "h1"),
        "false_h2_duration_ratio": F.when(F.count(F.when(c("h1"), 1)) > 0, F.coalesce(_share(c("split_us"), c("h1_us")), F.lit(0.0))),
        "worst_speaker_coverage": F.min("coverage"), "worst_speaker_assigned_accuracy": F.min("accuracy"),
        "scd_f1": _share(2 * c("b_tp"), c("b_tp") + changes, changes), "overlap_precision": _share(c("o_tp"), c("o_tp") + c("o_fp"), overlap), "overlap_recall": _share(c("o_tp"), c("o_tp") + c("o_fn"), overlap),
        "word_attribution_precision": _share(c("w_right"), c("w_given")), "word_attribution_coverage": _share(c("w_given"), c("w_all")),
    }


def scoring_suite(rows: DataFrame, iterations: int = 2_000, seed: int = 17_029) -> DataFrame:
    """:func:`bootstrap_suite` of the scorer's metrics over :func:`suite_rows`.

    No quality status comes with the rows, so no merge counts as unsafe; no micro decisions come either,
    so their two metrics have no row.
    """
    return bootstrap_suite(rows, _suite(), iterations, seed)
