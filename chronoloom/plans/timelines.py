"""Queries on labelled timelines: interval algebra, scoring, words and turns, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.scalars import stable_id, threshold_outcome, timeline_digest
from chronoloom.operators import intervals as I
from chronoloom.operators import scoring as S
from chronoloom.operators import sequences as Q
from chronoloom.operators import tallies as Y
from chronoloom.operators.periods import continuous_periods, sweep
from chronoloom.operators.texts import speaker_texts
from chronoloom.plans.views import VIEWS, hyp_spans, ref_spans, scope, sql_cells, sql_union, words
from chronoloom.session import cut
from chronoloom.sources.formats import rttm_lines, uem_lines

K = ["recording"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with its SQL over the views."""
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {VIEWS} {sql}"
        return f

    return add


def _with(*ctes: str) -> str:
    return ", ".join([f"WITH {VIEWS}", *[c.strip() for c in ctes]])


@query(_with(sql_union("m", "SELECT recording, start_us, end_us FROM ref")) + " SELECT * FROM m")
def islands_union(spark: SparkSession, d: str) -> DataFrame:
    return continuous_periods(ref_spans(spark, d), K)


@query(_with(sql_union("m", "SELECT recording, start_us, end_us FROM ref")) + " SELECT recording, CAST(sum(end_us - start_us) AS BIGINT) AS covered_us, count(*) AS n_periods FROM m GROUP BY 1")
def union_length(spark: SparkSession, d: str) -> DataFrame:
    return continuous_periods(ref_spans(spark, d), K).groupBy("recording").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("covered_us"), F.count("*").alias("n_periods"))


@query(_with(sql_union("m", "SELECT recording, start_us, end_us FROM ref", gap=200_000)) + " SELECT * FROM m")
def gap_merged_regions(spark: SparkSession, d: str) -> DataFrame:
    return I.merge_within(ref_spans(spark, d), K, 200_000)


_SUB = lambda base, cut: _with(sql_cells("c", {"u": base, "x": cut}), sql_union("m", "SELECT recording, start_us, end_us FROM c WHERE u > 0 AND x = 0")) + " SELECT recording, start_us, end_us FROM m"


@query(_SUB("SELECT * FROM scope", "SELECT * FROM ref"))
def interval_subtract(spark: SparkSession, d: str) -> DataFrame:
    return I.subtract(scope(spark, d), ref_spans(spark, d), K)


@query(_SUB("SELECT recording, start_us, end_us FROM scope", "SELECT recording, unnest([start_us, end_us]) - 250000 AS start_us, unnest([start_us, end_us]) + 250000 AS end_us FROM ref"))
def collared_scope(spark: SparkSession, d: str) -> DataFrame:
    edges = ref_spans(spark, d).select("recording", F.explode(F.array("start_us", "end_us")).alias("at"))
    return I.subtract(scope(spark, d), I.collar_zones(edges, "at", 250_000), K)


_CELLS = sql_cells("cells0", {"r0": "SELECT * FROM ref WHERE label = 'REF_00'", "r1": "SELECT * FROM ref WHERE label = 'REF_01'", "h0": "SELECT * FROM hyp WHERE label = 'A'", "h1": "SELECT * FROM hyp WHERE label = 'B'", "u": "SELECT * FROM scope"})
_FLAGS = "cells AS (SELECT recording, start_us, end_us, CAST(r0 > 0 AS INT) AS r0, CAST(r1 > 0 AS INT) AS r1, CAST(h0 > 0 AS INT) AS h0, CAST(h1 > 0 AS INT) AS h1, end_us - start_us AS dur FROM cells0 WHERE u > 0 AND r0 + r1 + h0 + h1 > 0)"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return S.two_label_cells(ref_spans(spark, d), hyp_spans(spark, d), scope(spark, d), K)


@query(_with(_CELLS, _FLAGS) + " SELECT * FROM cells")
def atomic_cells(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d)


@query("SELECT recording, 'hypothesis' AS side, 'C' AS label, count(*) AS n_rows FROM hyp WHERE row_id % 401 = 0 GROUP BY 1")
def label_faults(spark: SparkSession, d: str) -> DataFrame:
    """Recordings in which a third speaker was heard now and then, with the rows of that label."""
    heard = hyp_spans(spark, d).withColumn("label", F.when(F.col("row_id") % 401 == 0, "C").otherwise(F.col("label")))
    return S.label_faults(ref_spans(spark, d), heard, K)


@query(_with(_CELLS, _FLAGS) + " SELECT recording, label, CAST(sum(dur) AS BIGINT) AS active_us FROM (SELECT recording, unnest(['REF_00', 'REF_01', 'A', 'B']) AS label, unnest([r0, r1, h0, h1]) AS f, dur FROM cells) WHERE f = 1 GROUP BY 1, 2")
def speaker_durations(spark: SparkSession, d: str) -> DataFrame:
    active = F.array(*[F.when(F.col(c) == 1, F.lit(n)) for c, n in (("r0", "REF_00"), ("r1", "REF_01"), ("h0", "A"), ("h1", "B"))])
    return _cells(spark, d).select("recording", F.explode(F.array_compact(active)).alias("label"), "dur").groupBy("recording", "label").agg(F.sum("dur").alias("active_us"))


@query("SELECT DISTINCT p.recording, p.at FROM (SELECT recording, unnest([start_us, end_us]) AS at FROM ref) p JOIN scope s ON s.recording = p.recording AND s.start_us <= p.at AND p.at < s.end_us")
def scored_boundaries(spark: SparkSession, d: str) -> DataFrame:
    edges = ref_spans(spark, d).select("recording", F.explode(F.array("start_us", "end_us")).alias("at")).distinct()
    return I.points_inside(edges, scope(spark, d), K, "at")


_HFLAT = sql_union("hf", "SELECT recording, label, start_us, end_us FROM hyp", "recording, label")
_COMMON = _with(_HFLAT) + ", common AS (SELECT r.recording, r.row_id, r.label, r.start_us, r.end_us, h.label AS hyp_label, CAST(sum(least(r.end_us, h.end_us) - greatest(r.start_us, h.start_us)) AS BIGINT) AS common_us FROM ref r JOIN hf h ON h.recording = r.recording AND h.start_us < r.end_us AND r.start_us < h.end_us GROUP BY ALL)"


def _common(spark: SparkSession, d: str) -> DataFrame:
    ref = ref_spans(spark, d)
    return S.label_durations(ref, hyp_spans(spark, d), K, "row_id")


@query(_COMMON + " SELECT recording, label, hyp_label, CAST(sum(common_us) AS BIGINT) AS common_us FROM common GROUP BY 1, 2, 3")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    ref = ref_spans(spark, d).select("row_id", "label")
    return _common(spark, d).join(ref, "row_id").groupBy("recording", "label", "hyp_label").agg(F.sum("common_us").alias("common_us"))


@query(_COMMON + " SELECT recording, row_id, hyp_label, common_us FROM common QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY common_us DESC, hyp_label) = 1")
def turn_votes(spark: SparkSession, d: str) -> DataFrame:
    return S.turn_votes(_common(spark, d), K, "row_id")


@query(_COMMON + """, v AS (SELECT row_id, hyp_label FROM common QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY common_us DESC, hyp_label) = 1),
b AS (SELECT r.row_id, CASE WHEN end_us - start_us < 1000000 THEN 'lt_1s' WHEN end_us - start_us < 3000000 THEN '1_3s' WHEN end_us - start_us < 10000000 THEN '3_10s' ELSE 'ge_10s' END AS bucket, label, hyp_label FROM ref r LEFT JOIN v USING (row_id))
SELECT bucket, count(*) AS n_turns, count(hyp_label) AS n_voted, count(*) FILTER (WHERE (label = 'REF_00' AND hyp_label = 'A') OR (label = 'REF_01' AND hyp_label = 'B')) AS n_right,
 round(coalesce(count(*) FILTER (WHERE (label = 'REF_00' AND hyp_label = 'A') OR (label = 'REF_01' AND hyp_label = 'B')) / nullif(count(hyp_label), 0), 0), 9) AS accuracy FROM b GROUP BY 1""")
def duration_buckets(spark: SparkSession, d: str) -> DataFrame:
    votes = S.turn_votes(_common(spark, d), K, "row_id").select("row_id", "hyp_label")
    turns = ref_spans(spark, d).join(votes, "row_id", "left").withColumn("bucket", S.duration_bucket(F.col("end_us") - F.col("start_us")))
    right = F.count(F.when((F.col("label") == "REF_00") & (F.col("hyp_label") == "A") | (F.col("label") == "REF_01") & (F.col("hyp_label") == "B"), 1))
    return turns.groupBy("bucket").agg(F.count("*").alias("n_turns"), F.count("hyp_label").alias("n_voted"), right.alias("n_right"), S.ratio(right, F.count("hyp_label")).alias("accuracy"))


@query(_with(sql_union("u", "SELECT recording, start_us, end_us FROM scope")) + " SELECT r.*, EXISTS (SELECT 1 FROM u WHERE u.recording = r.recording AND u.start_us <= r.start_us AND r.end_us <= u.end_us) AS inside FROM ref r")
def turns_in_scope(spark: SparkSession, d: str) -> DataFrame:
    return I.contained(ref_spans(spark, d), scope(spark, d), K)


@query("SELECT * EXCLUDE (e) FROM (SELECT *, max(end_us) OVER (PARTITION BY recording ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM (SELECT recording, start_us, end_us FROM scope)) WHERE start_us < e")
def scope_order_faults(spark: SparkSession, d: str) -> DataFrame:
    return I.order_faults(scope(spark, d).select("recording", "start_us", "end_us"), K)


@query(_with(_CELLS, _FLAGS) + " SELECT DISTINCT recording FROM cells WHERE r0 = 1 AND r1 = 1")
def overlapped_recordings(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d).where("r0 = 1 AND r1 = 1").select("recording").distinct()


@query("SELECT recording, row_id, unnest(list_sort(list_distinct(list_concat(range(start_us, greatest(start_us, end_us - 10000000) + 1, 1000000), [greatest(start_us, end_us - 10000000)])))) AS window_us FROM scope")
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    return scope(spark, d).select("recording", "row_id", F.explode(I.window_starts(F.col("start_us"), F.col("end_us"), 10_000_000, 1_000_000)).alias("window_us"))


@query("SELECT DISTINCT recording, unnest(range(start_us // 5000000, (end_us - 1) // 5000000 + 1)) * 5000000 AS grid_us FROM ref")
def grid_windows(spark: SparkSession, d: str) -> DataFrame:
    return ref_spans(spark, d).select("recording", F.explode(I.grid_starts(F.col("end_us"), 5_000_000)).alias("grid_us")).distinct()


@query("SELECT row_id, recording, s AS start_us, least(s + 2000000, end_us) AS end_us, CASE WHEN least(s + 2000000, end_us) - s >= 1500000 THEN 'ANCHOR' WHEN least(s + 2000000, end_us) - s >= 700000 THEN 'SUPPORT' ELSE 'MICRO' END AS kind FROM (SELECT *, unnest(range(start_us, end_us, 2000000)) AS s FROM ref)")
def region_cuts(spark: SparkSession, d: str) -> DataFrame:
    return I.cut_regions(ref_spans(spark, d).drop("label"), 2_000_000)


@query(_with(sql_union("m", "SELECT recording, start_us, end_us FROM ref")) + """, g AS (SELECT *, start_us - lag(end_us) OVER w AS lg, lead(start_us) OVER w - end_us AS rg FROM m WINDOW w AS (PARTITION BY recording ORDER BY start_us))
SELECT recording, start_us, end_us, greatest(0, start_us - CASE WHEN lg < 200000 THEN lg - lg // 2 ELSE 100000 END) AS padded_start_us, end_us + CASE WHEN rg < 200000 THEN rg // 2 ELSE 100000 END AS padded_end_us FROM g""")
def padded_regions(spark: SparkSession, d: str) -> DataFrame:
    return I.padded(continuous_periods(ref_spans(spark, d), K).drop("n_rows"), K, 100_000, F.lit(0), F.lit(1 << 62))


@query("""WITH """ + VIEWS + """, a AS (SELECT recording, label, start_us, end_us, CASE WHEN lag(label) OVER w = label AND lag(end_us) OVER w >= start_us THEN 0 ELSE 1 END AS f FROM ref WINDOW w AS (PARTITION BY recording ORDER BY start_us, end_us, label)),
b AS (SELECT *, sum(f) OVER (PARTITION BY recording ORDER BY start_us, end_us, label, f DESC ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT recording, label, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM b GROUP BY recording, label, g""")
def label_runs(spark: SparkSession, d: str) -> DataFrame:
    return I.label_runs(ref_spans(spark, d).select("recording", "start_us", "end_us", "label"), K)


@query(_with(sql_union("m", "SELECT recording, start_us, end_us FROM ref"), sql_cells("c", {"u": "SELECT recording, start_us, end_us FROM scope", "x": "SELECT recording, start_us, end_us FROM m"}), sql_union("s", "SELECT recording, start_us, end_us FROM c WHERE u > 0 AND x = 0")) + " SELECT recording, start_us, end_us, 'SPEECH' AS label FROM m UNION ALL SELECT recording, start_us, end_us, 'NON_SPEECH' FROM s")
def silence_filled(spark: SparkSession, d: str) -> DataFrame:
    speech = continuous_periods(ref_spans(spark, d), K).select("recording", "start_us", "end_us", F.lit("SPEECH").alias("label"))
    return I.with_silence(speech, scope(spark, d), K)


@query(_with(sql_union("un", "SELECT recording, start_us, end_us FROM hyp WHERE label = 'UNKNOWN'"), sql_union("co", "SELECT recording, start_us, end_us FROM ref WHERE label = 'REF_00'"), sql_cells("c", {"u": "SELECT recording, start_us, end_us FROM un", "x": "SELECT recording, start_us, end_us FROM co"}), sql_union("op", "SELECT recording, start_us, end_us FROM c WHERE u > 0 AND x = 0")) + """
SELECT recording, start_us, end_us, 'UNKNOWN' AS label FROM op UNION ALL
SELECT un.recording, greatest(un.start_us, co.start_us), least(un.end_us, co.end_us), 'HUMAN' FROM un JOIN co ON un.recording = co.recording AND un.start_us < co.end_us AND co.start_us < un.end_us""")
def corrected_spans(spark: SparkSession, d: str) -> DataFrame:
    unknown = continuous_periods(hyp_spans(spark, d).where("label = 'UNKNOWN'"), K).select("recording", "start_us", "end_us", F.lit("UNKNOWN").alias("label"))
    human = continuous_periods(ref_spans(spark, d).where("label = 'REF_00'"), K).select("recording", "start_us", "end_us", F.lit("HUMAN").alias("label"))
    return I.corrected(unknown, human, K)


_SCORES = _with(_CELLS, _FLAGS) + """, q AS (SELECT *, r0 + r1 AS r, h0 + h1 AS h FROM cells),
s AS (SELECT recording, sum(dur * r) AS ref_us, sum(dur * greatest(0, r - h)) AS miss_us, sum(dur * greatest(0, h - r)) AS fa_us, sum(dur * least(r, h)) AS both_us,
 sum(dur * r0) AS r0_us, sum(dur * r1) AS r1_us, sum(dur * h0) AS h0_us, sum(dur * h1) AS h1_us, sum(dur * r0 * h0) AS c00, sum(dur * r0 * h1) AS c01, sum(dur * r1 * h0) AS c10, sum(dur * r1 * h1) AS c11,
 sum(dur) FILTER (WHERE r = 1 AND r0 = 1) AS s0, sum(dur) FILTER (WHERE r = 1 AND r1 = 1) AS s1, sum(dur) FILTER (WHERE r = 1 AND r0 = 1 AND h > 0) AS a0, sum(dur) FILTER (WHERE r = 1 AND r1 = 1 AND h > 0) AS a1,
 sum(dur) FILTER (WHERE r = 1 AND r0 = 1 AND h = 1 AND h0 = 1) AS k00, sum(dur) FILTER (WHERE r = 1 AND r0 = 1 AND h = 1 AND h1 = 1) AS k01, sum(dur) FILTER (WHERE r = 1 AND r1 = 1 AND h = 1 AND h0 = 1) AS k10, sum(dur) FILTER (WHERE r = 1 AND r1 = 1 AND h = 1 AND h1 = 1) AS k11,
 coalesce(sum(dur) FILTER (WHERE r = 2 AND h = 2), 0) AS o_tp, coalesce(sum(dur) FILTER (WHERE r < 2 AND h = 2), 0) AS o_fp, coalesce(sum(dur) FILTER (WHERE r = 2 AND h < 2), 0) AS o_fn FROM q GROUP BY recording),
m AS (SELECT *, c01 + c10 > c00 + c11 AS swapped FROM s),
n AS (SELECT *, CASE WHEN swapped THEN c01 ELSE c00 END AS g0, CASE WHEN swapped THEN c10 ELSE c11 END AS g1, CASE WHEN swapped THEN h1_us ELSE h0_us END AS m0, CASE WHEN swapped THEN h0_us ELSE h1_us END AS m1 FROM m),
scores AS (SELECT recording, swapped, CAST(ref_us AS BIGINT) AS ref_us, CAST(miss_us AS BIGINT) AS miss_us, CAST(fa_us AS BIGINT) AS fa_us, CAST(both_us - g0 - g1 AS BIGINT) AS conf_us,
 round(coalesce(CAST(miss_us + fa_us + both_us - g0 - g1 AS DOUBLE) / nullif(CAST(ref_us AS DOUBLE), 0), 0), 9) AS der,
 round(coalesce((CASE WHEN r0_us > 0 THEN 1 - CAST(g0 AS DOUBLE) / CAST(r0_us + m0 - g0 AS DOUBLE) ELSE 0 END + CASE WHEN r1_us > 0 THEN 1 - CAST(g1 AS DOUBLE) / CAST(r1_us + m1 - g1 AS DOUBLE) ELSE 0 END) / nullif(CAST((r0_us > 0)::INT + (r1_us > 0)::INT AS DOUBLE), 0), 0), 9) AS jer,
 round(coalesce(CAST(a0 AS DOUBLE) / nullif(CAST(s0 AS DOUBLE), 0), 0), 9) AS coverage_0, round(coalesce(CAST(a1 AS DOUBLE) / nullif(CAST(s1 AS DOUBLE), 0), 0), 9) AS coverage_1,
 round(coalesce(CAST(coalesce(CASE WHEN swapped THEN k01 ELSE k00 END, 0) AS DOUBLE) / nullif(CAST(a0 AS DOUBLE), 0), 0), 9) AS accuracy_0, round(coalesce(CAST(coalesce(CASE WHEN swapped THEN k10 ELSE k11 END, 0) AS DOUBLE) / nullif(CAST(a1 AS DOUBLE), 0), 0), 9) AS accuracy_1,
 CAST(o_tp AS BIGINT) AS o_tp, CAST(o_fp AS BIGINT) AS o_fp, CAST(o_fn AS BIGINT) AS o_fn FROM n)"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return S.recording_scores(S.cell_sums(_cells(spark, d), K), K)


@query(_SCORES + " SELECT * FROM scores")
def der_by_recording(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


_PRF = "CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE round(coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0), 9) END AS {c}"


@query(_SCORES + ", o AS (SELECT recording, o_tp AS tp, o_fp AS fp, o_fn AS fn FROM scores) SELECT recording, tp, fp, fn, " + ", ".join(_PRF.format(a=a, b=b, c=c) for a, b, c in (("tp", "tp + fp", "precision"), ("tp", "tp + fn", "recall"), ("2 * tp", "2 * tp + fp + fn", "f1"))) + " FROM o")
def overlap_prf(spark: SparkSession, d: str) -> DataFrame:
    o = _scores(spark, d).select("recording", F.col("o_tp").alias("tp"), F.col("o_fp").alias("fp"), F.col("o_fn").alias("fn"))
    return o.select("*", *S.f_scores(F.col("tp"), F.col("fp"), F.col("fn")))


@query(_SCORES + """, g AS (SELECT *, split_part(recording, '/', 2) AS channel FROM scores), l AS (SELECT 'all' AS dim, '' AS value, * FROM g UNION ALL SELECT 'channel', channel, * FROM g UNION ALL SELECT 'swapped', CAST(swapped AS VARCHAR), * FROM g)
SELECT dim, value, count(*) AS n_recordings, round(coalesce(CAST(sum(miss_us + fa_us + conf_us) AS DOUBLE) / nullif(CAST(sum(ref_us) AS DOUBLE), 0), 0), 9) AS pooled_der, round(avg(der), 9) AS mean_der, round(max(der), 9) AS worst_der FROM l GROUP BY 1, 2""")
def corpus_subgroups(spark: SparkSession, d: str) -> DataFrame:
    return S.subgroup_scores(_scores(spark, d).withColumn("channel", F.split_part("recording", F.lit("/"), F.lit(2))), ["channel", "swapped"])


@query(_SCORES + """, p AS (SELECT der, row_number() OVER (ORDER BY recording) - 1 AS k FROM scores), t AS (SELECT count(*) AS n FROM scores),
dr AS (SELECT i.i, CAST(CAST(('0x' || substr(sha256('17029:' || i.i || ':' || j.j || ':' || t.n), 1, 16)) AS UBIGINT) % t.n AS BIGINT) AS k FROM t, range(2000) i(i), range(t.n) j(j)),
b AS (SELECT i, avg(der) AS m FROM dr JOIN p USING (k) GROUP BY i)
SELECT (SELECT n FROM t) AS n, (SELECT round(avg(der), 9) FROM scores) AS mean, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM b""")
def bootstrap_der_mean(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the mean error rate of the recordings."""
    return S.bootstrap_ci(_scores(spark, d), "der")


@query()
def bootstrap_der_ci(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of the scorer's metrics, recordings resampled 2,000 times.

    Parts are made one after another: as one plan they took the driver's memory, and scans made their input again.
    """
    inside = scope(spark, d)
    points = lambda spans, labels: cut(I.points_inside(S.change_boundaries(spans, K, labels), inside, K, "at"), "points")
    changes = cut(S.boundary_matches(points(ref_spans(spark, d), S.REF), points(hyp_spans(spark, d), S.HYP), K, "at", 500_000), "changes")
    spoken = words(spark, d).drop("text")
    held = I.interval_join(spoken, continuous_periods(inside, K).drop("n_rows"), K).where("other_start_us <= start_us AND end_us <= other_end_us").select(*spoken.columns)
    said = S.attributed_words(held, hyp_spans(spark, d), K)
    return S.scoring_suite(S.suite_rows(cut(S.cell_sums(_cells(spark, d), K), "sums"), changes, said, K))


@query(_SCORES + " SELECT count(*) AS n_recordings, round(max(abs(coverage_0 - coverage_1)), 9) AS worst_coverage_gap, round(avg(abs(coverage_0 - coverage_1)), 9) AS mean_coverage_gap, round(min(least(accuracy_0, accuracy_1)), 9) AS worst_accuracy FROM scores")
def fairness_gaps(spark: SparkSession, d: str) -> DataFrame:
    gap = F.abs(F.col("coverage_0") - F.col("coverage_1"))
    return _scores(spark, d).agg(F.count("*").alias("n_recordings"), F.round(F.max(gap), 9).alias("worst_coverage_gap"), F.round(F.avg(gap), 9).alias("mean_coverage_gap"), F.round(F.min(F.least("accuracy_0", "accuracy_1")), 9).alias("worst_accuracy"))


@query(_SCORES + """, gm AS (SELECT round(avg(der), 9) AS der, round(avg(jer), 9) AS jer, round(avg(coverage_0), 9) AS coverage, round(avg(accuracy_0), 9) AS accuracy FROM scores), v AS (SELECT * FROM (VALUES ('der', 0.15, false), ('jer', 0.25, false), ('coverage', 0.85, true), ('accuracy', 0.95, true)) t(metric, threshold, up)),
l AS (SELECT metric, CAST(threshold AS DOUBLE) AS threshold, up, CASE metric WHEN 'der' THEN der WHEN 'jer' THEN jer WHEN 'coverage' THEN coverage ELSE accuracy END AS value FROM v, gm)
SELECT metric, value, threshold, CASE WHEN value IS NULL THEN 'NOT_EVALUATED' WHEN (up AND value >= threshold) OR (NOT up AND value <= threshold) THEN 'PASS' ELSE 'FAIL' END AS outcome FROM l""")
def gate_table(spark: SparkSession, d: str) -> DataFrame:
    gates = (("der", "der", 0.15, False), ("jer", "jer", 0.25, False), ("coverage", "coverage_0", 0.85, True), ("accuracy", "accuracy_0", 0.95, True))
    means = _scores(spark, d).agg(*[F.round(F.avg(c), 9).alias(n) for n, c, _, _ in gates])
    rows = means.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), F.lit(t).alias("threshold"), F.lit(up).alias("up")) for n, _, t, up in gates])).alias("g")).select("g.*")
    return rows.select("metric", "value", "threshold", threshold_outcome(F.col("value"), F.col("threshold"), F.col("up")).alias("outcome"))


_WORDS = _with(_HFLAT) + """, wc AS (SELECT w.recording, w.word_id, h.label AS l, sum(least(w.end_us, h.end_us) - greatest(w.start_us, h.start_us)) AS c FROM words w JOIN hf h ON h.recording = w.recording AND h.start_us < w.end_us AND w.start_us < h.end_us GROUP BY ALL),
wp AS (SELECT recording, word_id, coalesce(sum(c) FILTER (WHERE l = 'A'), 0) AS a, coalesce(sum(c) FILTER (WHERE l = 'B'), 0) AS b FROM wc GROUP BY 1, 2),
att AS (SELECT w.*, CAST(coalesce(a, 0) AS BIGINT) AS first_us, CAST(coalesce(b, 0) AS BIGINT) AS second_us FROM words w LEFT JOIN wp USING (recording, word_id)),
aw AS (SELECT *, CASE WHEN first_us * 100 >= (end_us - start_us) * 20 AND second_us * 100 >= (end_us - start_us) * 20 THEN 'UNKNOWN_BOUNDARY' WHEN first_us * 100 >= (end_us - start_us) * 80 THEN 'A' WHEN second_us * 100 >= (end_us - start_us) * 80 THEN 'B' ELSE 'UNKNOWN_WEAK' END AS word_label FROM att)"""


def _words(spark: SparkSession, d: str) -> DataFrame:
    return S.attributed_words(words(spark, d), hyp_spans(spark, d), K)


@query(_WORDS + " SELECT * FROM aw")
def word_attribution(spark: SparkSession, d: str) -> DataFrame:
    return _words(spark, d)


@query(_WORDS + """ SELECT label, count(*) AS n_words, count(*) FILTER (WHERE word_label IN ('A', 'B')) AS n_assigned, count(*) FILTER (WHERE (label = 'REF_00' AND word_label = 'A') OR (label = 'REF_01' AND word_label = 'B')) AS n_right,
 round(coalesce(count(*) FILTER (WHERE (label = 'REF_00' AND word_label = 'A') OR (label = 'REF_01' AND word_label = 'B')) / nullif(count(*) FILTER (WHERE word_label IN ('A', 'B')), 0), 0), 9) AS precision, round(count(*) FILTER (WHERE word_label IN ('A', 'B')) / count(*), 9) AS coverage FROM aw GROUP BY 1""")
def word_metrics(spark: SparkSession, d: str) -> DataFrame:
    given = F.count(F.when(F.col("word_label").isin("A", "B"), 1))
    right = F.count(F.when((F.col("label") == "REF_00") & (F.col("word_label") == "A") | (F.col("label") == "REF_01") & (F.col("word_label") == "B"), 1))
    return _words(spark, d).groupBy("label").agg(F.count("*").alias("n_words"), given.alias("n_assigned"), right.alias("n_right"), S.ratio(right, given).alias("precision"), S.ratio(given, F.count("*")).alias("coverage"))


_WT = _WORDS + """, wa AS (SELECT *, CASE WHEN lag(word_label) OVER w = word_label AND start_us - lag(end_us) OVER w <= 1000000 THEN 0 ELSE 1 END AS f FROM aw WINDOW w AS (PARTITION BY recording ORDER BY start_us, word_id)),
wb AS (SELECT *, sum(f) OVER (PARTITION BY recording ORDER BY start_us, word_id ROWS UNBOUNDED PRECEDING) AS turn FROM wa)"""


@query(_WT + " SELECT recording, CAST(turn AS BIGINT) AS turn, any_value(word_label) AS label, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_words, string_agg(text, ' ' ORDER BY start_us, word_id) AS text FROM wb GROUP BY 1, 2")
def speaker_turns(spark: SparkSession, d: str) -> DataFrame:
    return Q.speaker_turns(_words(spark, d), K)


@query(_WORDS + " SELECT recording, word_label, string_agg(text, ' ' ORDER BY start_us, word_id) AS text, count(*) AS n_words FROM aw GROUP BY 1, 2")
def texts_by_speaker(spark: SparkSession, d: str) -> DataFrame:
    return speaker_texts(_words(spark, d), K, "word_label", ["start_us", "word_id"])


@query(f"""WITH RECURSIVE {VIEWS}, r AS (SELECT recording, list_sort(list(DISTINCT start_us)) AS r FROM ref GROUP BY 1), h AS (SELECT recording, list_sort(list(DISTINCT start_us)) AS h FROM hyp GROUP BY 1), b AS (SELECT recording, coalesce(r, []) AS r, coalesce(h, []) AS h FROM r FULL JOIN h USING (recording)),""" + """
m AS (SELECT recording, r, h, 1 AS i, 1 AS k, 0 AS tp FROM b UNION ALL
  SELECT recording, r, h, CASE WHEN abs(h[k] - r[i]) <= 150000 OR h[k] > r[i] THEN i + 1 ELSE i END, CASE WHEN abs(h[k] - r[i]) <= 150000 OR h[k] < r[i] THEN k + 1 ELSE k END, CASE WHEN abs(h[k] - r[i]) <= 150000 THEN tp + 1 ELSE tp END FROM m WHERE i <= len(r) AND k <= len(h)),
e AS (SELECT recording, tp, len(h) - tp AS fp, len(r) - tp AS fn FROM m WHERE i > len(r) OR k > len(h))
SELECT *, """ + ", ".join(_PRF.format(a=a, b=b, c=c) for a, b, c in (("tp", "tp + fp", "precision"), ("tp", "tp + fn", "recall"), ("2 * tp", "2 * tp + fp + fn", "f1"))) + " FROM e")
def boundary_prf(spark: SparkSession, d: str) -> DataFrame:
    starts = lambda df: df.select("recording", F.col("start_us").alias("at")).distinct()
    found = S.boundary_matches(starts(ref_spans(spark, d)), starts(hyp_spans(spark, d)), K, "at", 150_000)
    return found.select("*", *S.f_scores(F.col("tp"), F.col("fp"), F.col("fn")))


_NEAR = """, kn AS (SELECT *, CASE WHEN label <> 'UNKNOWN' THEN {'l': label, 's': start_us, 'e': end_us} END AS k FROM hyp),
nb AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY recording ORDER BY start_us, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(k IGNORE NULLS) OVER (PARTITION BY recording ORDER BY start_us, row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM kn)
SELECT row_id, recording, label, start_us, end_us, a.l AS consensus FROM nb WHERE label = 'UNKNOWN' AND a.l = b.l AND start_us - a.e <= 2000000 AND b.s - end_us <= 2000000"""


@query("WITH " + VIEWS + _NEAR)
def neighbour_consensus(spark: SparkSession, d: str) -> DataFrame:
    return Q.neighbour_consensus(hyp_spans(spark, d), K, "label", "UNKNOWN", 2_000_000)


_COSTS = """, tg AS (SELECT *, start_us - lag(end_us) OVER (PARTITION BY recording ORDER BY start_us, row_id) AS gap_us FROM hyp),
tc AS (SELECT *, CASE WHEN gap_us IS NULL OR gap_us >= 1500000 THEN 0.0 ELSE round(CAST(0.35 AS DOUBLE) * (1 - least(CAST(1 AS DOUBLE), greatest(0, gap_us) / CAST(1000000 AS DOUBLE))), 9) END AS switch_cost FROM tg)"""


@query("WITH " + VIEWS + _COSTS + " SELECT * FROM tc")
def transition_costs(spark: SparkSession, d: str) -> DataFrame:
    return Q.transition_costs(hyp_spans(spark, d), K)


_DECODED = "WITH RECURSIVE " + VIEWS + _COSTS + """, ti AS (SELECT *, CASE WHEN gap_us < 1500000 THEN 0 ELSE 1 END AS z FROM tc), tp AS (SELECT *, sum(z) OVER (PARTITION BY recording ORDER BY start_us, row_id) AS piece FROM ti),
tn AS (SELECT recording, piece, row_number() OVER (PARTITION BY recording, piece ORDER BY start_us, row_id) AS n, row_id, CAST(switch_cost AS DOUBLE) AS w, CAST(0.25 AS DOUBLE) AS eu, CAST(CASE label WHEN 'A' THEN 0.0 WHEN 'UNKNOWN' THEN 0.3 ELSE 0.5 END AS DOUBLE) AS ea, CAST(CASE label WHEN 'B' THEN 0.0 WHEN 'UNKNOWN' THEN 0.3 ELSE 0.5 END AS DOUBLE) AS eb FROM tp),
d AS (SELECT recording, piece, n, eu AS cu, ea AS ca, eb AS cb, ['UNKNOWN'] AS pu, ['A'] AS pa, ['B'] AS pb FROM tn WHERE n = 1 UNION ALL
  SELECT recording, piece, n, least(uu, ua, ub), least(au, aa, ab), least(bu, ba, bb),
   list_append(CASE WHEN uu <= ua AND uu <= ub THEN pu WHEN ua <= ub THEN pa ELSE pb END, 'UNKNOWN'), list_append(CASE WHEN au <= aa AND au <= ab THEN pu WHEN aa <= ab THEN pa ELSE pb END, 'A'), list_append(CASE WHEN bu <= ba AND bu <= bb THEN pu WHEN ba <= bb THEN pa ELSE pb END, 'B')
  FROM (SELECT d.recording, d.piece, t.n, pu, pa, pb, cu + 0.0 + eu AS uu, ca + w + eu AS ua, cb + w + eu AS ub, cu + w + ea AS au, ca + 0.0 + ea AS aa, cb + w + ea AS ab, cu + w + eb AS bu, ca + w + eb AS ba, cb + 0.0 + eb AS bb FROM d JOIN tn t ON t.recording = d.recording AND t.piece = d.piece AND t.n = d.n + 1)),
dl AS (SELECT recording, piece, max(n) AS n FROM d GROUP BY 1, 2), dz AS (SELECT d.recording, d.piece, least(cu, ca, cb) AS cost, CASE WHEN cu <= ca AND cu <= cb THEN pu WHEN ca <= cb THEN pa ELSE pb END AS path FROM d JOIN dl USING (recording, piece, n))
SELECT t.row_id, path[t.n] AS label, cost FROM dz JOIN tn t USING (recording, piece)"""


@query(_DECODED)
def decoded_labels(spark: SparkSession, d: str) -> DataFrame:
    costs = Q.transition_costs(hyp_spans(spark, d), K)
    at = F.col("label")
    wrong = lambda x: F.when(at == x, 0.0).when(at == "UNKNOWN", 0.3).otherwise(0.5)
    return Q.decoded_labels(costs, K, {"UNKNOWN": F.lit(0.25), "A": wrong("A"), "B": wrong("B")})


@query("WITH " + VIEWS + ", p AS (SELECT recording, label, lag(label) OVER (PARTITION BY recording ORDER BY start_us, row_id) AS q FROM hyp) SELECT recording, bool_or(coalesce(q = 'A' AND label = 'B', false)) AS forth, bool_or(coalesce(q = 'B' AND label = 'A', false)) AS back, bool_or(coalesce(q = 'A' AND label = 'B', false)) AND bool_or(coalesce(q = 'B' AND label = 'A', false)) AS interleaved FROM p GROUP BY 1")
def interleaving(spark: SparkSession, d: str) -> DataFrame:
    return Q.interleaving(hyp_spans(spark, d), K, "label", "A", "B")


_ISO = """, p AS (SELECT *, lag(label) OVER w AS a, lead(label) OVER w AS b, row_number() OVER w AS k FROM hyp WINDOW w AS (PARTITION BY recording ORDER BY start_us, row_id)),
can AS (SELECT *, label <> 'UNKNOWN' AND a IS NOT NULL AND end_us - start_us <= 350000 AS can FROM p),
c AS (SELECT *, coalesce(can AND a = b AND a <> label, false) AS c0, coalesce(can AND b = 'UNKNOWN', false) AS c1 FROM can),
n AS (SELECT *, sum((c0 AND NOT c1)::INT) OVER (PARTITION BY recording ORDER BY k) AS n FROM c),
z AS (SELECT *, max(CASE WHEN c0 = c1 THEN {'k': k, 'v': c0, 'n': n} END) OVER (PARTITION BY recording ORDER BY k) AS fx FROM n)
SELECT row_id, recording, CASE WHEN ((n - fx.n) % 2 = 1) <> fx.v THEN 'UNKNOWN' ELSE label END AS label, start_us, end_us FROM z"""


@query("WITH " + VIEWS + _ISO)
def isolated_runs(spark: SparkSession, d: str) -> DataFrame:
    return Q.isolated_runs(hyp_spans(spark, d), K, "label", 350_000, "UNKNOWN")


@query("WITH " + VIEWS + ", l AS (SELECT recording, string_agg(concat_ws('|', start_us, end_us, label), chr(10) ORDER BY start_us, end_us, label) AS t, count(*) AS n_rows FROM ref GROUP BY 1) SELECT recording, sha256(t) AS digest, n_rows FROM l")
def timeline_digests(spark: SparkSession, d: str) -> DataFrame:
    return timeline_digest(ref_spans(spark, d), K, ["start_us", "end_us", "label"])


@query("SELECT row_id, 'span_' || substr(sha256(concat_ws('|', recording, label, start_us, end_us)), 1, 20) AS span_id FROM ref")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return ref_spans(spark, d).select("row_id", stable_id("span", F.col("recording"), F.col("label"), F.col("start_us"), F.col("end_us")).alias("span_id"))


_SEC = "(({0}) // 1000000) || '.' || lpad(CAST(({0}) % 1000000 AS VARCHAR), 6, '0')"


@query("SELECT row_id, concat_ws(' ', 'SPEAKER', split_part(recording, '/', 1), split_part(recording, '/', 2), " + _SEC.format("start_us") + ", " + _SEC.format("end_us - start_us") + ", '<NA>', '<NA>', label, '<NA>', '<NA>') AS line FROM ref")
def rttm_text(spark: SparkSession, d: str) -> DataFrame:
    t = ref_spans(spark, d).select("row_id", F.split_part("recording", F.lit("/"), F.lit(1)).alias("file_id"), F.split_part("recording", F.lit("/"), F.lit(2)).alias("channel"), F.col("label").alias("speaker_id"), "start_us", "end_us")
    return t.select("row_id", F.concat_ws(" ", F.lit("SPEAKER"), "file_id", "channel", *[F.format_string("%d.%06d", F.floor(c / 1_000_000), F.pmod(c, F.lit(1_000_000))) for c in (F.col("start_us"), F.col("end_us") - F.col("start_us"))], F.lit("<NA>"), F.lit("<NA>"), "speaker_id", F.lit("<NA>"), F.lit("<NA>")).alias("line"))


@query("SELECT concat_ws(' ', split_part(recording, '/', 1), split_part(recording, '/', 2), " + _SEC.format("start_us") + ", " + _SEC.format("end_us") + ") AS value FROM scope")
def uem_text(spark: SparkSession, d: str) -> DataFrame:
    return uem_lines(scope(spark, d).select(F.split_part("recording", F.lit("/"), F.lit(1)).alias("file_id"), F.split_part("recording", F.lit("/"), F.lit(2)).alias("channel"), "start_us", "end_us"))


@query("SELECT recording, label, count(*) AS n_spans, CAST(sum(end_us - start_us) AS BIGINT) AS total_us, CAST(max(end_us - start_us) AS BIGINT) AS longest_us FROM hyp GROUP BY 1, 2")
def span_counts(spark: SparkSession, d: str) -> DataFrame:
    return Y.span_counts(hyp_spans(spark, d), K)


_STAB = sql_cells("st", {"a": "SELECT * FROM hyp WHERE label = 'A'", "b": "SELECT * FROM hyp WHERE label = 'B'", "x": "SELECT * FROM ref WHERE label = 'REF_00'", "y": "SELECT * FROM ref WHERE label = 'REF_01'"})


@query(_with(_STAB) + """ SELECT recording, round(coalesce(CAST(sum(CASE WHEN (x > 0 AND a > 0) OR (y > 0 AND b > 0) THEN end_us - start_us END) AS DOUBLE) / nullif(CAST(sum(CASE WHEN x + y > 0 THEN end_us - start_us END) AS DOUBLE), 0), 0), 9) AS retention,
 round(coalesce(CAST(sum(CASE WHEN a + b > 0 AND x + y > 0 THEN end_us - start_us END) AS DOUBLE) / nullif(CAST(sum(CASE WHEN a + b + x + y > 0 THEN end_us - start_us END) AS DOUBLE), 0), 0), 9) AS speech_iou FROM st GROUP BY 1""")
def stability_audit(spark: SparkSession, d: str) -> DataFrame:
    """Share of assigned time that keeps its label in the other system, and speech in common."""
    ref, hyp = ref_spans(spark, d), hyp_spans(spark, d)
    pick = lambda df, label: df.where(F.col("label") == label)
    c = sweep({"a": pick(hyp, "A"), "b": pick(hyp, "B"), "x": pick(ref, "REF_00"), "y": pick(ref, "REF_01")}, K)
    us = lambda cond: F.coalesce(F.sum(F.when(F.expr(cond), F.col("end_us") - F.col("start_us"))), F.lit(0))
    return c.groupBy("recording").agg(S.ratio(us("(x > 0 AND a > 0) OR (y > 0 AND b > 0)"), us("x + y > 0")).alias("retention"), S.ratio(us("a + b > 0 AND x + y > 0"), us("a + b + x + y > 0")).alias("speech_iou"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
