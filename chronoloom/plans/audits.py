"""Queries on full attribution, local decisions, stability, safety and contracts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import attribution as A
from chronoloom.operators import audits as U
from chronoloom.operators import scoring as S
from chronoloom.operators import sequences as Q
from chronoloom.operators import vectors as V
from chronoloom.plans import tables as TB
from chronoloom.plans.training_data import table
from chronoloom.plans.views import VIEWS, frames, hyp_spans, ref_spans, scope, sql_cells, sql_union, words

K = ["recording"]
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {VIEWS} {sql}"
        return f

    return add


# every kind of span a system may give: overlap, a third speaker and silence beside the two labels
_SAID = "said AS (SELECT row_id, recording, CASE WHEN row_id % 29 = 0 THEN 'OVERLAP' WHEN row_id % 31 = 0 THEN 'OTHER' WHEN row_id % 37 = 0 THEN 'NON_SPEECH' ELSE label END AS label, start_us, end_us FROM hyp), spoken AS (SELECT *, ascii(substr(text, 2)) % 7 = 0 AS crosses FROM words)"
_MAPPED = f"""WITH {VIEWS}, {_SAID}, l AS (SELECT w.recording, w.word_id, w.start_us, w.end_us, w.text, w.label AS truth, w.crosses, s.row_id AS span, s.label, coalesce(least(w.end_us, s.end_us) - greatest(w.start_us, s.start_us), 0) AS us
  FROM spoken w LEFT JOIN said s ON s.recording = w.recording AND s.start_us < w.end_us AND w.start_us < s.end_us),
g AS (SELECT recording, word_id, start_us, end_us, text, truth, crosses, sum(CASE WHEN label = 'A' THEN us ELSE 0 END) AS a, sum(CASE WHEN label = 'B' THEN us ELSE 0 END) AS b, sum(CASE WHEN label = 'OVERLAP' THEN us ELSE 0 END) AS o,
  sum(CASE WHEN label IN ('UNKNOWN', 'NON_SPEECH') THEN us ELSE 0 END) AS n, sum(CASE WHEN label = 'OTHER' THEN us ELSE 0 END) AS x, coalesce(list_sort(list(DISTINCT span) FILTER (WHERE span IS NOT NULL)), []) AS evidence FROM l GROUP BY ALL),
m AS (SELECT *, end_us - start_us AS d, CASE WHEN crosses THEN 'UNKNOWN_TIMEWARP_BOUNDARY' WHEN o > 0 THEN 'OVERLAP_UNATTRIBUTED' WHEN a * 100 >= (end_us - start_us) * 20 AND b * 100 >= (end_us - start_us) * 20 THEN 'UNKNOWN_BOUNDARY'
  WHEN greatest(a, b) > 0 AND greatest(a, b) * 100 >= (end_us - start_us) * 80 AND n * 100 <= (end_us - start_us) * 20 THEN 'ASSIGNED' WHEN greatest(a, b) = 0 AND x > 0 THEN 'OTHER' ELSE 'UNKNOWN_INSUFFICIENT_EVIDENCE' END AS status FROM g),
mapped AS (SELECT recording, word_id, start_us, end_us, text, truth, CASE status WHEN 'ASSIGNED' THEN CASE WHEN a >= b THEN 'A' ELSE 'B' END WHEN 'OVERLAP_UNATTRIBUTED' THEN 'OVERLAP' WHEN 'OTHER' THEN 'OTHER' ELSE 'UNKNOWN' END AS speaker, status, array_to_string(evidence, ',') AS evidence FROM m)"""


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("row_id")
    said = hyp_spans(spark, d).withColumn("label", F.when(r % 29 == 0, "OVERLAP").when(r % 31 == 0, "OTHER").when(r % 37 == 0, "NON_SPEECH").otherwise(F.col("label")))
    spoken = words(spark, d).select("recording", "word_id", "start_us", "end_us", "text", F.col("label").alias("truth"), (F.ascii(F.substring("text", 2, 1)) % 7 == 0).alias("crosses"))
    return A.mapped_words(spoken, said, K, crosses="crosses").drop("crosses")


def _listed(df: DataFrame) -> DataFrame:
    return df.withColumn("evidence", F.array_join("evidence", ","))


@query(_MAPPED + " SELECT * FROM mapped")
def mapped_words(spark: SparkSession, d: str) -> DataFrame:
    return _listed(_mapped(spark, d))


@query(_MAPPED + " SELECT recording, word_id, start_us, end_us, text, truth, CASE WHEN speaker IN ('A', 'B', 'OTHER') THEN 'UNKNOWN' ELSE speaker END AS speaker, CASE WHEN speaker IN ('A', 'B', 'OTHER') THEN 'SPEAKER_NEUTRAL' ELSE status END AS status, CASE WHEN speaker IN ('A', 'B', 'OTHER') THEN '' ELSE evidence END AS evidence FROM mapped")
def neutral_words(spark: SparkSession, d: str) -> DataFrame:
    return _listed(A.neutral_words(_mapped(spark, d)))


@query("SELECT *, 'UNKNOWN' AS speaker, 'UNKNOWN_INSUFFICIENT_EVIDENCE' AS status, 'DIARIZATION_FAILED' AS reason FROM words")
def unattributed_words(spark: SparkSession, d: str) -> DataFrame:
    return A.unattributed_words(words(spark, d))


@query(_MAPPED + """, a AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker AND lag(status) OVER w = status AND lag(evidence) OVER w = evidence AND start_us - lag(end_us) OVER w <= 1000000 THEN 0 ELSE 1 END AS f FROM mapped WINDOW w AS (PARTITION BY recording ORDER BY start_us, word_id)),
b AS (SELECT *, sum(f) OVER (PARTITION BY recording ORDER BY start_us, word_id ROWS UNBOUNDED PRECEDING) AS turn FROM a)
SELECT recording, CAST(turn AS BIGINT) AS turn, any_value(speaker) AS label, any_value(status) AS status, any_value(evidence) AS evidence, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_words, string_agg(text, ' ' ORDER BY start_us, word_id) AS text FROM b GROUP BY 1, 2""")
def evidence_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns that end where the speaker, the status or the evidence changes."""
    return Q.speaker_turns(_listed(_mapped(spark, d)), K, "speaker", same=("status", "evidence"))


@query(_MAPPED + """, w AS (SELECT truth, status, (speaker = 'A') = (truth = 'REF_00') AS ok FROM mapped)
SELECT truth, count(*) AS n_words, count(*) FILTER (WHERE status = 'ASSIGNED') AS n_assigned, count(*) FILTER (WHERE status = 'OVERLAP_UNATTRIBUTED') AS n_overlap, count(*) FILTER (WHERE status = 'UNKNOWN_TIMEWARP_BOUNDARY') AS n_seam, count(*) FILTER (WHERE status = 'ASSIGNED' AND ok) AS n_right,
 round(coalesce(count(*) FILTER (WHERE status = 'ASSIGNED' AND ok) / nullif(count(*) FILTER (WHERE status = 'ASSIGNED'), 0), 0), 9) AS precision, round(coalesce(count(*) FILTER (WHERE status = 'ASSIGNED') / nullif(count(*) FILTER (WHERE status NOT IN ('OVERLAP_UNATTRIBUTED', 'UNKNOWN_TIMEWARP_BOUNDARY')), 0), 0), 9) AS coverage FROM w GROUP BY 1""")
def word_scores(spark: SparkSession, d: str) -> DataFrame:
    """Words told apart by what can be said of them: precision of the assigned, coverage of the attributable."""
    w = _mapped(spark, d)
    n = lambda cond: F.count(F.when(F.expr(cond), 1))
    right = "status = 'ASSIGNED' AND (speaker = 'A') = (truth = 'REF_00')"
    given, open_ = n("status = 'ASSIGNED'"), n("status NOT IN ('OVERLAP_UNATTRIBUTED', 'UNKNOWN_TIMEWARP_BOUNDARY')")
    return w.groupBy("truth").agg(F.count("*").alias("n_words"), given.alias("n_assigned"), n("status = 'OVERLAP_UNATTRIBUTED'").alias("n_overlap"), n("status = 'UNKNOWN_TIMEWARP_BOUNDARY'").alias("n_seam"), n(right).alias("n_right"), S.ratio(n(right), given).alias("precision"), S.ratio(given, open_).alias("coverage"))


# pieces of speech with the distances of their vectors to two voices
_VOICES = "v AS (SELECT label, list(s / n ORDER BY i) AS c FROM s JOIN n USING (label) WHERE label IN (0, 1) GROUP BY 1)"
_PIECES = f"""WITH {TB._UNIT}, {TB._CENTRE}, {_VOICES}, pd AS (SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'ANCHOR' WHEN 1 THEN 'SUPPORT' ELSE 'MICRO' END AS kind, vec_id % 41 = 0 AS overlap, vec_id % 43 = 0 AS mixed, vec_id % 47 <> 0 AS valid, vec_id % 53 <> 0 AS confirmed, 500000 + vec_id % 1000 * 1000 AS length_us, 400000 + vec_id % 900 * 1000 AS clean_us,
  round((1 - list_dot_product(u, (SELECT c FROM v WHERE label = 0))) / 3, 6) AS d0, round((1 - list_dot_product(u, (SELECT c FROM v WHERE label = 1))) / 3, 6) AS d1 FROM u),
pe AS (SELECT *, round(d0 - 0.2 * least(0.08, greatest(0, d0 - round(d0 * 0.9, 6))), 9) AS e0, round(d1 - 0.2 * least(0.08, greatest(0, d1 - round(d1 * 0.7, 6))), 9) AS e1 FROM pd),
pr AS (SELECT *, CASE WHEN e0 <= e1 THEN 'A' ELSE 'B' END AS s, least(e0, e1) AS e, CASE WHEN e0 <= e1 THEN d0 ELSE d1 END AS st, greatest(e0, e1) - least(e0, e1) AS m, CASE WHEN kind = 'MICRO' THEN 0.25 ELSE 0.35 END AS c0, CASE WHEN kind = 'MICRO' THEN 0.30 ELSE 0.40 END AS c1, CASE WHEN kind = 'MICRO' THEN 0.08 ELSE 0.03 END AS c2 FROM pe),
pf AS (SELECT *, concat_ws('+', CASE WHEN st > c0 THEN 'STABLE_DISTANCE' END, CASE WHEN e > c1 THEN 'ABSOLUTE_DISTANCE' END, CASE WHEN round(m, 12) < c2 THEN 'MARGIN' END) AS f FROM pr),
po AS (SELECT *, CASE WHEN overlap THEN 'PROTECTED_OVERLAP' WHEN NOT confirmed THEN 'HYPOTHESIS_UNCONFIRMED' WHEN mixed OR NOT valid THEN 'MIXED_OR_INVALID_EMBEDDING' WHEN f <> '' THEN 'LOCAL_GATE_' || f ELSE 'LOCAL_CANDIDATE' END AS reason FROM pf),
pieces AS (SELECT *, CASE WHEN reason = 'PROTECTED_OVERLAP' THEN 'OVERLAP' WHEN reason = 'LOCAL_CANDIDATE' THEN s ELSE 'UNKNOWN' END AS speaker, CASE WHEN reason = 'PROTECTED_OVERLAP' THEN 'OVERLAP' WHEN reason = 'LOCAL_CANDIDATE' THEN CASE WHEN kind = 'MICRO' THEN 'CANDIDATE_SPEAKER' ELSE 'LOCAL_CANDIDATE' END WHEN kind = 'MICRO' THEN 'UNKNOWN_SHORT' ELSE 'UNKNOWN_INSUFFICIENT_EVIDENCE' END AS status,
  reason = 'LOCAL_CANDIDATE' OR reason LIKE 'LOCAL_GATE_%' AS scored FROM po)"""
_DIST = {"A": ("d0", "e0"), "B": ("d1", "e1")}


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("w", 1 + F.col("vec_id") % 5)
    voices = V.weighted_centroids(e.where("label IN (0, 1)"), ["label"], "embedding", "w").agg(*[F.max(F.when(F.col("label") == k, F.col("centroid"))).alias(f"_v{k}") for k in range(2)])
    i = F.col("vec_id")
    far = lambda k: F.round((1 - V.dot(V.unit(F.col("embedding")), F.col(f"_v{k}"))) / 3, 6).alias(f"d{k}")
    kind = F.when(i % 3 == 0, "ANCHOR").when(i % 3 == 1, "SUPPORT").otherwise("MICRO")
    p = e.join(F.broadcast(voices)).select("vec_id", kind.alias("kind"), (i % 41 == 0).alias("overlap"), (i % 43 == 0).alias("mixed"), (i % 47 != 0).alias("valid"), (i % 53 != 0).alias("confirmed"), (500_000 + i % 1000 * 1000).alias("length_us"), (400_000 + i % 900 * 1000).alias("clean_us"), far(0), far(1))
    return p.select("*", *[F.round(A.effective_distance(F.col(f"d{k}"), F.round(F.col(f"d{k}") * x, 6)), 9).alias(f"e{k}") for k, x in enumerate((0.9, 0.7))])


@query(_PIECES + " SELECT vec_id, kind, speaker, status, CASE WHEN scored THEN st END AS stable, CASE WHEN scored THEN e END AS effective, CASE WHEN scored THEN round(m, 9) END AS margin, reason FROM pieces")
def local_decisions(spark: SparkSession, d: str) -> DataFrame:
    return A.local_decisions(_pieces(spark, d), _DIST).select("vec_id", "kind", "speaker", "status", "stable", "effective", F.round("margin", 9).alias("margin"), "reason")


@query(_PIECES + """, x AS (SELECT vec_id, unnest([CASE WHEN scored AND speaker IN ('A', 'B') THEN {'l': speaker, 'c': e} END, {'l': 'UNKNOWN', 'c': CASE WHEN kind = 'MICRO' THEN 0.02 ELSE 0.40 END}, CASE WHEN overlap THEN {'l': 'OVERLAP', 'c': 0.0} END, CASE WHEN vec_id % 59 = 0 THEN {'l': 'OTHER', 'c': 0.40} END]) AS x FROM pieces)
SELECT vec_id, x.l AS label, CAST(x.c AS DOUBLE) AS cost FROM x WHERE x IS NOT NULL""")
def emission_costs(spark: SparkSession, d: str) -> DataFrame:
    p = A.local_decisions(_pieces(spark, d), _DIST).withColumn("third", F.col("vec_id") % 59 == 0)
    return A.emission_costs(p, ("A", "B"), third_risk="third").select("vec_id", F.explode("emissions").alias("label", "cost"))


@query(_PIECES + """, x AS (SELECT vec_id, unnest([CASE WHEN d0 <= c0 AND e0 <= c1 THEN {'l': 'A', 'c': e0} END, CASE WHEN d1 <= c0 AND e1 <= c1 THEN {'l': 'B', 'c': e1} END]) AS x FROM pieces WHERE NOT overlap AND NOT mixed AND valid AND confirmed)
SELECT vec_id, x.l AS label, x.c AS cost FROM x WHERE x IS NOT NULL""")
def soft_emissions(spark: SparkSession, d: str) -> DataFrame:
    return A.soft_emissions(_pieces(spark, d), _DIST).select("vec_id", F.explode("emissions").alias("label", "cost"))


@query(_PIECES + " SELECT kind, valid, reason AS outcome, count(*) AS n, CAST(sum(length_us) AS BIGINT) AS duration_us, CAST(sum(clean_us) AS BIGINT) AS clean_us FROM pieces GROUP BY 1, 2, 3")
def decision_groups(spark: SparkSession, d: str) -> DataFrame:
    return A.decision_groups(A.local_decisions(_pieces(spark, d), _DIST).select("*"))


@query(_PIECES + ", x AS (SELECT *, CASE WHEN vec_id % 7 = 0 THEN 'A' ELSE speaker END AS final FROM pieces) SELECT kind, speaker AS local_label, final AS final_label, count(*) AS n, CAST(sum(length_us) AS BIGINT) AS duration_us FROM x WHERE speaker <> final GROUP BY 1, 2, 3")
def decoder_overrides(spark: SparkSession, d: str) -> DataFrame:
    p = A.local_decisions(_pieces(spark, d), _DIST).withColumn("final", F.when(F.col("vec_id") % 7 == 0, "A").otherwise(F.col("speaker")))
    return A.decoder_overrides(p, "final")


@query("WITH " + VIEWS + ", x AS (SELECT h.row_id, CASE WHEN h.row_id % 2 = 0 THEN 'A' WHEN h.row_id % 3 = 0 THEN 'B' ELSE h.label END AS now, CASE WHEN h.row_id % 5 <> 0 THEN CASE r.label WHEN 'REF_00' THEN 'A' ELSE 'B' END END AS truth FROM hyp h JOIN ref r USING (row_id) WHERE h.label = 'UNKNOWN') SELECT count(*) AS n_new, count(truth) AS n_known, count(*) FILTER (WHERE now = truth) AS n_right, round(count(*) FILTER (WHERE now = truth) / nullif(count(truth), 0), 9) AS precision FROM x WHERE now <> 'UNKNOWN'")
def rescue_precision(spark: SparkSession, d: str) -> DataFrame:
    h, r = hyp_spans(spark, d), F.col("row_id")
    new = h.withColumn("label", F.when(F.col("label") != "UNKNOWN", F.col("label")).when(r % 2 == 0, "A").when(r % 3 == 0, "B").otherwise(F.col("label")))
    truth = ref_spans(spark, d).where("row_id % 5 <> 0").withColumn("label", F.when(F.col("label") == "REF_00", "A").otherwise("B"))
    return A.rescue_precision(h, new, truth)


_FLAT = lambda name, src, a, b: (
    sql_cells(f"{name}_c", {"p": f"SELECT recording, start_us, end_us FROM {src} WHERE label = '{a}'", "q": f"SELECT recording, start_us, end_us FROM {src} WHERE label = '{b}'"})
    + f", {name}_s AS (SELECT recording, CASE WHEN p > 0 AND q > 0 THEN 'OVERLAP' WHEN p > 0 THEN '{a}' ELSE '{b}' END AS label, start_us, end_us FROM {name}_c WHERE p + q > 0),"
    + sql_union(f"{name}_u", f"SELECT recording, label, start_us, end_us FROM {name}_s", "recording, label") + f", {name} AS (SELECT recording, label, start_us, end_us FROM {name}_u)"
)
_STABLE = f"""WITH {VIEWS}, {_FLAT("base", "ref", "REF_00", "REF_01")}, {_FLAT("var0", "hyp", "A", "B")},
var AS (SELECT recording, CASE WHEN start_us // 1000000 % 9 = 0 THEN 'UNKNOWN' ELSE label END AS label, start_us, end_us FROM var0),
pr AS (SELECT b.recording, b.label AS l, v.label AS r, sum(least(b.end_us, v.end_us) - greatest(b.start_us, v.start_us)) AS us FROM base b JOIN var v ON v.recording = b.recording AND v.start_us < b.end_us AND b.start_us < v.end_us GROUP BY ALL),
mt AS (SELECT recording, bool_or(r = 'A') AS ra, bool_or(r = 'B') AS rb, bool_or(l = 'REF_00') AS l0, bool_or(l = 'REF_01') AS l1, coalesce(sum(us) FILTER (WHERE r = 'A' AND l = 'REF_00'), 0) AS a0, coalesce(sum(us) FILTER (WHERE r = 'A' AND l = 'REF_01'), 0) AS a1, coalesce(sum(us) FILTER (WHERE r = 'B' AND l = 'REF_00'), 0) AS b0, coalesce(sum(us) FILTER (WHERE r = 'B' AND l = 'REF_01'), 0) AS b1 FROM pr WHERE l <> 'OVERLAP' AND r IN ('A', 'B') GROUP BY 1),
mp AS (SELECT recording, CASE WHEN NOT ra THEN NULL WHEN ra AND rb AND l0 AND l1 THEN CASE WHEN a1 + b0 > a0 + b1 THEN 'REF_01' ELSE 'REF_00' END WHEN l0 AND l1 THEN CASE WHEN a1 > a0 THEN 'REF_01' ELSE 'REF_00' END WHEN l0 THEN 'REF_00' ELSE 'REF_01' END AS ma,
  CASE WHEN NOT rb THEN NULL WHEN ra AND rb AND l0 AND l1 THEN CASE WHEN a1 + b0 > a0 + b1 THEN 'REF_00' ELSE 'REF_01' END WHEN l0 AND l1 THEN CASE WHEN b1 > b0 THEN 'REF_01' ELSE 'REF_00' END WHEN l0 THEN 'REF_00' ELSE 'REF_01' END AS mb FROM mt),
js AS (SELECT p.recording, coalesce(sum(us) FILTER (WHERE l <> 'OVERLAP' AND r IN ('A', 'B') AND l = CASE r WHEN 'A' THEN ma ELSE mb END), 0) AS kept, coalesce(sum(us) FILTER (WHERE l <> 'OVERLAP' AND r IN ('A', 'B')), 0) AS joint, coalesce(sum(us) FILTER (WHERE r <> 'UNKNOWN'), 0) AS bth FROM pr p LEFT JOIN mp USING (recording) GROUP BY 1),
bt AS (SELECT recording, sum(end_us - start_us) AS n, coalesce(sum(end_us - start_us) FILTER (WHERE label <> 'OVERLAP'), 0) AS known FROM base GROUP BY 1),
vt AS (SELECT recording, sum(end_us - start_us) AS n, coalesce(sum(end_us - start_us) FILTER (WHERE label = 'UNKNOWN'), 0) AS none FROM var GROUP BY 1)
SELECT vt.recording, 'shifted' AS variant, round(CAST(coalesce(kept, 0) AS DOUBLE) / nullif(CAST(joint AS DOUBLE), 0), 9) AS co_assigned_agreement, round(CAST(known - coalesce(kept, 0) AS DOUBLE) / nullif(CAST(known AS DOUBLE), 0), 9) AS speaker_flip_rate,
 CASE WHEN bt.n IS NOT NULL THEN round(CAST(coalesce(kept, 0) AS DOUBLE) / nullif(CAST(known AS DOUBLE), 0), 9) END AS attribution_retention, CASE WHEN bt.n IS NOT NULL THEN round(CAST(none AS DOUBLE) / CAST(vt.n AS DOUBLE), 9) END AS unknown_delta,
 CASE WHEN bt.n IS NOT NULL THEN round(CAST(coalesce(bth, 0) AS DOUBLE) / nullif(CAST(bt.n + vt.n - none - coalesce(bth, 0) AS DOUBLE), 0), 9) END AS speech_iou FROM vt LEFT JOIN bt USING (recording) LEFT JOIN js USING (recording)"""


def _stability(spark: SparkSession, d: str) -> DataFrame:
    base = U.flat_timeline(ref_spans(spark, d), K, "REF_00", "REF_01")
    var = U.flat_timeline(hyp_spans(spark, d), K, "A", "B")
    var = var.withColumn("label", F.when(F.floor(F.col("start_us") / 1_000_000) % 9 == 0, "UNKNOWN").otherwise(F.col("label"))).withColumn("variant", F.lit("shifted"))
    return U.stability_metrics(base, var, K)


@query(_STABLE)
def stability_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Agreement, flips, retention, unknown share and speech of a shifted timeline; boundaries are in boundary_prf."""
    return _stability(spark, d).drop("boundary_f1")


_SPK = sql_union("ru", "SELECT recording, label, start_us, end_us FROM ref", "recording, label") + "," + sql_union("hu", "SELECT recording, label, start_us, end_us FROM hyp WHERE label <> 'UNKNOWN'", "recording, label")


@query(f"""WITH {VIEWS}, {_SPK}, rn AS (SELECT recording, count(*) FILTER (WHERE us >= 250000) AS r FROM (SELECT recording, label, sum(end_us - start_us) AS us FROM ru GROUP BY 1, 2) GROUP BY 1), hn AS (SELECT recording, count(*) FILTER (WHERE us >= 250000) AS h FROM (SELECT recording, label, sum(end_us - start_us) AS us FROM hu GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT recording, r, coalesce(h, 0) AS h, CASE length(recording) % 3 WHEN 0 THEN 'PASS_HIGH' WHEN 1 THEN 'PASS_WITH_UNATTRIBUTED' ELSE 'REVIEW_REQUIRED' END AS status FROM rn LEFT JOIN hn USING (recording))
SELECT count(*) AS n_recordings, count(*) FILTER (WHERE r = 2) AS n_two, count(*) FILTER (WHERE r = 1) AS n_one, round(coalesce(count(*) FILTER (WHERE r = 2 AND h = 1) / nullif(count(*) FILTER (WHERE r = 2), 0), 0), 9) AS complete_merge_rate,
 round(coalesce(count(*) FILTER (WHERE r = 2 AND h = 1 AND status IN ('PASS_HIGH', 'PASS_STANDARD')) / nullif(count(*) FILTER (WHERE r = 2), 0), 0), 9) AS unsafe_merge_rate, round(coalesce(count(*) FILTER (WHERE r = 1 AND h = 2) / nullif(count(*) FILTER (WHERE r = 1), 0), 0), 9) AS false_two_rate,
 round(coalesce(count(*) FILTER (WHERE r IN (1, 2) AND r = h) / nullif(count(*) FILTER (WHERE r IN (1, 2)), 0), 0), 9) AS count_accuracy, round(coalesce(count(*) FILTER (WHERE r = 2 AND h = 1 AND status IN ('PASS_HIGH', 'PASS_STANDARD', 'PASS_WITH_UNATTRIBUTED')) / nullif(count(*), 0), 0), 9) AS false_pass_rate FROM b""")
def topology_safety(spark: SparkSession, d: str) -> DataFrame:
    ref = ref_spans(spark, d)
    n = F.length("recording") % 3
    status = ref.select("recording").distinct().withColumn("status", F.when(n == 0, "PASS_HIGH").when(n == 1, "PASS_WITH_UNATTRIBUTED").otherwise("REVIEW_REQUIRED"))
    return U.topology_safety(ref, hyp_spans(spark, d), K, status, 250_000)


@query(f"""WITH {VIEWS}, {sql_union("su", "SELECT recording, start_us, end_us FROM scope")}, {sql_union("ru", "SELECT recording, label, start_us, end_us FROM ref", "recording, label")}, {sql_cells("oc", {"n": "SELECT recording, start_us, end_us FROM ru"})},
t AS (SELECT *, EXISTS (SELECT 1 FROM su WHERE su.recording = ref.recording AND su.start_us <= ref.start_us AND ref.end_us <= su.end_us) AS inside FROM ref),
c AS (SELECT recording, count(*) AS n_turns, count(DISTINCT label) AS n_speakers, bool_or(end_us - start_us <= 1000000) AS short_turn, bool_or(NOT inside) AS outs FROM t GROUP BY 1), o AS (SELECT recording, CAST(sum(end_us - start_us) AS BIGINT) AS overlap_us FROM oc WHERE n >= 2 GROUP BY 1),
e AS (SELECT DISTINCT recording FROM (SELECT recording FROM ref UNION ALL SELECT recording FROM scope))
SELECT e.recording, coalesce(n_turns, 0) AS n_turns, coalesce(n_speakers, 0) AS n_speakers, coalesce(short_turn, false) AS short_turn, coalesce(overlap_us, 0) AS overlap_us, concat_ws('+', CASE WHEN coalesce(n_speakers, 0) <> 2 THEN 'SPEAKER_COUNT_MISMATCH' END, CASE WHEN outs THEN 'OUTSIDE_SCOPE' END) AS issues FROM e LEFT JOIN c USING (recording) LEFT JOIN o USING (recording)""")
def annotation_checks(spark: SparkSession, d: str) -> DataFrame:
    ref, sc = ref_spans(spark, d), scope(spark, d)
    expected = ref.select("recording").union(sc.select("recording")).distinct().withColumn("speaker_count", F.lit(2).cast("bigint"))
    return U.annotation_checks(ref, sc, expected, K)


@query("WITH " + VIEWS + ", f AS (SELECT recording, start_us, end_us, CASE WHEN start_us // 32000 % 97 <> 0 THEN p END AS p FROM frames WHERE start_us // 32000 % 101 <> 0), g AS (SELECT *, lag(end_us) OVER (PARTITION BY recording ORDER BY start_us, end_us) AS e FROM f) SELECT recording, start_us, CASE WHEN p IS NULL THEN 'NOT_FINITE' ELSE 'NOT_CONTIGUOUS' END AS fault FROM g WHERE p IS NULL OR e <> start_us")
def frame_faults(spark: SparkSession, d: str) -> DataFrame:
    k = F.floor(F.col("start_us") / 32_000)
    return U.frame_faults(frames(spark, d).where(k % 101 != 0).withColumn("p", F.when(k % 97 != 0, F.col("p"))), K)


@query("WITH " + VIEWS + ", a AS (SELECT recording, start_us, p, 1 - p AS q FROM frames), b AS (SELECT recording, start_us, round(p * 0.97, 6) AS p, round((1 - p) * 1.01, 6) AS q FROM frames WHERE start_us // 32000 % 89 <> 0), j AS (SELECT b.recording IS NOT NULL AS m, unnest([{'k': 'p', 'x': abs(a.p - b.p)}, {'k': 'q', 'x': abs(a.q - b.q)}]) AS e FROM a LEFT JOIN b USING (recording, start_us)) SELECT e.k AS metric, count(*) FILTER (WHERE m) AS n, count(*) FILTER (WHERE NOT m) AS n_unmatched, round(avg(e.x), 9) AS mean_error, round(quantile_cont(e.x, 0.95), 9) AS p95_error, round(max(e.x), 9) AS max_error FROM j GROUP BY 1")
def frame_parity(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).select("recording", "start_us", "p", (1 - F.col("p")).alias("q"))
    near = f.where(F.floor(F.col("start_us") / 32_000) % 89 != 0).withColumn("p", F.round(F.col("p") * 0.97, 6)).withColumn("q", F.round(F.col("q") * 1.01, 6))
    return U.frame_parity(f, near, ["recording", "start_us"], ["p", "q"])


@query("SELECT row_id, coalesce(regexp_full_match(session_id, '[A-Za-z0-9][A-Za-z0-9_.\\-]{0,127}') AND regexp_matches(session_id, '[0-9]') AND lower(session_id) NOT IN ('unknown', 'overlap', 'anonymous', 'anonymized', 'name', 'realname', 'customer', 'client', 'transcript', 'speaker', 'person'), false) AS opaque FROM split_keys")
def opaque_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "split_keys").select("row_id", U.opaque_id(F.col("session_id")).alias("opaque"))


@query("WITH v AS (SELECT vec_id, CASE WHEN vec_id % 19 = 0 THEN [] WHEN vec_id % 23 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: CAST('NaN' AS DOUBLE)) WHEN vec_id % 5 = 0 THEN list_transform(embedding::DOUBLE[], lambda x: x * 1.5) ELSE list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) END AS v FROM embeddings), n AS (SELECT vec_id, v, len(list_filter(v, lambda x: isnan(x))) > 0 AS odd, sqrt(list_dot_product(v, v)) AS n FROM v) SELECT vec_id, CASE WHEN len(v) = 0 THEN 'EMPTY' WHEN odd THEN 'NOT_FINITE' ELSE 'NOT_UNIT' END AS fault FROM n WHERE len(v) = 0 OR odd OR abs(n - 1) > greatest(1e-4, 1e-4 * greatest(n, 1))")
def vector_faults(spark: SparkSession, d: str) -> DataFrame:
    e, i = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>")), F.col("vec_id")
    broken = F.when(i % 19 == 0, F.slice("v", 1, 0)).when(i % 23 == 0, F.transform("v", lambda x: F.lit(float("nan")))).when(i % 5 == 0, F.transform("v", lambda x: x * 1.5)).otherwise(V.unit(F.col("v")))
    return U.vector_faults(e.select("vec_id", broken.alias("v")), "vec_id", "v")


@query(f"WITH {TB._SAMPLES} SELECT recording, count(*) AS n, CAST(sum(x * x) AS BIGINT) AS squares, max(abs(x)) AS peak FROM s GROUP BY 1")
def pcm_stats(spark: SparkSession, d: str) -> DataFrame:
    return U.pcm_stats(TB._samples(spark, d), K)


@query(f"WITH {TB._SAMPLES}, n AS (SELECT recording, count(*) AS n FROM s GROUP BY 1), w AS (SELECT DISTINCT recording, n, z.size, unnest(list_concat(range(0, greatest(0, n - z.size) + 1, 10), [greatest(0, n - z.size)])) AS start FROM n, (VALUES (25), (40)) z(size)) SELECT w.recording, w.size, w.start, round(sum(s.x * s.x) / count(*), 9) AS energy FROM w JOIN s ON s.recording = w.recording AND s.k >= w.start AND s.k < w.start + w.size GROUP BY 1, 2, 3")
def window_energies(spark: SparkSession, d: str) -> DataFrame:
    return U.window_energies(TB._samples(spark, d), K, [25, 40], 10)


@query(f"WITH {TB._UNIT}, {TB._CENTRE}, c AS (SELECT list(s / n ORDER BY i) AS c FROM s JOIN n USING (label) WHERE label = 0), f AS (SELECT vec_id, u, 1 + vec_id % 5 AS wt, vec_id // 25 AS b, label % 2 AS g FROM u WHERE 1 - list_dot_product(u, (SELECT c FROM c)) > 0.45), x AS (SELECT g, generate_subscripts(u, 1) AS i, unnest(u) AS x, wt FROM f), y AS (SELECT g, i, sum(wt * x) AS y FROM x GROUP BY 1, 2), z AS (SELECT g, list(y / n ORDER BY i) AS z FROM y JOIN (SELECT g, sqrt(sum(y * y)) AS n FROM y GROUP BY 1) USING (g) GROUP BY 1), d AS (SELECT g, count(*) AS n_residual, count(DISTINCT b) AS n_blocks, sum(wt * (1 - list_dot_product(u, z))) / sum(wt) AS d FROM f JOIN z USING (g) GROUP BY 1) SELECT d.g, n_residual, n_blocks, n_blocks >= 2 AND d <= 0.2 AND 1 - list_dot_product(z, (SELECT c FROM c)) >= 0.15 AS risk FROM d JOIN z USING (g)")
def third_speaker_risk(spark: SparkSession, d: str) -> DataFrame:
    """What is far from one voice, in two halves of the labels."""
    e = table(spark, d, "embeddings").withColumn("w", 1 + F.col("vec_id") % 5).withColumn("b", F.floor(F.col("vec_id") / 25)).withColumn("g", F.col("label") % 2)
    one = V.weighted_centroids(e.where("label = 0"), ["label"], "embedding", "w").select(F.array("centroid").alias("centres"))
    centres = one.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("g"), "centres")
    return U.third_speaker_risk(e.withColumn("g", F.col("g").cast("int")), ["g"], centres, "embedding", "w", "b")


_DIAG = f"""d AS (SELECT row_id, row_id % 20 / 50.0 AS unknown_ratio, row_id % 7 / 50.0 AS overlap_ratio, row_id % 97 = 0 AS out_of_profile, row_id % 31 = 0 AS ambiguous, row_id % 11 = 0 AS crossing, row_id % 13 = 0 AS unattributed_overlap, row_id % 3 <> 0 AS all_high, row_id % 4 <> 0 AS evaluated_overlap,
  CASE WHEN row_id % 17 = 0 THEN ['Q_REVIEW'] ELSE [] END AS review, CASE WHEN row_id % 23 <> 0 THEN CASE WHEN row_id % 29 = 0 THEN 'p2' ELSE 'p1' END END AS profile_id, CASE WHEN row_id % 37 = 0 THEN 8000 ELSE 16000 END AS source_rate, CASE WHEN row_id % 41 = 0 THEN 'ff' ELSE 'AB' END AS model_hash, CASE WHEN row_id % 43 = 0 THEN 'cd' ELSE 'CE' END AS config_hash FROM manifest),
k AS (SELECT *, list_filter([CASE WHEN profile_id IS NULL THEN 'Q_CALIBRATION_UNBOUND' END, CASE WHEN profile_id <> 'p1' THEN 'Q_CALIBRATION_PROFILE_MISMATCH' END, CASE WHEN lower(model_hash) <> 'ab' THEN 'Q_CALIBRATION_MODEL_HASH_MISMATCH' END, CASE WHEN source_rate <> 16000 THEN 'Q_CALIBRATION_SOURCE_RATE_MISMATCH' END, CASE WHEN lower(config_hash) <> 'ce' THEN 'Q_CALIBRATION_CONFIG_HASH_MISMATCH' END], lambda x: x IS NOT NULL) AS cal,
  list_concat(review, CASE WHEN ambiguous THEN ['Q_H1_H2_AMBIGUOUS'] ELSE [] END) AS rev, list_filter([CASE WHEN crossing THEN 'Q_WORD_BOUNDARY_CROSSING_PRESENT' END, CASE WHEN unattributed_overlap THEN 'Q_OVERLAP_UNATTRIBUTED_PRESENT' END, CASE WHEN unknown_ratio > 0.2 THEN 'Q_HIGH_UNKNOWN_RATIO' END, CASE WHEN overlap_ratio > 0.1 THEN 'Q_HIGH_OVERLAP_RATIO' END], lambda x: x IS NOT NULL) AS deg FROM d)"""


@query(f"""WITH {_DIAG}, s AS (SELECT *, CASE WHEN out_of_profile THEN 'UNSUPPORTED' WHEN len(cal) > 0 OR len(rev) > 0 THEN 'REVIEW_REQUIRED' WHEN len(deg) > 0 THEN 'PASS_WITH_UNATTRIBUTED' WHEN all_high AND evaluated_overlap THEN 'PASS_HIGH' ELSE 'PASS_STANDARD' END AS status FROM k)
SELECT row_id, status, CASE status WHEN 'UNSUPPORTED' THEN 'SPEAKER_NEUTRAL' WHEN 'PASS_WITH_UNATTRIBUTED' THEN 'SPEAKER_NEUTRAL' WHEN 'REVIEW_REQUIRED' THEN 'MANUAL_REVIEW' ELSE 'SPEAKER_AWARE' END AS mode,
 array_to_string(CASE WHEN status = 'UNSUPPORTED' THEN ['Q_CONFIRMED_OUT_OF_PROFILE_SPEAKER_COUNT'] WHEN len(cal) > 0 THEN list_concat(cal, review) WHEN status = 'REVIEW_REQUIRED' THEN rev WHEN status = 'PASS_WITH_UNATTRIBUTED' THEN deg ELSE [] END, ',') AS reasons FROM s""")
def file_quality(spark: SparkSession, d: str) -> DataFrame:
    """Every rule of the ladder, on diagnostics made up from the row numbers of the manifest."""
    i = F.col("row_id")
    none = F.array().cast("array<string>")
    m = table(spark, d, "manifest").select(
        "row_id", (i % 20 / 50.0).alias("unknown_ratio"), (i % 7 / 50.0).alias("overlap_ratio"), (i % 97 == 0).alias("out_of_profile"), (i % 31 == 0).alias("ambiguous"), (i % 11 == 0).alias("crossing"), (i % 13 == 0).alias("unattributed_overlap"), (i % 3 != 0).alias("all_high"), (i % 4 != 0).alias("evaluated_overlap"),
        F.when(i % 17 == 0, F.array(F.lit("Q_REVIEW"))).otherwise(none).alias("review_reasons"), F.when(i % 23 != 0, F.when(i % 29 == 0, "p2").otherwise("p1")).alias("profile_id"), F.when(i % 37 == 0, 8000).otherwise(16000).alias("source_rate"),
        F.create_map(F.lit("m"), F.when(i % 41 == 0, "ff").otherwise("AB")).alias("model_hashes"), F.when(i % 43 == 0, "cd").otherwise("CE").alias("config_hash"),
    )
    told = U.calibration_mismatches(m, "p1", {"m": "ab"}, 16000, "ce")
    return U.file_quality(told).select("row_id", "status", "mode", F.array_join("reasons", ",").alias("reasons"))


@query()
def matched_events(spark: SparkSession, d: str) -> DataFrame:
    starts = lambda df: df.select("recording", F.col("start_us").alias("at")).distinct()
    return U.matched_events(starts(ref_spans(spark, d)), starts(hyp_spans(spark, d)), K, "at", 100_000)


@query()
def pooled_events(spark: SparkSession, d: str) -> DataFrame:
    from chronoloom.plans import timelines as TL

    rows = TL._scores(spark, d).select(F.split_part("recording", F.lit("/"), F.lit(2)).alias("channel"), F.col("o_tp").alias("tp"), F.col("o_fp").alias("fp"), F.col("o_fn").alias("fn"))
    return U.pooled_events(rows, ["channel"])


def _pooled_sql() -> str:
    from chronoloom.plans import timelines as TL

    prf = ", ".join(TL._PRF.format(a=a, b=b, c=c) for a, b, c in (("tp", "tp + fp", "precision"), ("tp", "tp + fn", "recall"), ("2 * tp", "2 * tp + fp + fn", "f1")))
    return TL._SCORES + f", g AS (SELECT split_part(recording, '/', 2) AS channel, CAST(sum(o_tp) AS BIGINT) AS tp, CAST(sum(o_fp) AS BIGINT) AS fp, CAST(sum(o_fn) AS BIGINT) AS fn FROM scores GROUP BY 1) SELECT *, {prf} FROM g"


SQL["pooled_events"] = _pooled_sql()


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
