"""Queries on changes, words, transcripts, evidence and gates, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import evidence as E
from chronoloom.operators import scoring as S
from chronoloom.operators import tallies as Y
from chronoloom.operators.intervals import cut_regions
from chronoloom.operators.sequences import hysteresis_regions
from chronoloom.plans import tables as TB
from chronoloom.plans import timelines as TL
from chronoloom.plans.training_data import sql_plain, table
from chronoloom.plans.views import VIEWS, frames, hyp_spans, ref_spans, scope, words

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


@query("""SELECT DISTINCT recording, start_us AS at_us, label FROM (SELECT *, EXISTS (SELECT 1 FROM scope s WHERE s.recording = ref.recording AND s.start_us <= ref.start_us AND ref.start_us < s.end_us) AS held, max(end_us) OVER (PARTITION BY recording ORDER BY start_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, max(end_us) OVER (PARTITION BY recording, label ORDER BY start_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM ref)
WHERE held AND a IS NOT NULL AND CASE WHEN a >= start_us THEN coalesce(o, -1) < start_us ELSE coalesce(o, -1) < a END""")
def change_points(spark: SparkSession, d: str) -> DataFrame:
    return E.change_points(ref_spans(spark, d), K, scope=scope(spark, d))


@query("SELECT h.row_id, h.recording, h.mid_us, r.row_id AS next_row, r.label AS next_label FROM (SELECT row_id, recording, (start_us + end_us) // 2 AS mid_us FROM hyp) h LEFT JOIN LATERAL (SELECT row_id, label FROM ref WHERE ref.recording = h.recording AND ref.end_us > h.mid_us ORDER BY end_us, row_id LIMIT 1) r ON true")
def next_turn_as_of(spark: SparkSession, d: str) -> DataFrame:
    mids = hyp_spans(spark, d).select("row_id", "recording", F.floor((F.col("start_us") + F.col("end_us")) / 2).alias("mid_us"))
    return E.as_of_next(mids, ref_spans(spark, d), K, "mid_us")


@query("""SELECT recording, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n, CAST(sum(end_us - start_us) AS BIGINT) AS total_us FROM (SELECT *, sum(f) OVER (PARTITION BY recording ORDER BY start_us, row_id) AS g FROM (SELECT *, CASE WHEN lag(label) OVER (PARTITION BY recording ORDER BY start_us, row_id) = label THEN 0 ELSE 1 END AS f FROM hyp)) WHERE label = 'UNKNOWN' GROUP BY recording, g""")
def unknown_runs(spark: SparkSession, d: str) -> DataFrame:
    return E.runs_of(hyp_spans(spark, d), K, "label", "UNKNOWN")


_LINE = r"^\[(\d{2}):(\d{2}):(\d{2})\] ([^:]+): (.*)$"


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS line_no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
t AS (SELECT doc_id, CAST(line_no AS INT) AS line_no, (CAST(regexp_extract(line, '{_LINE}', 1) AS INT) * 60 + CAST(regexp_extract(line, '{_LINE}', 2) AS INT)) * 60 + CAST(regexp_extract(line, '{_LINE}', 3) AS INT) AS start_s, regexp_extract(line, '{_LINE}', 4) AS label, CAST(length(regexp_extract(line, '{_LINE}', 5)) AS INT) AS n_chars FROM l WHERE regexp_matches(line, '{_LINE}')),
n AS (SELECT *, lead(start_s) OVER (PARTITION BY doc_id ORDER BY line_no) AS end_s, min(line_no) OVER (PARTITION BY doc_id, label) AS f FROM t)
SELECT doc_id, line_no, start_s, label, n_chars, end_s, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY f) AS INT) AS speaker_no FROM n""")
def transcript_turns(spark: SparkSession, d: str) -> DataFrame:
    return E.transcript_turns(table(spark, d, "documents"))


@query("SELECT row_id, start_us, end_us FROM ref")
def flexible_times(spark: SparkSession, d: str) -> DataFrame:
    """Turns written as JSON with times in three notations, and read back."""
    sec = lambda c: (F.col(c).cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(20,6)").cast("string")
    kind = F.col("row_id") % 3
    field = lambda n: F.when(kind == 0, F.concat(F.lit(f'"{n}_us": '), F.col(f"{n}_us").cast("string"))).when(kind == 1, F.concat(F.lit(f'"{n}_sec": '), sec(f"{n}_us"))).otherwise(F.concat(F.lit(f'"{n}": '), sec(f"{n}_us")))
    text = F.concat(F.lit("{"), field("start"), F.lit(", "), field("end"), F.lit("}"))
    return ref_spans(spark, d).select("row_id", text.alias("t")).select("row_id", E.flexible_us(F.col("t"), "start").alias("start_us"), E.flexible_us(F.col("t"), "end").alias("end_us"))


@query(f"WITH {TB._SAMPLES}, p AS (SELECT *, k // 20 AS win, CASE WHEN k % 20 <> 0 THEN lag(x) OVER (PARTITION BY recording ORDER BY k) END AS q FROM s) SELECT recording, CAST(win AS BIGINT) AS \"window\", count(*) AS n, round(sqrt(avg(x * x)), 9) AS rms, round(count(*) FILTER (WHERE x * q < 0) / count(*), 9) AS zcr, round(coalesce(avg(abs(x - q)), 0), 9) AS step FROM p GROUP BY 1, 2")
def window_features(spark: SparkSession, d: str) -> DataFrame:
    return E.window_features(TB._samples(spark, d), ["recording"], 20)


@query(f"WITH {TB._SAMPLES}, f AS (SELECT recording, CAST(k // 20 AS BIGINT) AS w, avg(x * x) AS e FROM s GROUP BY 1, 2), m AS (SELECT recording, avg(e) AS m FROM f GROUP BY 1), a AS (SELECT *, e >= m AS act FROM f JOIN m USING (recording)), i AS (SELECT *, w - row_number() OVER (PARTITION BY recording ORDER BY w) AS g FROM a WHERE act) SELECT recording, min(w) AS first_window, max(w) AS last_window, count(*) AS n_windows FROM i GROUP BY recording, g")
def energy_regions(spark: SparkSession, d: str) -> DataFrame:
    return Y.loud_runs(TB._samples(spark, d), K, 20)


@query(f"WITH {VIEWS}, w AS (SELECT recording, start_us, p, start_us // 32000 AS k, unnest(range(CAST(greatest(0, ceil((start_us // 32000 - 29) / 10)) AS BIGINT), start_us // 320000 + 1)) AS n FROM frames), h AS (SELECT *, 0.54 - 0.46 * cos(6.283185307179586 * (k - n * 10) / 29) AS wt FROM w) SELECT recording, start_us, round(sum(wt * (p + n % 2)) / sum(wt), 6) AS mean, count(*) AS n_windows FROM h GROUP BY 1, 2")
def overlap_added(spark: SparkSession, d: str) -> DataFrame:
    return E.overlap_added(frames(spark, d), ["recording"], "p", 30, 10)


@query(f"WITH {VIEWS}, {TB._hyst('frames', 'recording', '0.5', '0.35')}, j AS (SELECT f.recording, f.start_us, f.end_us, CAST(sum(least(f.end_us, r.end_us) - greatest(f.start_us, r.start_us)) AS BIGINT) AS core_us FROM frames f JOIN reg r ON r.recording = f.recording AND r.start_us < f.end_us AND f.start_us < r.end_us GROUP BY ALL) SELECT recording, count(*) AS n_core, CAST(sum(core_us) AS BIGINT) AS core_us FROM j GROUP BY 1")
def core_frames(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    return Y.core_share(f, hysteresis_regions(f, K), K)


@query(f"""WITH RECURSIVE {VIEWS}, g AS (SELECT recording, min({{'e': end_us, 'r': row_id}}) AS x FROM ref GROUP BY 1 UNION ALL SELECT ref.recording, min({{'e': ref.end_us, 'r': ref.row_id}}) AS x FROM g JOIN ref ON ref.recording = g.recording AND ref.start_us >= g.x.e GROUP BY 1) SELECT x.r AS row_id FROM g""")
def scheduled_turns(spark: SparkSession, d: str) -> DataFrame:
    return E.scheduled(ref_spans(spark, d), K)


@query("SELECT w.recording, w.word_id, 'OUTSIDE_SCOPE' AS issue FROM words w WHERE NOT EXISTS (SELECT 1 FROM scope s WHERE s.recording = w.recording AND s.start_us < w.end_us AND w.start_us < s.end_us)")
def word_issues(spark: SparkSession, d: str) -> DataFrame:
    return E.word_issues(words(spark, d), scope(spark, d), K)


@query(TL._SCORES + """ SELECT recording, CAST((r0_us > 0) AS INT) + CAST((r1_us > 0) AS INT) AS n_ref, CAST((h0_us > 0) AS INT) + CAST((h1_us > 0) AS INT) AS n_hyp,
 (r0_us > 0 AND r1_us > 0 AND (h0_us > 0) <> (h1_us > 0)) AS complete_merge, ((r0_us > 0) <> (r1_us > 0) AND h0_us > 0 AND h1_us > 0) AS false_split FROM n""")
def topology_flags(spark: SparkSession, d: str) -> DataFrame:
    on = {c: F.col(f"{c}_us") > 0 for c in ("r0", "r1", "h0", "h1")}
    s = S.cell_sums(TL._cells(spark, d), K)
    return s.select("recording", (on["r0"].cast("int") + on["r1"].cast("int")).alias("n_ref"), (on["h0"].cast("int") + on["h1"].cast("int")).alias("n_hyp"), (on["r0"] & on["r1"] & (on["h0"] != on["h1"])).alias("complete_merge"), ((on["r0"] != on["r1"]) & on["h0"] & on["h1"]).alias("false_split"))


@query(TL._COMMON + """, v AS (SELECT row_id, hyp_label FROM common QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY common_us DESC, hyp_label) = 1), s AS (SELECT r.label, v.hyp_label FROM ref r LEFT JOIN v USING (row_id) WHERE r.end_us - r.start_us < 1000000)
SELECT label, count(*) AS n_short, count(*) FILTER (WHERE hyp_label IN ('A', 'B')) AS n_assigned, round(coalesce(count(*) FILTER (WHERE (label = 'REF_00' AND hyp_label = 'A') OR (label = 'REF_01' AND hyp_label = 'B')) / nullif(count(*) FILTER (WHERE hyp_label IN ('A', 'B')), 0), 0), 9) AS precision, round(coalesce(count(*) FILTER (WHERE coalesce(hyp_label, 'UNKNOWN') = 'UNKNOWN') / nullif(count(*), 0), 0), 9) AS unknown_rate FROM s GROUP BY 1""")
def short_turn_metrics(spark: SparkSession, d: str) -> DataFrame:
    short = ref_spans(spark, d).where("end_us - start_us < 1000000")
    s = short.join(S.turn_votes(TL._common(spark, d), K, "row_id").select("row_id", "hyp_label"), "row_id", "left")
    given = F.count(F.when(F.col("hyp_label").isin("A", "B"), 1))
    right = F.count(F.when((F.col("label") == "REF_00") & (F.col("hyp_label") == "A") | (F.col("label") == "REF_01") & (F.col("hyp_label") == "B"), 1))
    none = F.count(F.when(F.coalesce("hyp_label", F.lit("UNKNOWN")) == "UNKNOWN", 1))
    return s.groupBy("label").agg(F.count("*").alias("n_short"), given.alias("n_assigned"), S.ratio(right, given).alias("precision"), S.ratio(none, F.count("*")).alias("unknown_rate"))


@query("""SELECT r.row_id, r.recording, r.s AS start_us, r.kind, e.label IS NOT NULL AS embedded, CASE WHEN e.label IS NULL THEN 'DEFERRED' ELSE kind END AS evidence, round(greatest(0.000001, (e.label + 1) / 10) * least(r.n, 5000000), 6) AS weight FROM
(SELECT row_id, recording, s, least(s + 2000000, end_us) - s AS n, CASE WHEN least(s + 2000000, end_us) - s >= 1500000 THEN 'ANCHOR' WHEN least(s + 2000000, end_us) - s >= 700000 THEN 'SUPPORT' ELSE 'MICRO' END AS kind FROM (SELECT *, unnest(range(start_us, end_us, 2000000)) AS s FROM ref)) r LEFT JOIN embeddings e ON e.vec_id = r.row_id""")
def anchor_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of turns with the quality of their vectors."""
    q = table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), ((F.col("label") + 1) / 10).alias("q"))
    return Y.anchor_evidence(cut_regions(ref_spans(spark, d).drop("label"), 2_000_000).drop("kind"), q).drop("end_us")


@query("SELECT recording, label, first_us, CAST(row_number() OVER (PARTITION BY recording ORDER BY first_us, label) AS INT) AS speaker_no FROM (SELECT recording, label, min(start_us) AS first_us FROM hyp WHERE label <> 'UNKNOWN' GROUP BY 1, 2)")
def speaker_order(spark: SparkSession, d: str) -> DataFrame:
    return Y.speaker_order(hyp_spans(spark, d), K)


@query(TB.SQL["nearest_centroid"].replace("SELECT id, label, distance, round(m, 6) AS margin FROM r WHERE k = 1", "SELECT id, CASE WHEN distance > 0.6 THEN 'OUTLIER' WHEN round(m, 6) < 0.05 THEN 'UNKNOWN' ELSE CAST(label AS VARCHAR) END AS assignment FROM r WHERE k = 1"))
def local_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The nearest centroid within a ceiling and with a margin, else why not."""
    n = TB.nearest_centroid(spark, d)
    return n.select("id", F.when(F.col("distance") > 0.6, "OUTLIER").when(F.col("margin") < 0.05, "UNKNOWN").otherwise(F.col("label").cast("string")).alias("assignment"))


@query("WITH q AS (SELECT label, embedding::DOUBLE[] AS a, list_transform(embedding::DOUBLE[], lambda x: round_even(x * 127, 0) / 127) AS b FROM embeddings), c AS (SELECT label, list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) AS cos FROM q) SELECT label, count(*) AS n, round(quantile_cont(cos, 0.5), 6) AS median_cosine, round(min(cos), 6) AS worst_cosine, min(cos) >= 0.99 AS passed FROM c GROUP BY 1")
def quantization_parity(spark: SparkSession, d: str) -> DataFrame:
    """Vectors against their eight-bit lattice: cosine per label."""
    return Y.lattice_parity(table(spark, d, "embeddings"), ["label"], "embedding")


@query("WITH r AS (SELECT row_id, CASE WHEN json_valid(report) THEN CASE WHEN json_type(report, '$.cpu_limit') = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(report, '$.cpu_limit')) THEN json_extract_string(report, '$.cpu_limit')::JSON END ELSE json_extract(report, '$.cpu_limit') END END AS c, CASE WHEN json_valid(report) THEN TRY_CAST(json_extract_string(report, '$.rtf') AS DOUBLE) END AS rtf FROM run_reports), v AS (SELECT row_id, rtf, TRY_CAST(json_extract_string(c, '$.throttled_wall_ratio') AS DOUBLE) AS t FROM r) SELECT row_id, CASE WHEN rtf IS NULL THEN 'NOT_EVALUATED' WHEN rtf <= 0.25 THEN 'PASS' ELSE 'FAIL' END AS speed, CASE WHEN t IS NULL THEN 'NOT_EVALUATED' WHEN t <= 0.01 THEN 'PASS' ELSE 'FAIL' END AS throttle FROM v")
def run_gates(spark: SparkSession, d: str) -> DataFrame:
    from chronoloom.operators.nested import _below

    r = table(spark, d, "run_reports").select("row_id", F.try_parse_json("report").alias("v"))
    throttled = F.try_variant_get(_below(F.col("v"), "cpu_limit\u0001throttled_wall_ratio", True), "$", "double")
    return Y.gates(r, "row_id", {"speed": (F.try_variant_get("v", "$.rtf", "double"), 0.25, False), "throttle": (throttled, 0.01, False)})


@query(f"WITH l AS (SELECT coalesce({sql_plain('split')}, '') AS split, sha256(concat_ws('|', audio_id, audio_sha256, rttm_sha256, uem_sha256)) AS h FROM manifest), p AS (SELECT split, substr(h, 1, 3) AS p, sha256(string_agg(h, '' ORDER BY h)) AS dg, count(*) AS n FROM l GROUP BY 1, 2) SELECT split, sha256(string_agg(dg, '' ORDER BY p, dg)) AS digest, CAST(sum(n) AS BIGINT) AS n_rows FROM p GROUP BY 1")
def manifest_digests(spark: SparkSession, d: str) -> DataFrame:
    from chronoloom.functions.ids import plain_form

    m = table(spark, d, "manifest").withColumn("split", F.coalesce(plain_form(F.col("split")), F.lit("")))
    return E.tree_digest(m, ["split"], F.concat_ws("|", "audio_id", "audio_sha256", "rttm_sha256", "uem_sha256"))


@query("SELECT row_id, '{\"audio_id\":' || coalesce(CAST(to_json(audio_id) AS VARCHAR), 'null') || ',\"channel_count\":' || coalesce(CAST(channel_count AS VARCHAR), 'null') || ',\"duration_us\":' || coalesce(CAST(duration_us AS VARCHAR), 'null') || '}' AS canonical FROM recordings")
def canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as compact JSON with sorted keys and explicit nulls."""
    names = sorted(["audio_id", "duration_us", "channel_count"])
    return table(spark, d, "recordings").select("row_id", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("canonical"))


@query(f"WITH p AS (SELECT {sql_plain('audio_id')} AS audio, row_id, quality_status, submitted_at FROM predictions) SELECT audio, arg_max(coalesce(quality_status, ''), (submitted_at, row_id)) AS status, count(*) AS n_versions FROM p WHERE audio IS NOT NULL GROUP BY 1")
def latest_status(spark: SparkSession, d: str) -> DataFrame:
    from chronoloom.functions.ids import plain_form

    p = table(spark, d, "predictions").withColumn("audio", plain_form(F.col("audio_id")))
    return Y.latest_values(p, "audio", "quality_status", "submitted_at")


@query("WITH x AS (SELECT row_id, CASE WHEN report IS NULL THEN 'MISSING' WHEN NOT json_valid(report) THEN 'UNREADABLE' END AS issue FROM run_reports) SELECT * FROM x WHERE issue IS NOT NULL")
def strict_json_issues(spark: SparkSession, d: str) -> DataFrame:
    from chronoloom.sources.strict import json_issues

    return json_issues(table(spark, d, "run_reports"), "row_id", "report")


@query()
def cluster_decisions(spark: SparkSession, d: str) -> DataFrame:
    """One cluster or two among the vectors of each label."""
    from chronoloom.operators.hypotheses import cluster_decisions as decide

    e = table(spark, d, "embeddings").withColumn("w", 1 + F.col("vec_id") % 5).withColumn("b", F.floor(F.col("vec_id") / 25))
    out = decide(e, ["label"], "embedding", "w", "b", "vec_id")
    return out.select("label", "n", F.round("cost_one", 6).alias("cost_one"), F.round("cost_two", 6).alias("cost_two"), F.round("stability", 6).alias("stability"), "decision")


@query(TB._SPREAD + " SELECT vec_id AS id, coalesce(CAST(s.label AS VARCHAR), 'UNKNOWN') AS label FROM embeddings e LEFT JOIN spread s ON s.id = e.vec_id AND s.score >= 0.8 AND s.margin >= 0.3")
def rescued_labels(spark: SparkSession, d: str) -> DataFrame:
    from chronoloom.operators.hypotheses import rescued

    return rescued(TB.label_propagation(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("id")))


@query(TL._with(TL.sql_union("m", "SELECT recording, start_us, end_us FROM scope")) + ", p AS (SELECT row_id, recording, (start_us + end_us) // 2 AS mid_us FROM hyp) SELECT p.row_id, p.recording, p.mid_us, CAST(m.start_us * 2 + (2 * (p.mid_us - m.start_us)::HUGEINT * (2 * (m.end_us - m.start_us) + 1000) + (m.end_us - m.start_us)) // (2 * (m.end_us - m.start_us)) AS BIGINT) AS source_us FROM p JOIN m ON m.recording = p.recording AND m.start_us <= p.mid_us AND p.mid_us <= m.end_us")
def warped_points(spark: SparkSession, d: str) -> DataFrame:
    """Middles of turns through a stretched time of each scored period."""
    from chronoloom.operators.periods import continuous_periods
    from chronoloom.operators.signals import mapped_points

    m = continuous_periods(scope(spark, d), K)
    seg = m.select("recording", F.col("start_us").alias("view_start"), F.col("end_us").alias("view_end"), (F.col("start_us") * 2).alias("source_start"), (F.col("end_us") * 2 + 1000).alias("source_end"))
    mids = hyp_spans(spark, d).select("row_id", "recording", F.floor((F.col("start_us") + F.col("end_us")) / 2).alias("mid_us"))
    return mapped_points(mids, seg, K, "mid_us")


_SPOKEN = "list_filter(regexp_split_to_array(trim(coalesce({0}, ''), ' ' || chr(9) || chr(10) || chr(13)), '\\s+'), lambda x: x <> '')"
_TOLD = "array_to_string(list_transform({0}, lambda x: chr(CAST(list_position(al, x) AS INT))), '')"
_CPWER = f"""WITH e AS (SELECT item_id, {_SPOKEN.format("text")} AS r0, {_SPOKEN.format("lead(text) OVER w")} AS r1, {_SPOKEN.format("lag(text) OVER w")} AS h1 FROM eval_items WINDOW w AS (PARTITION BY suite ORDER BY item_id)),
a AS (SELECT *, list_distinct(list_concat(r0, r1, h1)) AS al FROM e), c AS (SELECT item_id, len(r0) + len(r1) AS ref_words, {_TOLD.format("r0")} AS a, {_TOLD.format("r1")} AS b, {_TOLD.format("h1")} AS h FROM a),
d AS (SELECT item_id, least(levenshtein(a, b) + levenshtein(b, h), levenshtein(a, h) + 0) AS errors, ref_words FROM c)
SELECT item_id, errors, ref_words, CASE WHEN ref_words > 0 THEN round(errors / CAST(ref_words AS DOUBLE), 9) WHEN errors > 0 THEN 1.0 ELSE 0.0 END AS rate FROM d"""


@query(_CPWER)
def assigned_word_errors(spark: SparkSession, d: str) -> DataFrame:
    """Each item and the next of its suite as two speakers, against the same texts exchanged."""
    from pyspark.sql import Window

    from chronoloom.operators.texts import assigned_word_errors as errors

    w = Window.partitionBy("suite").orderBy("item_id")
    e = table(spark, d, "eval_items").select("item_id", F.array("text", F.lead("text").over(w)).alias("refs"), F.array(F.lead("text").over(w), F.lag("text").over(w)).alias("hyps"))
    return errors(e, "refs", "hyps").select("item_id", "errors", "ref_words", "rate")


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
