"""Queries on frames, vectors, texts, orders, events and evidence tables, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.ids import plain_form
from chronoloom.functions.scalars import base32_id, sample_to_us, softmax
from chronoloom.operators import selection as P
from chronoloom.operators import signals as G
from chronoloom.operators import sequences as Q
from chronoloom.operators import tallies as Y
from chronoloom.operators import texts as X
from chronoloom.operators import vectors as V
from chronoloom.operators.audits import pcm_stats
from chronoloom.operators.blocked import counted_rank
from chronoloom.plans.training_data import sql_plain, table
from chronoloom.plans.views import VIEWS, frames, hyp_spans, ref_spans
from chronoloom.streaming.sessions import drained, sessions, streaming_hysteresis, windowed_counts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def _hyst(source: str, keys: str, on: str, off: str) -> str:
    return f"""f1 AS (SELECT *, p < {off} AS quiet, max(CASE WHEN p >= {off} THEN end_us END) OVER w AS loud, min(start_us) OVER (PARTITION BY {keys}) AS beg FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY start_us ROWS UNBOUNDED PRECEDING)),
f2 AS (SELECT *, max(CASE WHEN p >= {on} THEN start_us END) OVER w AS op, max(CASE WHEN quiet AND start_us - coalesce(loud, beg) >= 100000 THEN start_us END) OVER w AS cl FROM f1 WINDOW w AS (PARTITION BY {keys} ORDER BY start_us ROWS UNBOUNDED PRECEDING)),
f3 AS (SELECT *, op IS NOT NULL AND (cl IS NULL OR op > cl) AS act FROM f2),
f4 AS (SELECT *, act AND NOT coalesce(lag(act) OVER (PARTITION BY {keys} ORDER BY start_us), false) AS st FROM f3),
f5 AS (SELECT *, sum(st::INT) OVER (PARTITION BY {keys} ORDER BY start_us ROWS UNBOUNDED PRECEDING) AS g FROM f4),
reg AS (SELECT {keys}, min(start_us) AS start_us, max(CASE WHEN NOT quiet THEN end_us END) AS end_us, count(*) AS n_frames FROM f5 WHERE act GROUP BY {keys}, g)"""


@query(f"WITH {VIEWS}, {_hyst('frames', 'recording', '0.5', '0.35')} SELECT * FROM reg")
def hysteresis_regions(spark: SparkSession, d: str) -> DataFrame:
    return Q.hysteresis_regions(frames(spark, d), ["recording"])


@query(f"WITH {VIEWS}, ft AS (SELECT *, unnest([0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS threshold FROM frames), {_hyst('ft', 'recording, threshold', 'threshold', '(threshold - 0.15)')} SELECT threshold, count(*) AS n_regions, CAST(sum(end_us - start_us) AS BIGINT) AS core_us FROM reg GROUP BY 1")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    many = frames(spark, d).withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in (0.3, 0.5, 0.7, 0.9)])))
    found = Q.hysteresis_regions(many, ["recording", "threshold"], on=F.col("threshold"), off=F.col("threshold") - F.lit(0.15))
    return found.groupBy("threshold").agg(F.count("*").alias("n_regions"), F.sum(F.col("end_us") - F.col("start_us")).alias("core_us"))


@query(f"WITH {VIEWS}, ft AS (SELECT *, unnest([0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS threshold FROM frames), {_hyst('ft', 'recording, threshold', 'threshold', '(threshold - 0.15)')}, a AS (SELECT threshold, count(*) AS n_regions, CAST(sum(end_us - start_us) AS BIGINT) AS core_us, row_number() OVER (ORDER BY threshold) - 1 AS arm FROM reg GROUP BY 1), e AS (SELECT *, core_us >= 1000000 AS accepted FROM a) SELECT threshold, n_regions, core_us, CAST(arm AS INT) AS arm, accepted FROM e WHERE accepted OR arm = 0 ORDER BY accepted DESC, n_regions, arm LIMIT 1")
def grid_pick(spark: SparkSession, d: str) -> DataFrame:
    """The arm with fewest regions among those with a second of core or more; else arm 0."""
    arms = threshold_sweep(spark, d).withColumn("arm", F.array_position(F.array(*[F.lit(t) for t in (0.3, 0.5, 0.7, 0.9)]), F.col("threshold")).cast("int") - 1)
    return P.first_best(arms, "core_us >= 1000000", [F.col("n_regions")], "arm")


@query(f"WITH {VIEWS} SELECT *, round(abs(avg(p) OVER (w ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) - avg(p) OVER (w ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)), 9) AS change FROM frames WINDOW w AS (PARTITION BY recording ORDER BY start_us)")
def context_change(spark: SparkSession, d: str) -> DataFrame:
    return Q.context_change(frames(spark, d), ["recording"], "p")


@query(f"""WITH RECURSIVE {VIEWS}, c AS (SELECT recording, start_us, round(abs(avg(p) OVER (w ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING) - avg(p) OVER (w ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING)), 9) AS s FROM frames WINDOW w AS (PARTITION BY recording ORDER BY start_us)),
n AS (SELECT *, lag(s) OVER w AS a, lead(s) OVER w AS b FROM c WINDOW w AS (PARTITION BY recording ORDER BY start_us)),
pk AS (SELECT recording, list(start_us ORDER BY s DESC, start_us) AS t FROM n WHERE s >= 0.2 AND coalesce(s >= a, true) AND coalesce(s > b, true) GROUP BY 1),
f AS (SELECT recording, t, 1 AS k, []::BIGINT[] AS kept FROM pk UNION ALL SELECT recording, t, k + 1, CASE WHEN len(list_filter(kept, lambda x: abs(x - t[k]) < 250000)) > 0 THEN kept ELSE list_append(kept, t[k]) END FROM f WHERE k <= len(t))
SELECT recording, unnest(kept) AS at_us FROM f WHERE k > len(t)""")
def separated_peaks(spark: SparkSession, d: str) -> DataFrame:
    change = Q.context_change(frames(spark, d), ["recording"], "p")
    return Q.separated_peaks(change, ["recording"], "change", 0.2, 250_000)


@query("SELECT event_id, user_id, CASE WHEN c - lag(c) OVER w >= 0 THEN c - lag(c) OVER w END AS delta FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS c FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def counter_deltas(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("c", F.round(F.col("value") * 100).cast("bigint"))
    return Q.counter_deltas(e, ["user_id"], "c", "ts").select("event_id", "user_id", "delta")


_DIST = "round(1 - list_dot_product(a.u, b.u), 6)"
_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)"


@query(f"WITH {_UNIT}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_DIST} AS distance FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) SELECT query_id, CAST(rank AS INT) AS rank, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM p) WHERE rank <= 8")
def cosine_knn(spark: SparkSession, d: str) -> DataFrame:
    """The stated queries, ids divisible by 100, against all rows."""
    e = table(spark, d, "embeddings")
    return V.nearest_neighbours(e.where("vec_id % 100 = 0"), e, 8)


@query("SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def knn_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether the index over all rows finds nine in ten of the neighbours that brute force finds, or more."""
    e = table(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0")
    told = V.neighbour_recall(V.nearest_neighbours(asked, e, 8), V.indexed_neighbours(asked, e, 8))
    return told.select("n_queries", (F.col("recall") >= 0.9).alias("enough"))


@query()
def indexed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Mutual neighbours of all rows by the index."""
    e = table(spark, d, "embeddings")
    return V.mutual_neighbours(V.indexed_neighbours(e, e, 4)).select("a", "b", "distance")


_MUTUAL = f"WITH {_UNIT}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_DIST} AS distance FROM u a JOIN u b ON a.vec_id <> b.vec_id), k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a ORDER BY distance, b) <= 4), mu AS (SELECT k.a, k.b, k.distance FROM k JOIN k r ON k.a = r.b AND k.b = r.a WHERE k.a < k.b)"


@query(_MUTUAL + " SELECT a, b, distance FROM mu")
def mutual_knn_edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.mutual_neighbours(V.nearest_neighbours(e, e, 4)).select("a", "b", "distance")


_STEP = """, s{k} AS (SELECT b AS id, label, sum(score * w) AS score FROM l{p} JOIN g ON g.a = l{p}.id WHERE b NOT IN (SELECT id FROM l0) GROUP BY 1, 2), l{k} AS (SELECT id, label, score / sum(score) OVER (PARTITION BY id) AS score FROM s{k} UNION ALL SELECT * FROM l0)"""
_SPREAD = _MUTUAL + ", g AS (SELECT a, b, exp(-distance) AS w FROM mu UNION ALL SELECT b, a, exp(-distance) FROM mu), l0 AS (SELECT min(vec_id) AS id, label, 1.0::DOUBLE AS score FROM embeddings GROUP BY label)" + "".join(_STEP.format(k=k, p=k - 1) for k in (1, 2, 3)) + """,
lr AS (SELECT id, label, round(score, 9) AS score, row_number() OVER w AS r, coalesce(lead(round(score, 9)) OVER w, 0) AS nx FROM l3 WINDOW w AS (PARTITION BY id ORDER BY round(score, 9) DESC, label)), spread AS (SELECT id, label, score, round(score - nx, 9) AS margin FROM lr WHERE r = 1)"""


@query(_SPREAD + " SELECT * FROM spread")
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    """From the first vector of each label over the mutual neighbour graph."""
    e = table(spark, d, "embeddings")
    edges = mutual_knn_edges(spark, d).select("a", "b", F.exp(-F.col("distance")).alias("weight"))
    return V.propagated_labels(edges, e.groupBy("label").agg(F.min("vec_id").alias("id")).select("id", "label"))


_CENTRE = "w AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x, 1 + vec_id % 5 AS wt FROM embeddings), s AS (SELECT label, i, sum(wt * x) AS s FROM w GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(s * s)) AS n FROM s GROUP BY 1)"


@query(f"WITH {_CENTRE} SELECT label, CAST(i - 1 AS INT) AS dim, round(s / n, 6) AS x FROM s JOIN n USING (label)")
def weighted_centroids(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("w", 1 + F.col("vec_id") % 5)
    return V.weighted_centroids(e, ["label"], "embedding", "w").select("label", F.posexplode("centroid").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH {_UNIT}, {_CENTRE}, c AS (SELECT label, list(s / n ORDER BY i) AS c FROM s JOIN n USING (label) GROUP BY 1), p AS (SELECT vec_id AS id, c.label, round(1 - list_dot_product(u, c), 6) AS distance FROM u, c), r AS (SELECT *, row_number() OVER w AS k, lead(distance) OVER w - distance AS m FROM p WINDOW w AS (PARTITION BY id ORDER BY distance, label)) SELECT id, label, distance, round(m, 6) AS margin FROM r WHERE k = 1")
def nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("w", 1 + F.col("vec_id") % 5)
    return V.nearest_centroid(e, V.weighted_centroids(e, ["label"], "embedding", "w"), "embedding", "vec_id")


@query("WITH c AS (SELECT c_custkey AS id, o.label, c_acctbal * 40 AS score FROM customer, (SELECT DISTINCT o_orderpriority AS label FROM orders) o), n AS (SELECT o_orderpriority AS label, count(*) AS n, list(o_totalprice) AS s FROM orders GROUP BY 1), p AS (SELECT id, c.label, round((1 + len(list_filter(s, lambda x: x >= score))) / (n + 1), 9) AS p FROM c JOIN n USING (label)) SELECT id, CASE count(*) FILTER (WHERE p > 0.9) WHEN 0 THEN 'OUT_OF_DISTRIBUTION' WHEN 1 THEN any_value(label) FILTER (WHERE p > 0.9) ELSE 'AMBIGUOUS' END AS outcome, max(p) AS p FROM p GROUP BY 1")
def conformal_labels(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_totalprice").alias("score"))
    labels = orders.select("label").distinct()
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") * 40).alias("score"))
    # every candidate is scored for every class: the classes come as one row, and are unfolded where the candidate lives
    classes = labels.agg(F.array_sort(F.collect_set("label")).alias("_c"))
    return V.conformal_labels(orders, who.join(F.broadcast(classes)).select("id", "score", F.explode("_c").alias("label")), 0.9, 10_000.0)


@query("WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS a, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS b FROM lineitem) SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1")
def spearman_parity(spark: SparkSession, d: str) -> DataFrame:
    return V.spearman(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", 5.0, 5_000.0)


@query("SELECT s_suppkey, s_nationkey, s_acctbal, rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_nationkey, s_acctbal) - 1) / 2 AS rank FROM supplier")
def average_ranks(spark: SparkSession, d: str) -> DataFrame:
    return V.average_ranks(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_nationkey"], "s_acctbal", 1_000.0).select("s_suppkey", "s_nationkey", "s_acctbal", "rank")


@query()
def two_clusters(spark: SparkSession, d: str) -> DataFrame:
    return V.two_clusters(table(spark, d, "embeddings"), ["label"], "embedding", "vec_id").select("id", "cluster", F.round("distance", 6).alias("distance"))


@query(f"WITH {_UNIT}, p AS (SELECT vec_id, label, u, lag(u) OVER (PARTITION BY label ORDER BY vec_id) AS v FROM u), x AS (SELECT vec_id, label, round(1 - list_dot_product(u, v), 6) AS distance FROM p WHERE v IS NOT NULL) SELECT * FROM x WHERE distance >= 0.2")
def probe_discontinuities(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return Q.probe_discontinuities(e, ["label"], "embedding", "vec_id").select("vec_id", "label", "distance")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("suite").orderBy("item_id")
    return table(spark, d, "eval_items").select("item_id", F.col("text").alias("ref"), F.lead("text").over(w).alias("hyp"))


# DuckDB's distance counts bytes: the symbols of a pair, at most 127, are told as ASCII characters
_CODES = "array_to_string(list_transform(range(1, 128), lambda x: chr(CAST(x AS INT))), '')"
_CER = f"""WITH p AS (SELECT item_id, coalesce(text, '') AS r, coalesce(lead(text) OVER (PARTITION BY suite ORDER BY item_id), '') AS h FROM eval_items), a AS (SELECT *, array_to_string(list_distinct(string_split(r || h, '')), '') AS alpha FROM p),
d AS (SELECT item_id, levenshtein(translate(r, alpha, substr({_CODES}, 1, length(alpha))), translate(h, alpha, substr({_CODES}, 1, length(alpha)))) AS char_distance, length(r) AS ref_chars FROM a)
SELECT *, CASE WHEN ref_chars > 0 THEN round(char_distance / CAST(ref_chars AS DOUBLE), 9) WHEN char_distance > 0 THEN 1.0 ELSE 0.0 END AS cer FROM d"""


@query(_CER)
def cer_pairs(spark: SparkSession, d: str) -> DataFrame:
    return X.character_errors(_pairs(spark, d), "ref", "hyp").drop("ref", "hyp")


@query()
def wer_pairs(spark: SparkSession, d: str) -> DataFrame:
    return X.word_errors(_pairs(spark, d), "ref", "hyp").drop("ref", "hyp")


@query(r"SELECT item_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '\p{P}+', '', 'g'), '\s+', ' ', 'g')) AS plain FROM eval_items")
def normalized_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", X.normalized(F.col("text")).alias("plain"))


@query("WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders), t AS (SELECT DISTINCT o_orderpriority, CASE WHEN least(n, 12) > 1 THEN CAST(round_even(i * (n - 1) / CAST(least(n, 12) - 1 AS DOUBLE), 0) AS BIGINT) ELSE 0 END AS r FROM r, range(12) x(i) WHERE i < least(n, 12)) SELECT o_orderkey, o_orderpriority FROM r JOIN t USING (o_orderpriority, r)")
def stratified_pick(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return P.evenly_ranked(o, ["o_orderpriority"], "o_totalprice", ["o_orderkey"], 12, 5_000.0).select("o_orderkey", "o_orderpriority")


@query("WITH r AS (SELECT o_orderstatus, CAST(floor(o_totalprice) AS BIGINT) AS g, o_orderkey FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY g DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM r), p AS (SELECT *, unnest([10, 20, 30, 40]) AS percent FROM k) SELECT o_orderstatus, percent, count(*) FILTER (WHERE r <= n * percent // 100) AS n_taken, CAST(coalesce(sum(g) FILTER (WHERE r <= n * percent // 100), 0) AS BIGINT) AS gain, CAST(sum(g) AS BIGINT) AS total FROM p GROUP BY 1, 2")
def oracle_count_curve(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderkey", F.floor("o_totalprice").alias("g"))
    return P.count_curve(o, ["o_orderstatus"], "g", "o_orderkey", [10, 20, 30, 40], 5_000.0)


@query()
def knapsack_pick(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("w", F.floor(F.col("o_totalprice") / 1000)).withColumn("g", F.col("o_orderkey") % 17)
    return P.best_within(o, ["o_custkey"], "w", "g", "o_orderkey", 0.4)


@query("WITH e AS (SELECT *, epoch_us(ts) AS s, epoch_us(ts) + CAST(round(value * 600000000) AS BIGINT) AS f FROM events), p AS (SELECT *, lead(s) OVER w AS ns, lead(f) OVER w AS nf, CAST(event_id % 40 AS BIGINT) AS rc, CASE WHEN event_id % 9 <> 0 THEN CAST(event_id % 37 AS BIGINT) END AS hc FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, f)) SELECT user_id, count(*) AS n, round(least(1, coalesce(CAST(sum(CASE WHEN ns IS NULL THEN 0 ELSE greatest(0, least(f, nf) - greatest(s, ns)) END) AS DOUBLE) / nullif(CAST(sum(f - s) AS DOUBLE), 0), 0)), 9) AS duplicate_risk, round(least(1, coalesce(CAST(sum(CASE WHEN hc IS NULL THEN 0 ELSE greatest(0, rc - hc) END) AS DOUBLE) / nullif(CAST(sum(CASE WHEN hc IS NULL THEN 0 ELSE rc END) AS DOUBLE), 0), 0)), 9) AS deletion_risk FROM p GROUP BY 1")
def duplicate_risk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("start_us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.select("user_id", "start_us", (F.col("start_us") + F.round(F.col("value") * 600_000_000).cast("bigint")).alias("end_us"), (F.col("event_id") % 40).cast("bigint").alias("rc"), F.when(F.col("event_id") % 9 != 0, (F.col("event_id") % 37).cast("bigint")).alias("hc"))
    return P.duplicate_risk(e, ["user_id"], "rc", "hc", 24 * 3_600_000_000)


@query(f"WITH k AS (SELECT 'session' AS kind, {sql_plain('session_id')} AS key, {sql_plain('split')} AS split FROM split_keys UNION ALL SELECT 'recording', {sql_plain('recording_id')}, {sql_plain('split')} FROM split_keys UNION ALL SELECT 'source', {sql_plain('source_recording_id')}, {sql_plain('split')} FROM split_keys UNION ALL SELECT 'group', {sql_plain('augmentation_group')}, {sql_plain('split')} FROM split_keys UNION ALL SELECT 'speaker', {sql_plain('s')}, {sql_plain('split')} FROM (SELECT unnest(speaker_ids) AS s, split FROM split_keys)) SELECT kind, key, count(DISTINCT split) AS n_splits, count(*) AS n_rows FROM k WHERE key IS NOT NULL AND split IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT split) > 1")
def split_leakage(spark: SparkSession, d: str) -> DataFrame:
    named = {"session": "session_id", "recording": "recording_id", "source": "source_recording_id", "group": "augmentation_group", "speaker": "speaker_ids"}
    return Y.split_leakage(table(spark, d, "split_keys"), "split", named)


@query(f"WITH {VIEWS}, j AS (SELECT CASE WHEN r.label = 'REF_00' THEN 'A' ELSE 'B' END AS before, h.label AS after, h.end_us - h.start_us AS n FROM ref r JOIN hyp h USING (row_id)) SELECT before, after, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS total_us FROM j GROUP BY 1, 2")
def label_parity(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the same rows in two versions."""
    old = ref_spans(spark, d).withColumn("label", F.when(F.col("label") == "REF_00", "A").otherwise("B"))
    return Y.label_parity(old, hyp_spans(spark, d))


@query(f"SELECT {sql_plain('audio_id')} AS audio, rttm_sha256, arg_min(row_id, (submitted_at, row_id)) AS first_row, count(*) AS n_submitted FROM predictions WHERE {sql_plain('audio_id')} IS NOT NULL AND rttm_sha256 IS NOT NULL GROUP BY 1, 2")
def idempotent_submissions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "predictions").withColumn("audio", plain_form(F.col("audio_id")))
    return Y.first_submissions(p, ["audio", "rttm_sha256"], "submitted_at")


@query("SELECT coalesce(CASE quality_status WHEN 'PASS_HIGH' THEN 'SPEAKERS' WHEN 'PASS_STANDARD' THEN 'SPEAKERS' WHEN 'PASS_WITH_UNATTRIBUTED' THEN 'PARTIAL' WHEN 'REVIEW_REQUIRED' THEN 'NEUTRAL' END, 'NONE') AS mode, count(*) AS n_rows FROM predictions GROUP BY 1")
def status_modes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "predictions").groupBy(Y.summary_mode(F.col("quality_status")).alias("mode")).agg(F.count("*").alias("n_rows"))


@query(f"WITH i AS (SELECT row_id, unnest([CASE WHEN {sql_plain('audio_id')} IS NULL THEN 'AUDIO_ID' END, CASE WHEN audio_sha256 IS NULL OR NOT regexp_full_match(audio_sha256, '[0-9a-f]{{64}}') THEN 'AUDIO_HASH' END, CASE WHEN coalesce(sample_rate_hz, 0) NOT IN (8000, 16000) THEN 'SAMPLE_RATE' END, CASE WHEN speaker_count IS NULL OR speaker_count < 1 THEN 'SPEAKER_COUNT' END, CASE WHEN speaker_group_ids IS NULL OR len(speaker_group_ids) <> speaker_count THEN 'SPEAKER_GROUPS' END, CASE WHEN conditions IS NULL THEN 'CONDITIONS' END]) AS issue FROM manifest) SELECT row_id, issue FROM i WHERE issue IS NOT NULL")
def manifest_issues(spark: SparkSession, d: str) -> DataFrame:
    return Y.manifest_issues(table(spark, d, "manifest"))


@query(f"WITH l AS (SELECT 'split' AS dim, {sql_plain('split')} AS value FROM manifest UNION ALL SELECT 'gender', gender_pair FROM manifest UNION ALL SELECT 'rate', CAST(sample_rate_hz AS VARCHAR) FROM manifest UNION ALL SELECT 'condition', unnest(conditions) FROM manifest) SELECT dim, coalesce(value, '') AS value, count(*) AS n_rows FROM l GROUP BY 1, 2")
def readiness_counts(spark: SparkSession, d: str) -> DataFrame:
    dims = {"split": plain_form(F.col("split")), "gender": F.col("gender_pair"), "rate": F.col("sample_rate_hz")}
    return Y.value_counts(table(spark, d, "manifest"), dims, {"condition": "conditions"})


@query("WITH s AS (SELECT l_suppkey AS recording, CAST(l_quantity AS BIGINT) AS x FROM lineitem), g AS (SELECT recording, count(*) AS n, CAST(sum(x * x) AS BIGINT) AS squares, max(abs(x)) AS peak FROM s GROUP BY 1) SELECT *, round(greatest(1, least(4, 40 / sqrt(squares / n), 50 / peak)), 9) AS gain, CASE WHEN 40 / sqrt(squares / n) <= 1 THEN 'LOUD' WHEN 50 / peak < least(4, 40 / sqrt(squares / n)) THEN 'PEAK_LIMITED' ELSE 'RAISED' END AS reason FROM g")
def global_gain(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("recording"), F.col("l_quantity").cast("bigint").alias("x"))
    return Y.raised_gain(pcm_stats(x, ["recording"]), 40.0, 50.0)


_SAMPLES = "s AS (SELECT user_id AS recording, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS k, CAST(round(value * 10) AS BIGINT) - 2000 AS x FROM events)"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("recording"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_t"), (F.round(F.col("value") * 10).cast("bigint") - 2000).alias("x"))
    return counted_rank(e, ["recording"], "_t", [F.col("x")], 24 * 3_600_000_000, "k").select("recording", (F.col("k") - 1).alias("k"), "x")


@query(f"WITH {_SAMPLES}, p AS (SELECT *, coalesce(lead(x) OVER (PARTITION BY recording ORDER BY k), x) AS y FROM s), o AS (SELECT recording, k * 2 AS k, x FROM p UNION ALL SELECT recording, k * 2 + 1, CASE WHEN x + y >= 0 THEN (x + y + 1) // 2 ELSE -((-(x + y) + 1) // 2) END FROM p) SELECT recording, CAST(k AS BIGINT) AS k, CAST(x AS BIGINT) AS x FROM o")
def linear_upsample(spark: SparkSession, d: str) -> DataFrame:
    return G.doubled(_samples(spark, d), ["recording"])


@query(f"WITH {_SAMPLES} SELECT recording, CAST(k // 2 AS BIGINT) AS k, round(avg(x), 9) AS x FROM s GROUP BY 1, 2")
def pairwise_downsample(spark: SparkSession, d: str) -> DataFrame:
    return Y.averaged_pairs(_samples(spark, d), ["recording"])


@query("SELECT event_id, CAST((2 * (event_id * 48000 + user_id)::HUGEINT * 1000000 + 44100) // (2 * 44100) AS BIGINT) AS at_us FROM events")
def sample_times(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", sample_to_us(F.col("event_id") * 48000 + F.col("user_id"), F.lit(44100)).alias("at_us"))


@query("WITH r AS (SELECT run_kind, TRY_CAST(json_extract_string(report, '$.rtf') AS DOUBLE) AS rtf FROM run_reports WHERE report IS NOT NULL AND json_valid(report)) SELECT run_kind, count(*) AS n_runs, count(rtf) AS n_rtf, round(max(rtf), 9) AS max_rtf, round(avg(rtf), 9) AS mean_rtf, round(quantile_cont(rtf, 0.95), 9) AS p95_rtf FROM r GROUP BY 1")
def run_speed(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "run_reports").withColumn("v", F.try_parse_json("report")).where("v IS NOT NULL").withColumn("rtf", F.try_variant_get("v", "$.rtf", "double"))
    return Y.speed_summary(r, "run_kind", "rtf")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(min(l_extendedprice), 2) AS low, round(max(l_extendedprice), 2) AS high, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1, 2")
def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_extendedprice")
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.min(x), 2).alias("low"), F.round(F.max(x), 2).alias("high"), F.round(F.percentile(x, F.lit(0.5)), 6).alias("median"), F.round(F.percentile(x, F.lit(0.9)), 6).alias("p90"))


@query("WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: exp(x - list_max(embedding::DOUBLE[]))) AS e FROM embeddings) SELECT vec_id, round(list_max(e) / list_sum(e), 9) AS top FROM s")
def softmax_tops(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.round(F.array_max(softmax(F.col("embedding").cast("array<double>"))), 9).alias("top"))


@query("WITH h AS (SELECT row_id, sha256(concat_ws('|', audio_sha256, 'span', duration_us)) AS h FROM recordings) SELECT row_id, array_to_string(list_transform(range(26), lambda k: substr('abcdefghijklmnopqrstuvwxyz234567', CAST((CAST(('0x' || substr(h, 5 * k // 4 + 1, 3)) AS INT) >> CAST(7 - 5 * k % 4 AS INT)) & 31 AS INT) + 1, 1)), '') AS object_id FROM h")
def base32_ids(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "recordings")
    return r.select("row_id", base32_id(F.col("audio_sha256"), F.lit("span"), F.col("duration_us")).alias("object_id"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    reader, path = spark.readStream.schema(schema), f"{d}/events.parquet"
    stream = reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n_events FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    return drained(windowed_counts(_stream(spark, d), "at", ["event_type"]), complete=True)


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL '6 hours' THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM e) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '6 hours' AS session_end, count(*) AS n_events FROM g GROUP BY user_id, g")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return drained(sessions(_stream(spark, d), "at", ["user_id"], "6 hours"), complete=True)


@query(f"WITH e AS (SELECT user_id AS recording, epoch_us(ts) AS start_us, epoch_us(ts) + 3600000000 AS end_us, value / 500 AS p FROM events), b AS (SELECT *, CASE WHEN lag(end_us) OVER (PARTITION BY recording ORDER BY start_us) = start_us THEN 0 ELSE 1 END AS z FROM e), sg AS (SELECT * EXCLUDE (z), sum(z) OVER (PARTITION BY recording ORDER BY start_us) AS seg FROM b), {_hyst('sg', 'recording, seg', '0.5', '0.35')} SELECT recording, start_us, end_us FROM reg")
def stream_hysteresis(spark: SparkSession, d: str) -> DataFrame:
    """Events as frames of one hour each, in order of arrival."""
    at = F.unix_micros("at")
    f = _stream(spark, d).select(F.col("user_id").alias("recording"), at.alias("start_us"), (at + 3_600_000_000).alias("end_us"), (F.col("value") / 500).alias("p"))
    return drained(streaming_hysteresis(f, "recording"))


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
