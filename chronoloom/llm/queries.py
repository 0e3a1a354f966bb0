"""Queries of this subpackage's operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.ids import plain_form
from chronoloom.llm.components import representatives
from chronoloom.llm.cross_split import coverage, cross_split_pairs, overlap_report, row_links
from chronoloom.llm.event_runs import collapse_runs
from chronoloom.llm.leakage import leaked_passages, leaks, without_leaks
from chronoloom.llm.packing import packed, packing_checks, packing_report
from chronoloom.llm.shared_spans import shared_share, shared_stretches
from chronoloom.llm.split_assign import assign_splits, split_balance
from chronoloom.plans.training_data import sql_plain, table
from chronoloom.session import cut


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cross_split_pairs(table(spark, d, "split_keys"))
    return pairs.select(F.least("train_row", "eval_row").alias("row_a"), F.greatest("train_row", "eval_row").alias("row_b"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap_report(cross_split_pairs(table(spark, d, "split_keys")))


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage(table(spark, d, "split_keys"))


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return row_links(table(spark, d, "split_keys"))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return assign_splits(table(spark, d, "split_keys"), table(spark, d, "split_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The sets that stay together, of the rows as they were assigned."""
    return representatives(_assigned(spark, d))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select("row_id", "split")


def p4_balance(spark: SparkSession, d: str) -> DataFrame:
    return split_balance(cut(_assigned(spark, d), "assigned"), table(spark, d, "split_targets"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "rttm").withColumn("speaker_id", F.when(F.col("speaker_id").isNotNull(), F.coalesce(plain_form(F.col("speaker_id")), F.lit(""))))
    return collapse_runs(turns, ["file_id", "channel"], "speaker_id", "start_us", "end_us", "row_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).where("n_events >= 2").select(F.col("first_row").alias("first_row_id"), F.col("last_row").alias("last_row_id"))


def p5_turns(spark: SparkSession, d: str) -> DataFrame:
    """Every run as one turn, single turns included."""
    return _runs(spark, d).select("file_id", "channel", F.col("label").alias("speaker_id"), F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n_events", F.col("duration").alias("duration_us"))


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packed(table(spark, d, "documents"), table(spark, d, "packing_specs"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing_report(p8_packed(spark, d))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    return packing_checks(p8_packed(spark, d), table(spark, d, "documents"))


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(_leaked(spark, d))


def p9_clean(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with leaked spans removed."""
    return without_leaks(table(spark, d, "documents"), _leaked(spark, d)).select("doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_stretches(table(spark, d, "documents"))


def p10_share(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return shared_share(docs, shared_stretches(docs))


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_report, p3_coverage, p3_links, p4_found, p4_splits, p4_balance, p5_found, p5_turns, p8_packed, p8_report, p8_checks, p9_found, p9_clean, p10_found, p10_share)}


def _p3_sql(tail: str) -> str:
    return f"""
WITH RECURSIVE k AS (SELECT row_id, {sql_plain('recording_id')} AS r, {sql_plain('source_recording_id')} AS src, {sql_plain('session_id')} AS s, {sql_plain('augmentation_group')} AS g, {sql_plain('split')} AS side FROM split_keys),
p AS (SELECT r, min(src) AS src FROM k WHERE r IS NOT NULL GROUP BY r),
walk AS (SELECT r, r AS top, 0 AS n FROM p UNION ALL SELECT w.r, p.src, n + 1 FROM walk w JOIN p ON p.r = w.top WHERE p.src IS NOT NULL AND p.src <> p.r AND n < 50),
o AS (SELECT r, max_by(top, n) AS o FROM walk GROUP BY r),
x AS (SELECT row_id, s, g, side, coalesce(o.o, k.r, k.src) AS o FROM k LEFT JOIN o USING (r)),
m AS (SELECT DISTINCT a.row_id AS train_row, b.row_id AS eval_row, b.side, b.o AS original FROM x a JOIN x b ON a.s = b.s OR a.g = b.g OR a.o = b.o
  WHERE a.side = 'calibration' AND b.side IN ('developmentholdout', 'releaseholdout'))
{tail}"""


_COVER = """, l AS (SELECT row_id, side, unnest(['s:' || s, 'g:' || g, 'o:' || o]) AS key FROM x), t AS (SELECT DISTINCT key FROM l WHERE side = 'calibration' AND key IS NOT NULL)
SELECT l.row_id, l.side, count(l.key) AS n_keys, count(t.key) AS n_matched, round(coalesce(sum(CASE WHEN t.key IS NULL THEN 0 ELSE length(l.key) END) / nullif(sum(length(l.key)), 0), 0), 9) AS covered
FROM l LEFT JOIN t ON t.key = l.key WHERE l.side IN ('developmentholdout', 'releaseholdout') GROUP BY 1, 2"""


def _p5_sql(tail: str) -> str:
    return f"""
WITH t AS (SELECT row_id, file_id, channel, coalesce({sql_plain('speaker_id')}, '') AS sp, start_us, end_us FROM rttm WHERE speaker_id IS NOT NULL AND start_us IS NOT NULL AND end_us > start_us),
a AS (SELECT *, CASE WHEN sp = lag(sp) OVER w THEN 0 ELSE 1 END AS c FROM t WINDOW w AS (PARTITION BY file_id, channel ORDER BY start_us, end_us, row_id)),
b AS (SELECT *, sum(c) OVER (PARTITION BY file_id, channel ORDER BY start_us, end_us, row_id ROWS UNBOUNDED PRECEDING) AS st FROM a),
c AS (SELECT *, CASE WHEN start_us <= 300000 + max(end_us) OVER (PARTITION BY file_id, channel, st ORDER BY start_us, end_us, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM b),
r AS (SELECT *, sum(n) OVER (PARTITION BY file_id, channel ORDER BY start_us, end_us, row_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
g AS (SELECT file_id, channel, run, any_value(sp) AS speaker_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_events, arg_min(row_id, (start_us, end_us, row_id)) AS first_row_id, arg_max(row_id, (start_us, end_us, row_id)) AS last_row_id FROM r GROUP BY 1, 2, 3)
{tail}"""


_P4 = f"""
WITH RECURSIVE k AS (SELECT row_id, 'r:' || {sql_plain('recording_id')} AS k FROM split_keys UNION ALL SELECT row_id, 's:' || {sql_plain('session_id')} FROM split_keys UNION ALL SELECT row_id, 'g:' || {sql_plain('augmentation_group')} FROM split_keys),
e AS (SELECT DISTINCT a.row_id AS u, b.row_id AS v FROM k a JOIN k b USING (k) WHERE a.row_id <> b.row_id),
reach AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v),
m AS (SELECT v AS row_b, min(u) AS row_a FROM reach GROUP BY v)
SELECT row_a, row_b FROM m WHERE row_a < row_b"""


_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))  # full-width forms, in the order of ASCII from '!'
_NARROW = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
#: Words as the operator takes them, for the compatibility forms that DuckDB can be told: widths, ligatures, the ellipsis.
_NORMAL = f"regexp_extract_all(lower(nfc_normalize(replace(replace(replace(translate(text, '{_WIDE}', '{_NARROW}'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '…', '...'))), '[\\p{{L}}\\p{{N}}]+')"
_P9 = f"""WITH d AS (SELECT doc_id, {_NORMAL} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, w, least(12, len(w)) AS k FROM (SELECT item_id, {_NORMAL} AS w FROM eval_items WHERE text IS NOT NULL) WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM i)), sz AS (SELECT DISTINCT k FROM i),
dg AS (SELECT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, sz WHERE len(w) >= k))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (k, g)"""
_P10 = """WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 320),
w AS (SELECT doc_id, i, md5(substr(text, i + 1, 320)) AS h FROM (SELECT doc_id, text, unnest(range(n - 319)) AS i FROM d)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)), p AS (SELECT doc_id, i FROM w SEMI JOIN s USING (h)),
f AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 320 THEN 0 ELSE 1 END AS f FROM p),
g AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM f),
x AS (SELECT doc_id, min(i) AS start_char, max(i) + 320 AS end_char FROM g GROUP BY doc_id, g)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p9_found": _P9,
        "p10_found": _P10 + " SELECT * FROM x",
        "p10_share": _P10 + """, y AS (SELECT doc_id, count(*) AS n, sum(end_char - start_char) AS c FROM x GROUP BY 1)
SELECT doc_id, coalesce(length(text), 0) AS text_chars, coalesce(n, 0) AS n_stretches, CAST(coalesce(c, 0) AS BIGINT) AS shared_chars, round(coalesce(c / nullif(length(text), 0), 0), 9) AS share FROM documents LEFT JOIN y USING (doc_id)""",
        "p3_found": _p3_sql("SELECT DISTINCT least(train_row, eval_row) AS row_a, greatest(train_row, eval_row) AS row_b FROM m"),
        "p3_report": _p3_sql("SELECT side, coalesce(original, '') AS source, count(*) AS n_pairs, count(DISTINCT eval_row) AS n_eval, count(DISTINCT train_row) AS n_train FROM m GROUP BY 1, 2"),
        "p3_coverage": _p3_sql(_COVER),
        "p3_links": _p3_sql(", l AS (SELECT train_row AS row_id FROM m UNION ALL SELECT eval_row FROM m), n AS (SELECT row_id, count(*) AS n FROM l GROUP BY 1) SELECT x.row_id, x.side, coalesce(x.o, x.s, x.g, '') AS class, coalesce(n, 0) AS n_links FROM x LEFT JOIN n USING (row_id) WHERE x.side IN ('calibration', 'developmentholdout', 'releaseholdout')"),
        "p4_found": _P4,
        "p4_balance": """WITH t AS (SELECT split_name AS split, (SELECT count(*) FROM split_keys) AS n, share / (SELECT sum(share) FROM split_targets) * 1.0 AS w FROM split_targets),
e AS (SELECT split, n, n * w AS exact, CAST(floor(n * w) AS BIGINT) AS f FROM t)
SELECT split, f + CASE WHEN row_number() OVER (ORDER BY f - exact, split) <= n - sum(f) OVER () THEN 1 ELSE 0 END AS quota, true AS within, 0 AS n_parted FROM e""",
        "p8_checks": "SELECT spec_id, capacity_tokens AS capacity, (SELECT count(*) FROM documents WHERE length(text) > 0) AS n_texts, 0 AS n_lost, 0 AS n_overfull, 0 AS n_parted, 0 AS n_misfilled FROM packing_specs",
        "p5_found": _p5_sql("SELECT first_row_id, last_row_id FROM g WHERE n_events >= 2"),
        "p5_turns": _p5_sql("SELECT file_id, channel, speaker_id, start_us, end_us, n_events, end_us - start_us AS duration_us FROM g"),
    }
