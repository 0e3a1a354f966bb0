"""Queries of the general training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.ids import plain_form
from chronoloom.operators.nested import ARRAY_FIELDS, SCALAR_PATHS, flat_rows, flat_table, merged_schema, nested_nodes, rejected_reports, scalar_rows
from chronoloom.operators.periods import periods_and_gaps
from chronoloom.operators.references import Reference, orphan_references, orphan_report
from chronoloom.sources.lines import classify_lines, failure_report, predictions_loaded, turns_loaded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    rec, man, pred = (table(spark, d, t) for t in ("recordings", "manifest", "predictions"))
    return orphan_references([
        Reference(man, "manifest", "row_id", "audio_id", "added_at", rec, "recordings", "audio_id", "registered_at", "deleted_at"),
        Reference(pred, "predictions", "row_id", "audio_id", "submitted_at", man, "manifest", "audio_id", "added_at", "withdrawn_at"),
    ])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("src_table", "row_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    reports = table(spark, d, "run_reports")
    nodes = nested_nodes(reports).select("row_id", "parent", "node")
    return nodes.unionByName(scalar_rows(reports).select("row_id", F.lit("").alias("parent"), "node"))


def p2_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Rows per kind of nested object, and how many of their reports have them."""
    kind = F.translate("kind", "\u0001", ".").alias("kind")
    return nested_nodes(table(spark, d, "run_reports")).groupBy(kind).agg(F.count("*").alias("n_objects"), F.countDistinct("row_id").alias("n_reports"))


#: Kinds of nested object in the given reports that have a query of their own; p2_tables has any kind.
P2_TABLES = {
    "p2_runs": "", "p2_candidates": "decoder_calibration.candidates[]", "p2_folds": "decoder_calibration.candidates[].folds[]", "p2_overrides": "decoder_calibration.candidates[].folds[].overrides[]",
    "p2_local_groups": "decoder_calibration.aggregate_diagnostics.local_groups[]", "p2_passes": "cpu_limit.passes[]", "p2_samples": "cpu_limit.passes[].samples[]",
    "p2_files": "evidence.input.files[]", "p2_chunks": "evidence.input.files[].chunks[]", "p2_reviews": "reviews[]",
}


def _p2_nodes(spark: SparkSession, d: str) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    reports = table(spark, d, "run_reports")
    schema = merged_schema(reports, "report")
    return nested_nodes(reports, schema=schema, roots=True), schema


def _p2_table(name: str):  # noqa: ANN202
    def run(spark: SparkSession, d: str) -> DataFrame:
        nodes, schema = _p2_nodes(spark, d)
        return flat_table(nodes, P2_TABLES[name].replace(".", "\u0001"), schema)

    run.__name__, run.__doc__ = name, f"The flat table of kind {P2_TABLES[name] or 'run'}, linked to its parents."
    return run


def p2_tables(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the runs and of every kind in the merged schema, with their columns as JSON."""
    return flat_rows(*_p2_nodes(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return classify_lines(table(spark, d, "raw_lines")).where("kind = 'fail'").select("line_id", "reason")


def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns_loaded(classify_lines(table(spark, d, "raw_lines")), ["line_id"])


def p6_predictions(spark: SparkSession, d: str) -> DataFrame:
    return predictions_loaded(classify_lines(table(spark, d, "raw_lines")), ["line_id"])


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return failure_report(classify_lines(table(spark, d, "raw_lines")))


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "rttm").select("file_id", "channel", F.when(F.col("speaker_id").isNotNull(), F.coalesce(plain_form(F.col("speaker_id")), F.lit(""))).alias("speaker_id"), "start_us", "end_us")
    return periods_and_gaps(turns, table(spark, d, "uem"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _intervals(spark, d).where("kind = 'gap' OR n_rows >= 2").drop("n_rows")


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    """Covered or uncovered time per file, channel and speaker."""
    return _intervals(spark, d).groupBy("kind", "file_id", "channel", "speaker_id").agg(F.count("*").alias("n_stretches"), F.sum(F.col("end_us") - F.col("start_us")).alias("total_us"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_kinds, p2_rejects, p2_tables, *map(_p2_table, P2_TABLES), p6_found, p6_turns, p6_predictions, p6_report, p7_found, p7_totals)}


def sql_plain(column: str) -> str:
    """The plain form of an id in DuckDB's SQL."""
    t = f"translate({column}, '０１２３４５６７８９', '0123456789')"
    return f"nullif(lower(regexp_replace({t}, '[^\\p{{L}}]', '', 'g')) || regexp_replace(regexp_replace({t}, '[^0-9]', '', 'g'), '^0+([0-9])', '\\1'), '')"


def _p1_sql(tail: str) -> str:
    return f"""
WITH rec AS (SELECT {sql_plain('audio_id')} AS k, registered_at AS a, deleted_at AS b FROM recordings),
man AS (SELECT row_id, {sql_plain('audio_id')} AS k, added_at AS a, withdrawn_at AS b FROM manifest),
pre AS (SELECT row_id, {sql_plain('audio_id')} AS k, submitted_at AS t FROM predictions),
o AS (
  SELECT 'manifest' AS src_table, 'recordings' AS parent_table, row_id, k, a AS t FROM man m WHERE k IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM rec r WHERE r.k = m.k AND r.a <= m.a AND (r.b IS NULL OR m.a < r.b))
  UNION ALL
  SELECT 'predictions', 'manifest', row_id, k, t FROM pre p WHERE k IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM man m WHERE m.k = p.k AND m.a <= p.t AND (m.b IS NULL OR p.t < m.b))
) {tail}"""


_RTTM = r"""
r AS (SELECT *, regexp_split_to_array(trim(raw, ' ' || chr(9)), '[ \t]+') AS f FROM raw_lines WHERE fmt = 'rttm'
  AND trim(raw) <> '' AND trim(raw, ' ' || chr(9)) <> '' AND NOT starts_with(ltrim(raw, ' ' || chr(9)), '#')),
rc AS (SELECT line_id, batch, fmt, f, CASE WHEN len(f) <> 10 THEN 'COLUMN_COUNT'
  WHEN upper(f[1]) = 'SPEAKER' AND regexp_full_match(f[2], '[A-Za-z0-9][A-Za-z0-9_.\-]{0,127}')
   AND regexp_full_match(f[4], '[0-9]+(\.[0-9]+)?') AND regexp_full_match(f[5], '[0-9]+(\.[0-9]+)?')
   AND try_cast(f[5] AS DECIMAL(30,12)) > 0 AND try_cast(f[4] AS DECIMAL(30,12)) + try_cast(f[5] AS DECIMAL(30,12)) <= 86400 THEN NULL
  ELSE 'VALUE' END AS reason FROM r)"""
_PRED = r"""
p AS (SELECT *, regexp_extract_all(raw || ',', '("(?:[^"]|"")*"|[^",]*),') AS g FROM raw_lines WHERE fmt = 'pred'
  AND trim(raw, ' ' || chr(9)) <> '' AND NOT starts_with(ltrim(raw, ' ' || chr(9)), '#') AND trim(raw) <> 'audio_id,rttm,rttm_sha256,quality_status'),
q AS (SELECT *, [CASE WHEN starts_with(x, '"') THEN replace(x[2:len(x) - 2], '""', '"') ELSE x[1:len(x) - 1] END FOR x IN g] AS v FROM p),
pc AS (SELECT line_id, batch, fmt, v, CASE
  WHEN NOT regexp_full_match(raw, '([^",]*|"([^"]|"")*")(,([^",]*|"([^"]|"")*"))*') THEN 'QUOTING'
  WHEN len(v) <> 4 THEN 'COLUMN_COUNT'
  WHEN regexp_full_match(v[1], '[A-Za-z0-9][A-Za-z0-9_.\-]{0,127}') AND v[2] <> '' AND regexp_full_match(v[3], '[0-9A-Fa-f]{64}')
   AND v[4] IN ('PASS_HIGH', 'PASS_STANDARD', 'PASS_WITH_UNATTRIBUTED', 'REVIEW_REQUIRED', 'UNSUPPORTED') THEN NULL
  ELSE 'VALUE' END AS reason FROM q)"""


def _p7_sql(tail: str) -> str:
    return f"""
WITH t AS (SELECT file_id, channel, coalesce({sql_plain('speaker_id')}, '') AS speaker_id, start_us, end_us FROM rttm
  WHERE speaker_id IS NOT NULL AND start_us IS NOT NULL AND end_us > start_us),
u AS (SELECT file_id, channel, start_us, end_us FROM uem WHERE start_us IS NOT NULL AND end_us > start_us),
a AS (SELECT *, CASE WHEN start_us <= max(end_us) OVER (PARTITION BY file_id, channel, speaker_id ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM t),
b AS (SELECT *, sum(f) OVER (PARTITION BY file_id, channel, speaker_id ORDER BY start_us, end_us, f DESC ROWS UNBOUNDED PRECEDING) AS g FROM a),
periods AS (SELECT file_id, channel, speaker_id, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n_rows FROM b GROUP BY file_id, channel, speaker_id, g),
e AS (SELECT file_id, channel, t, sum(du) AS du, sum(dt) AS dt FROM (
  SELECT file_id, channel, start_us AS t, 1 AS du, 0 AS dt FROM u UNION ALL SELECT file_id, channel, end_us, -1, 0 FROM u
  UNION ALL SELECT file_id, channel, start_us, 0, 1 FROM t UNION ALL SELECT file_id, channel, end_us, 0, -1 FROM t) GROUP BY 1, 2, 3),
s AS (SELECT *, sum(du) OVER w > 0 AND sum(dt) OVER w = 0 AS open, lead(t) OVER w AS nxt FROM e WINDOW w AS (PARTITION BY file_id, channel ORDER BY t)),
c AS (SELECT file_id, channel, t AS start_us, nxt AS end_us FROM s WHERE open AND nxt IS NOT NULL),
d AS (SELECT *, CASE WHEN start_us = lag(end_us) OVER (PARTITION BY file_id, channel ORDER BY start_us) THEN 0 ELSE 1 END AS f FROM c),
h AS (SELECT *, sum(f) OVER (PARTITION BY file_id, channel ORDER BY start_us ROWS UNBOUNDED PRECEDING) AS g FROM d),
x AS (SELECT 'period' AS kind, file_id, channel, speaker_id, start_us, end_us, n_rows FROM periods
  UNION ALL SELECT 'gap', file_id, channel, '', min(start_us), max(end_us), 0 FROM h GROUP BY file_id, channel, g)
{tail}"""


#: Every object inside an array, by the tree of each report's branches; text branches are opened first.
_P2_NODES = f"""WITH r AS (SELECT row_id, report FROM run_reports WHERE report IS NOT NULL AND json_valid(report)),
b AS (SELECT row_id, k, json_extract(report, '$."' || k || '"') AS v FROM (SELECT row_id, report, unnest(json_keys(report)) AS k FROM r WHERE json_type(report) = 'OBJECT')),
o AS (SELECT row_id, k, CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(v->>'$') THEN (v->>'$')::JSON ELSE v END AS v FROM b UNION ALL SELECT row_id, NULL, report FROM r WHERE json_type(report) = 'ARRAY'),
t AS (SELECT o.row_id, o.k, x.type, x.fullkey, x.value AS val FROM o, json_tree(o.v) x WHERE x.type = 'OBJECT'),
c AS (SELECT row_id, val, string_split(replace(coalesce(k, '') || substr(fullkey, 2), '"', ''), '.') AS p FROM t),
n AS (SELECT row_id, val, array_to_string(list_transform(p, lambda x: CASE WHEN x IN ({', '.join(f"'{x}'" for x in ARRAY_FIELDS)}) THEN x || '[0]' ELSE x END), '.') AS node FROM c),
nodes AS (SELECT row_id, node FROM n WHERE ends_with(node, ']')),
links AS (SELECT a.row_id, a.node, max_by(p.node, length(p.node)) AS parent FROM nodes a LEFT JOIN nodes p ON p.row_id = a.row_id AND starts_with(a.node, p.node || '.') GROUP BY a.row_id, a.node)"""
_P2_FOUND = _P2_NODES + " SELECT row_id, coalesce(parent, '') AS parent, node FROM links" + "".join(
    f" UNION ALL SELECT row_id, '', '{x}' FROM o WHERE k = '{x.partition('.')[0]}' AND coalesce(json_type(v, '$.{x.partition('.')[2]}'), 'NULL') <> 'NULL'" for x in SCALAR_PATHS
)


def _p2_sql(name: str, columns: dict[str, tuple[str, str]]) -> str:
    """The table of one kind: *columns* name a path and a type each."""
    key = lambda x: f"CAST(('0x' || substr(md5(n.row_id || ':' || {x}), 1, 15)) AS BIGINT)"
    cols = "".join(f", TRY_CAST(n.val->>'$.{path}' AS {kind}) AS {c}" for c, (path, kind) in columns.items())
    kind = r"regexp_replace(n.node, '\[\d+\]', '[]', 'g')"
    return _P2_NODES + rf" SELECT {key('n.node')} AS node_key, {key("coalesce(l.parent, '')")} AS parent_key, n.row_id, CAST(regexp_extract(n.node, '\[(\d+)\]$', 1) AS INT) AS ordinal{cols} FROM n JOIN links l ON l.row_id = n.row_id AND l.node = n.node WHERE {kind} = '{P2_TABLES[name]}'"


_METRICS = {f"metrics_{x}": (f"metrics.{x}", "DOUBLE") for x in ("accuracy", "complete_merge", "coverage", "turn_coverage")}
_P2_SQL = {
    name: _p2_sql(name, columns)
    for name, columns in {
        "p2_candidates": {"candidate_id": ("candidate_id", "VARCHAR"), **_METRICS, "switch_base": ("switch_base", "DOUBLE")}, "p2_folds": {"fold": ("fold", "DOUBLE"), **_METRICS},
        "p2_overrides": {"count": ("count", "DOUBLE"), "duration_us": ("duration_us", "DOUBLE"), "kind": ("kind", "VARCHAR")}, "p2_local_groups": {"count": ("count", "DOUBLE"), "embedding_valid": ("embedding_valid", "BOOLEAN"), "kind": ("kind", "VARCHAR")},
        "p2_passes": {"name": ("name", "VARCHAR"), "wall_seconds": ("wall_seconds", "DOUBLE")}, "p2_samples": {"at_us": ("at_us", "DOUBLE"), "rss_mb": ("rss_mb", "DOUBLE")}, "p2_files": {"audio_id": ("audio_id", "VARCHAR")},
        "p2_chunks": {"frames": ("frames", "DOUBLE"), "ordinal_2": ("ordinal", "DOUBLE")}, "p2_reviews": {"step": ("step", "DOUBLE"), "verdict": ("verdict", "VARCHAR")},
    }.items()
}


def p2_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Reports that none of the tables hold, with the reason."""
    return rejected_reports(table(spark, d, "run_reports"))


def oracle_sql() -> dict[str, str]:
    return {
        **_P2_SQL,
        "p2_found": _P2_FOUND,
        "p2_kinds": _P2_NODES + r" SELECT regexp_replace(node, '\[\d+\]', '[]', 'g') AS kind, count(*) AS n_objects, count(DISTINCT row_id) AS n_reports FROM nodes GROUP BY 1",
        "p2_rejects": "SELECT row_id, CASE WHEN report IS NULL THEN 'MISSING' ELSE 'UNREADABLE' END AS reason FROM run_reports WHERE report IS NULL OR NOT json_valid(report)",
        "p1_found": _p1_sql("SELECT src_table, row_id FROM o"),
        "p1_report": _p1_sql("SELECT src_table, parent_table, strftime(timezone('UTC', t), '%Y-%m') AS period, count(*) AS orphan_rows, count(DISTINCT k) AS missing_keys FROM o GROUP BY 1, 2, 3"),
        "p6_found": f"WITH {_RTTM}, {_PRED} SELECT line_id, reason FROM rc WHERE reason IS NOT NULL UNION ALL SELECT line_id, reason FROM pc WHERE reason IS NOT NULL",
        "p6_turns": f"WITH {_RTTM} SELECT line_id, f[2] AS file_id, f[3] AS channel, f[8] AS speaker_id, CAST(round_even(CAST(f[4] AS DECIMAL(30,12)) * 1000000, 0) AS BIGINT) AS start_us, CAST(round_even((CAST(f[4] AS DECIMAL(30,12)) + CAST(f[5] AS DECIMAL(30,12))) * 1000000, 0) AS BIGINT) AS end_us FROM rc WHERE reason IS NULL",
        "p6_predictions": f"WITH {_PRED} SELECT line_id, v[1] AS audio_id, v[2] AS rttm, v[3] AS rttm_sha256, v[4] AS quality_status FROM pc WHERE reason IS NULL",
        "p6_report": f"WITH {_RTTM}, {_PRED}, x AS (SELECT line_id, reason FROM rc UNION ALL SELECT line_id, reason FROM pc) SELECT fmt, batch, CASE WHEN x.line_id IS NULL THEN 'skip' WHEN reason IS NULL THEN 'load' ELSE 'fail' END AS kind, coalesce(reason, '') AS reason, count(*) AS n_lines FROM raw_lines LEFT JOIN x USING (line_id) GROUP BY 1, 2, 3, 4",
        "p7_found": _p7_sql("SELECT kind, file_id, channel, speaker_id, start_us, end_us FROM x WHERE kind = 'gap' OR n_rows >= 2"),
        "p7_totals": _p7_sql("SELECT kind, file_id, channel, speaker_id, count(*) AS n_stretches, CAST(sum(end_us - start_us) AS BIGINT) AS total_us FROM x GROUP BY 1, 2, 3, 4"),
    }
