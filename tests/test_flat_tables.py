import json

from pyspark.sql import functions as F

from chronoloom.operators.nested import flat_rows, flat_table, merged_schema, nested_nodes, schema_kinds, surrogate_key
from chronoloom.plans import training_data

TEXTS = [
    '{"cpu_limit": {"throttled_wall_ratio": 0.5}, "name": "x", "evidence": "{\\"input\\": {\\"duration_seconds\\": 4}}", "runs": [{"n": 1, "subs": [{"ok": true}, 3]}], "odd": [[{"q": "z"}]]}',
    '{"decoder_calibration": {"accepted": false, "candidates": {"n": 7}}, "name": 5}', "{}", '[{"a": 1}]', '{"a": 1', None,
]


def tables(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row_id BIGINT, report STRING")
    schema = merged_schema(df, "report")
    return nested_nodes(df, schema=schema, roots=True), schema


def test_runs_table(spark):
    nodes, schema = tables(spark)
    runs = flat_table(nodes, "", schema)
    types = dict(runs.dtypes)
    assert types["cpu_limit_throttled_wall_ratio"] == "double" and types["evidence_input_duration_seconds"] == "double" and types["decoder_calibration_accepted"] == "boolean" and types["name"] == "string"
    got = {r.row_id: (r.cpu_limit_throttled_wall_ratio, r.evidence_input_duration_seconds, r.decoder_calibration_accepted, r.name) for r in runs.collect()}
    assert got == {0: (0.5, 4.0, None, "x"), 1: (None, None, False, "5"), 2: (None,) * 4, 3: (None,) * 4}
    assert runs.where("parent_key IS NOT NULL").count() == 0
    # every other object refers to a row of some table
    keys = nodes.select(surrogate_key(F.col("row_id"), F.col("node")).alias("k"))
    every = flat_rows(nodes, schema)
    assert every.where("kind <> ''").join(keys, F.col("parent_key") == F.col("k"), "left_anti").count() == 0


def test_every_kind_has_its_table(spark):
    nodes, schema = tables(spark)
    got = sorted((r.kind, r.row_id, json.loads(r.fields)) for r in flat_rows(nodes, schema).where("kind <> ''").collect())
    assert got == [("[]", 3, {"a": 1.0}), ("decoder_calibration.candidates[]", 1, {"n": 7.0}), ("odd[][]", 0, {"q": "z"}), ("runs[]", 0, {"n": 1.0}), ("runs[].subs[]", 0, {"ok": True})]
    for kind in schema_kinds(schema):
        assert flat_table(nodes, kind, schema).count() == nodes.where(F.col("kind") == kind).count()


def test_registered():
    assert {"p2_runs", "p2_tables", "p2_candidates", "p2_folds", "p2_overrides", "p2_local_groups", "p2_passes", "p2_samples", "p2_files", "p2_chunks"} <= set(training_data.queries())
