import json
import random

from chronoloom.operators.nested import ARRAY_FIELDS, SCALAR_PATHS, flat_table, merged_schema, nested_nodes, scalar_rows


def brute(text):
    """Nodes of one report by a plain recursive walk."""
    try:
        root = json.loads(text)
    except (TypeError, ValueError):
        return None
    if isinstance(root, dict):
        for k, v in root.items():
            if isinstance(v, str):
                try:
                    root[k] = json.loads(v)
                except ValueError:
                    pass
    out = []

    def walk(v, path, owner, name):
        if isinstance(v, dict) and name in ARRAY_FIELDS:
            v = [v]
        if isinstance(v, list):
            for i, x in enumerate(v):
                node = f"{path}[{i}]"
                if isinstance(x, dict):
                    out.append((owner, node))
                    for k, y in x.items():
                        walk(y, f"{node}.{k}", node, k)
                else:
                    walk(x, node, owner, None)
        elif isinstance(v, dict):
            for k, y in v.items():
                walk(y, f"{path}.{k}" if path else k, owner, k)

    walk(root, "", "", None)
    for p in SCALAR_PATHS:
        v = root
        for k in p.split("."):
            v = v.get(k) if isinstance(v, dict) else None
        if v is not None:
            out.append(("", p))
    return out


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "row_id BIGINT, report STRING, kind STRING")
    rows = [(r.row_id, r.parent, r.node) for r in nested_nodes(df).collect()] + [(r.row_id, "", r.node) for r in scalar_rows(df).collect()]
    return sorted(rows)


def expected(texts):
    return sorted((i, p, n) for i, t in enumerate(texts) for p, n in (brute(t) or []))


def random_value(rng, depth):
    r = rng.random()
    if depth == 0 or r < 0.25:
        return rng.choice([None, 1, 2.5, True, "s", "[1]", ""])
    if r < 0.6:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: random_value(rng, depth - 1) for k in rng.sample(["a", "b c", "it's", "folds", "samples", "d"], rng.randrange(4))}


def test_random_reports(spark):
    rng = random.Random(5)
    texts = [json.dumps({k: random_value(rng, 3) for k in ("evidence", "folds")}, ensure_ascii=False) for _ in range(25)]
    assert found(spark, texts) == expected(texts)


def test_edge_reports(spark):
    texts = [
        None, "", "{", "null", "3", "{}", "[]", '[{"a": [{}]}]', '{"candidates": {"folds": {"x": 1}}}',
        '{"evidence": "{\\"input\\": {\\"duration_seconds\\": 4}}"}', '{"decoder_calibration": {"accepted": false}, "cpu_limit": {"throttled_wall_ratio": null}}',
        '{"a": [[{"b": [null, {"c": 1}]}]]}', '{"a": 1', '{"a": [1, "x", {"y": []}]}', '{"a": [{"t": "' + "z" * 50_000 + '"}]}', '{"a": [{}]} trailing',
    ]
    assert found(spark, texts) == expected(texts)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_flat_table_types_and_links(spark):
    texts = ['{"runs": [{"n": 1, "ordinal": "q", "subs": [{"ok": true, "m": {"v": 2}}]}]}', '{"runs": [{"n": 2.5, "subs": [{"ok": "no"}]}]}']
    df = spark.createDataFrame(list(enumerate(texts)), "row_id BIGINT, report STRING")
    schema = merged_schema(df, "report")
    nodes = nested_nodes(df, schema=schema)
    runs = flat_table(nodes, "runs[]", schema)
    subs = flat_table(nodes, "runs[]\u0001subs[]", schema)
    assert dict(runs.dtypes)["n"] == "double" and dict(runs.dtypes)["ordinal_2"] == "string"
    assert dict(subs.dtypes)["ok"] == "string" and dict(subs.dtypes)["m_v"] == "double"
    keys = {r.node_key for r in runs.collect()}
    assert {r.parent_key for r in subs.collect()} == keys and len(keys) == 2
