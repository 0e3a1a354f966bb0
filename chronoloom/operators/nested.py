"""Deeply nested JSON into related flat tables with parent-child links."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields whose lone object stands for an array of one, and the scalar fields reported by path.
ARRAY_FIELDS = ("candidates", "folds", "overrides", "local_groups", "passes", "samples", "files", "chunks")
SCALAR_PATHS = ("decoder_calibration.accepted", "cpu_limit.throttled_wall_ratio", "evidence.input.duration_seconds")

_SIMPLE = re.compile(r"[\w\- ]+")  # names a path expression can hold as they are
_SEP = "\u0001"  # between field names inside a path of the schema, where a dot may be part of a name


def _unwrap(root: object) -> object:
    """Top-level text branches that hold JSON count as what they hold."""
    if isinstance(root, dict):
        for k, v in root.items():
            if isinstance(v, str):
                try:
                    root[k] = json.loads(v)
                except ValueError:
                    pass
    return root


def _shapes(value: object, kind: str, lone: frozenset[str], out: set[tuple[str, str, str]]) -> None:
    """Collect (kind, path, shape): arrays below an object by their path through objects, and scalars.

    Walks with a stack of its own, since nesting may be deeper than Python's calls.
    """
    stack = [(value, kind, "")]
    while stack:
        v, k, path = stack.pop()
        if isinstance(v, dict) and path and path.rpartition(_SEP)[2] in lone:
            v = [v]
        if isinstance(v, list):
            out.add((k, path, "array"))
            stack += [(x, f"{k}{_SEP * bool(k and path)}{path}[]", "") for x in v]
        elif isinstance(v, dict):
            stack += [(x, k, f"{path}{_SEP}{name}" if path else name) for name, x in v.items()]
        elif v is not None and path:
            out.add((k, path, "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "text"))


def merged_schema(reports: DataFrame, column: str, lone: tuple[str, ...] = ARRAY_FIELDS) -> list[tuple[str, str, str]]:
    """The merged schema of all reports: sorted (kind, path, shape).

    One distributed pass over all rows; each partition sends its distinct shapes, and their union is
    collected. It is as large as the schema, not the data. A path of several shapes has several rows.
    """
    names = frozenset(lone)

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str, str]] = set()
        for b in batches:
            for text in b.column(0).to_pylist():
                try:
                    _shapes(_unwrap(json.loads(text)), "", names, seen)
                except (ValueError, TypeError, RecursionError):
                    pass
        rows = sorted(seen)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["kind", "path", "shape"])

    found = reports.select(F.col(column)).mapInArrow(infer, "kind STRING, path STRING, shape STRING").distinct()
    return sorted((r.kind, r.path, r.shape) for r in found.collect())


def _at(value: Column, path: str) -> Column:
    """The variant at a path of field names; null where it is absent or passes through something else."""
    simple: list[str] = []
    for name in path.split(_SEP):
        if _SIMPLE.fullmatch(name):
            simple.append(name)
            continue
        value, simple = _step(value, simple), []
        value = F.try_element_at(value.try_cast("map<string,variant>"), F.lit(name))
    return _step(value, simple)


def _step(value: Column, names: list[str]) -> Column:
    return F.try_variant_get(value, "$" + "".join(f"['{n}']" for n in names), "variant") if names else value


def _below(value: Column, path: str, at_root: bool) -> Column:
    """As :func:`_at`; from the root, a text branch that holds JSON counts as what it holds."""
    if not at_root:
        return _at(value, path)
    head, _, rest = path.partition(_SEP)
    branch = _at(value, head)
    held = F.try_parse_json(F.try_variant_get(branch, "$", "string"))
    opened = F.when(_is_object(branch) | branch.try_cast("array<variant>").isNotNull(), branch).otherwise(F.coalesce(held, branch))
    return _at(opened, rest) if rest else opened


def _is_object(value: Column) -> Column:
    return value.try_cast("map<string,variant>").isNotNull()


def parsed_reports(reports: DataFrame, row: str, column: str) -> DataFrame:
    """(row_id, v) of the complete reports; null, unreadable and cut-off ones are left out.

    ``[report]`` must be an array of exactly one element, which excludes text after the report.
    """
    text = F.col(column)
    whole = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return reports.select(F.col(row).alias("row_id"), F.when(whole, F.try_parse_json(text)).alias("v")).where("v IS NOT NULL")


def rejected_reports(reports: DataFrame, row: str = "row_id", column: str = "report") -> DataFrame:
    """Reports of which no row is made: row_id and reason.

    MISSING: null. UNREADABLE: blank, broken, cut off or with text after the report. TOO_LARGE: well
    formed, but beyond what a variant holds (its size, or nesting over a thousand levels).
    """
    text = F.col(column)
    whole = F.coalesce(F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1, F.lit(False))
    reason = F.when(text.isNull(), "MISSING").when(~whole, "UNREADABLE").when(F.try_parse_json(text).isNull(), "TOO_LARGE")
    return reports.select(F.col(row).alias("row_id"), reason.alias("reason")).where("reason IS NOT NULL")


def nested_nodes(reports: DataFrame, row: str = "row_id", column: str = "report", lone: tuple[str, ...] = ARRAY_FIELDS, schema: list[tuple[str, str, str]] | None = None, roots: bool = False) -> DataFrame:
    """One row per object inside an array, at any depth: row_id, parent, node, kind, ordinal, v.

    Method: infer the merged schema, then explode array level by array level. The arrays of a level
    are the schema's paths below the kinds of that level, so each level is one generator over the
    rows of the one above, carrying the parent's path and the array position; there is no shuffle.
    ``node`` is the surrogate key within a row and ``parent`` that of the nearest enclosing object
    that stands in an array, '' for the run itself, which with *roots* is a row of kind '' too.

    Defined cases: null elements and scalars give no row but keep their position; arrays directly in
    arrays add brackets to the path; a lone object in one of *lone* is an array of one; empty arrays
    and empty tables give nothing; values of varying shape are followed in each shape; a report
    delivered twice is two rows; unreadable reports give nothing; other columns are never read.
    """
    schema = merged_schema(reports, column, lone) if schema is None else schema
    paths: dict[str, list[str]] = {}
    for kind, path, shape in schema:
        if shape == "array":
            paths.setdefault(kind, []).append(path)
    names = ("parent", "node", "kind", "ordinal", "v", "fresh")

    def entry(parent: Column, node: Column, kind: Column, ordinal: Column, v: Column, fresh: bool) -> Column:
        return F.struct(*[c.alias(n) for c, n in zip((parent, node, kind, ordinal.cast("int"), v, F.lit(fresh)), names, strict=True)])

    rows = parsed_reports(reports, row, column).select("row_id", entry(F.lit(""), F.lit(""), F.lit(""), F.lit(0), F.col("v"), True).alias("e")).select("row_id", "e.*")
    held = F.filter(F.array(entry(*[F.col(n) for n in names[:5]], False)), lambda e: F.when(e["kind"] == "", F.lit(roots)).otherwise(_is_object(e["v"])))
    kinds = [""]
    while any(paths.get(k) for k in kinds):
        after, found = [], []
        for kind in kinds:
            for path in paths.get(kind, []):
                after.append(f"{kind}{_SEP * bool(kind and path)}{path}[]")
                found.append(_children(kind, path, after[-1], lone, entry))
        # what is found stays, the level just reached is expanded: one generator a level, nothing read twice
        rows = rows.select("row_id", F.explode(F.concat(held, *found)).alias("e")).select("row_id", "e.*")
        kinds = after
    return rows.where(F.when(F.col("kind") == "", F.lit(roots)).otherwise(_is_object(F.col("v")))).select("row_id", "parent", "node", "kind", "ordinal", "v")


def _children(kind: str, path: str, child: str, lone: tuple[str, ...], entry) -> Column:  # noqa: ANN001
    """The elements of the arrays at *path* below the rows of *kind* just reached, as an array of rows."""
    value = _below(F.col("v"), path, kind == "") if path else F.col("v")
    items = value.try_cast("array<variant>")
    if path.rpartition(_SEP)[2] in lone and path:
        items = F.coalesce(items, F.when(_is_object(value), F.array(value)))
    dot = F.when((F.col("node") != "") & F.lit(bool(path)), ".").otherwise("")
    # below an object it is the parent; below an array in an array the parent stays
    parent = F.when((F.col("kind") != "") & _is_object(F.col("v")), F.col("node")).otherwise(F.col("parent"))
    shown = path.replace(_SEP, ".")
    made = F.transform(items, lambda x, i: entry(parent, F.concat(F.col("node"), dot, F.lit(shown), F.lit("["), i, F.lit("]")), F.lit(child), i, x, True))
    kept = F.filter(made, lambda e: e["v"].isNotNull() & ~F.is_variant_null(e["v"]))
    none = F.filter(F.array(entry(F.lit(""), F.lit(""), F.lit(""), F.lit(0), F.col("v"), True)), lambda e: F.lit(False))
    return F.when(F.col("fresh") & (F.col("kind") == kind), F.coalesce(kept, none)).otherwise(none)


def scalar_rows(reports: DataFrame, row: str = "row_id", column: str = "report", paths: tuple[str, ...] = SCALAR_PATHS) -> DataFrame:
    """row_id and the dotted path of each named field that is present and not null."""
    entries = []
    for p in paths:
        value = _below(F.col("v"), p.replace(".", _SEP), True)
        entries.append(F.when(value.isNotNull() & ~F.is_variant_null(value), F.lit(p)))
    return parsed_reports(reports, row, column).select("row_id", F.explode(F.array_compact(F.array(*entries))).alias("node"))


def schema_kinds(schema: list[tuple[str, str, str]]) -> list[str]:
    """Every kind that rows may have under the merged schema: '' (the runs), then those of its arrays."""
    return sorted({"", *(f"{k}{_SEP * bool(k and path)}{path}[]" for k, path, shape in schema if shape == "array")})


def _typed(kind: str, schema: list[tuple[str, str, str]]) -> list[Column]:
    """A column a scalar path of the kind, as :func:`flat_table` says."""
    shapes: dict[str, set[str]] = {}
    for k, path, shape in schema:
        if k == kind and shape != "array":
            shapes.setdefault(path, set()).add(shape)
    types, taken, cols = {"number": "double", "bool": "boolean"}, {"node_key", "parent_key", "row_id", "ordinal"}, []
    for path, found in sorted(shapes.items()):
        name, n = path.replace(_SEP, "_"), 2
        while name.lower() in taken:
            name, n = f"{path.replace(_SEP, '_')}_{n}", n + 1
        taken.add(name.lower())
        kind_of = types.get(next(iter(found)), "string") if len(found) == 1 else "string"
        cols.append(_below(F.col("v"), path, kind == "").try_cast(kind_of).alias(name))
    return cols


def surrogate_key(row: Column, node: Column) -> Column:
    """Key of a nested object: the first 60 bits of the MD5 of its row and node, which any engine can make."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", row.cast("string"), node).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _links() -> list[Column]:
    key = lambda c: surrogate_key(F.col("row_id"), F.col(c))
    return [key("node").alias("node_key"), F.when(F.col("kind") != "", key("parent")).alias("parent_key"), F.col("row_id"), F.col("ordinal")]


def flat_table(nodes: DataFrame, kind: str, schema: list[tuple[str, str, str]]) -> DataFrame:
    """The flat table of one kind of nested object, with typed columns from the merged schema.

    Columns: node_key and parent_key (surrogate keys), row_id, ordinal, then one column a scalar path
    of the kind, DOUBLE or BOOLEAN where all values agree, else STRING. A path whose name clashes
    with another column, also by case only, gets a number appended. Kind '' is the table of the runs,
    to whose keys the objects below no other object refer; it needs nodes with their roots.
    """
    return nodes.where(F.col("kind") == kind).select(*_links(), *_typed(kind, schema))


def flat_rows(nodes: DataFrame, schema: list[tuple[str, str, str]]) -> DataFrame:
    """The rows of all flat tables in one: kind, the links, and the typed columns of the kind as JSON.

    Whatever kinds the data brings are in it, in one pass.
    """
    held = [F.when(F.col("kind") == k, F.to_json(F.struct(*cols)) if (cols := _typed(k, schema)) else F.lit("{}")) for k in schema_kinds(schema)]
    return nodes.select(F.translate("kind", _SEP, ".").alias("kind"), *_links(), F.coalesce(*held).alias("fields"))
