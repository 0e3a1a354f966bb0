"""Ordered scans over groups of any size.

A window over a hot group runs in one task. The operators of this package that need an order split
every group into blocks of its order axis instead: rows are hashed by (group, block), scanned
inside the block, and a one-row summary a block carries the state across. Only the summaries of a
group meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = "_blk"


def null_safe_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Add non-null twins of *keys* that group and join as the keys do, null being a value of its own.

    A join on ``<=>`` would be hashed by other expressions than the windows are, and shuffle again.
    """
    out, mask = [], F.lit(0)
    for k, name in enumerate(keys):
        kind = df.schema[name].dataType
        other = F.lit("") if isinstance(kind, T.StringType) else F.lit(0).cast(kind)
        df = df.withColumn(f"_k{k}", F.coalesce(F.col(name), other))
        mask = mask + F.when(F.col(name).isNull(), F.lit(1 << k)).otherwise(F.lit(0))
        out.append(f"_k{k}")
    return df.withColumn("_kn", mask), [*out, "_kn"]


def restored(keys: list[str]) -> list[Column]:
    """The keys again from their twins, so that only one of both need be shuffled."""
    return [F.when(F.col("_kn").bitwiseAND(1 << k) == 0, F.col(f"_k{k}")).alias(name) for k, name in enumerate(keys)]


def block_of(axis: Column, width: float) -> Column:
    """Block number on an integer axis; floor, so that negative places have blocks too."""
    return F.coalesce(F.floor(axis / F.lit(width)).cast("bigint"), F.lit(-(1 << 62)))


def inside(keys: list[str], *order: Column | str) -> WindowSpec:
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def across(keys: list[str]) -> WindowSpec:
    """The order of a group's block summaries."""
    return Window.partitionBy(*keys).orderBy(BLOCK)


def before(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, -1)


def upto(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, 0)


def counted_rank(df: DataFrame, keys: list[str], axis: str, order: list[Column], width: float, name: str = "rank") -> DataFrame:
    """Adds *name*, the row number (from 1) within the keys in ascending *axis*, then *order*.

    A group is numbered block by block of *axis* // *width*; what earlier blocks hold is carried.
    """
    df, ks = null_safe_keys(df.withColumn(BLOCK, block_of(F.col(axis), width)), keys)
    blocks = df.groupBy(*ks, BLOCK).agg(F.count("*").alias("_n"))
    carry = blocks.select(*ks, BLOCK, F.coalesce(F.sum("_n").over(before(across(ks))), F.lit(0)).alias("_c"), F.sum("_n").over(Window.partitionBy(*ks)).alias("_size"))
    local = df.withColumn("_r", F.row_number().over(inside(ks, F.col(axis), *order)))
    return local.join(carry, [*ks, BLOCK]).withColumn(name, F.col("_r") + F.col("_c")).drop(*ks, BLOCK, "_r", "_c")


def counted_width(df: DataFrame, keys: list[str], axis: Column, width: float, most: int = 1_000_000) -> float:
    """A block width for *df*: *width*, or less where its densest block has more than *most* rows.

    One aggregate, combined before the shuffle; a single number reaches the driver. Blocks then follow
    the density of the data, whatever its scale.
    """
    top = df.select(*keys, block_of(axis, width).alias(BLOCK)).groupBy(*keys, BLOCK).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] or 0
    narrow = width / -(-top // most) if top > most else width
    return narrow if isinstance(width, float) else max(1, int(narrow))


def scanned(
    df: DataFrame, keys: list[str], axis: str, order: list[str], width: float, *,
    lag: dict[str, Column] | None = None, lead: dict[str, Column] | None = None, total: dict[str, Column] | None = None,
    top: dict[str, Column] | None = None, top_before: dict[str, Column] | None = None, last: dict[str, Column] | None = None, after: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds values of an ordered scan over each group, of any size, in ascending *axis*, then *order*.

    ``lag`` and ``lead`` hold the expression at the row before and after; ``total`` its running sum and
    ``top`` its running maximum, the row included; ``top_before`` the maximum of the rows before;
    ``last`` and ``after`` the nearest value that is not null among the rows before and after.

    Rows are hashed by group and block of *width* on the axis and scanned there; one row a block carries
    what other blocks add, so a group with a third of all rows is as many tasks as it has blocks. Null
    keys form a group of their own.
    """
    asked = [(kind, name, e) for kind, given in (("lag", lag), ("lead", lead), ("total", total), ("top", top), ("top_before", top_before), ("last", last), ("after", after)) for name, e in (given or {}).items()]
    source = df.columns
    df, ks = null_safe_keys(df.withColumn(BLOCK, block_of(F.col(axis), width)), keys)
    df = df.select("*", *[e.alias(f"_sc_x{k}") for k, (_, _, e) in enumerate(asked)])
    w = inside(ks, axis, *order)
    place = F.struct(axis, *order)
    a, back, ahead = across(ks), before(across(ks)), across(ks).rowsBetween(1, Window.unboundedFollowing)
    local, sums, carry = [F.row_number().over(w).alias("_sc_rn")], [F.count("*").alias("_sc_size")], []
    for k, (kind, _, _) in enumerate(asked):
        x = F.col(f"_sc_x{k}")
        held = F.when(x.isNotNull(), place)
        here, whole, carried = {
            "lag": lambda: (F.lag(x).over(w), F.max_by(x, place), F.lag(f"_sc_b{k}").over(a)),
            "lead": lambda: (F.lead(x).over(w), F.min_by(x, place), F.lead(f"_sc_b{k}").over(a)),
            "total": lambda: (F.sum(x).over(upto(w)), F.sum(x), F.sum(f"_sc_b{k}").over(back)),
            "top": lambda: (F.max(x).over(upto(w)), F.max(x), F.max(f"_sc_b{k}").over(back)),
            "top_before": lambda: (F.max(x).over(before(w)), F.max(x), F.max(f"_sc_b{k}").over(back)),
            "last": lambda: (F.last(x, True).over(before(w)), F.max_by(x, held), F.last(f"_sc_b{k}", True).over(back)),
            "after": lambda: (F.first(x, True).over(w.rowsBetween(1, Window.unboundedFollowing)), F.min_by(x, held), F.first(f"_sc_b{k}", True).over(ahead)),
        }[kind]()
        local.append(here.alias(f"_sc_l{k}"))
        sums.append(whole.alias(f"_sc_b{k}"))
        carry.append(carried.alias(f"_sc_c{k}"))
    blocks = df.groupBy(*ks, BLOCK).agg(*sums).select(*ks, BLOCK, "_sc_size", *carry)
    joined = df.select("*", *local).join(blocks, [*ks, BLOCK])
    out = []
    for k, (kind, name, _) in enumerate(asked):
        here, carried = F.col(f"_sc_l{k}"), F.col(f"_sc_c{k}")
        out.append({
            "lag": lambda: F.when(F.col("_sc_rn") == 1, carried).otherwise(here),
            "lead": lambda: F.when(F.col("_sc_rn") == F.col("_sc_size"), carried).otherwise(here),
            "total": lambda: F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0)),
            "top": lambda: F.greatest(here, carried), "top_before": lambda: F.greatest(here, carried),
            "last": lambda: F.coalesce(here, carried), "after": lambda: F.coalesce(here, carried),
        }[kind]().alias(name))
    return joined.select(*source, *out)


def with_halo(df: DataFrame, keys: list[str], axis: str, order: list[str], width: float, behind: int, ahead: int, rows: int = 100_000) -> tuple[DataFrame, WindowSpec]:
    """Rows with copies of their *behind* and *ahead* neighbours in each block, and the window over a block.

    Rows are numbered within their group and cut into blocks of *rows*; those near an edge are copied
    into the neighbouring block, where ``_own`` is false. Windows of fixed reach are then exact inside
    blocks; keep the rows with ``_own`` afterwards and drop ``_own``, ``_blk`` and ``_at``.
    """
    if max(behind, ahead) >= rows:
        raise ValueError("a window must reach less than a block")
    placed = scanned(df.withColumn("_1", F.lit(1).cast("bigint")), keys, axis, order, width, total={"_at": F.col("_1")}).drop("_1").withColumn("_at", F.col("_at") - 1)
    own = F.floor(F.col("_at") / rows)
    near = F.filter(F.array(own, F.when(F.pmod("_at", F.lit(rows)) < ahead, own - 1), F.when(F.pmod("_at", F.lit(rows)) >= rows - behind, own + 1)), lambda b: b.isNotNull() & (b >= 0))
    spread = placed.select("*", own.alias("_home"), F.explode(near).alias(BLOCK)).withColumn("_own", F.col("_home") == F.col(BLOCK)).drop("_home")
    return spread, inside(keys, "_at")
