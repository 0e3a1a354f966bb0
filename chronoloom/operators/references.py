"""References to records that do not exist at the time they are made."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.ids import plain_form
from chronoloom.operators.blocked import BLOCK, across, before, block_of, counted_width, inside, upto
from chronoloom.session import cut

DAY_US = 86_400_000_000


@dataclass(frozen=True)
class Reference:
    """Child rows that name a key of a parent table, each at a time.

    A parent row is valid from ``valid_from`` until before ``valid_to`` (null: for ever).
    """

    child: DataFrame
    child_table: str
    child_row: str
    child_key: str
    child_time: str
    parent: DataFrame
    parent_table: str
    parent_key: str
    valid_from: str
    valid_to: str


def tagged_keys(references: list[Reference]) -> DataFrame:
    """Parent and child keys of all references in one long form.

    Columns: parent_table, key, at_us, turn (0 parent event, 1 child), step (+1 a parent row becomes
    valid, -1 it ceases to be, 0 a child), src_table, row_id.
    """
    parts = []
    for r in references:
        since, until = F.unix_micros(F.col(r.valid_from).cast("timestamp")), F.unix_micros(F.col(r.valid_to).cast("timestamp"))
        parent = (
            r.parent.select(plain_form(F.col(r.parent_key)).alias("key"), since.alias("since"), until.alias("until"))
            .where("key IS NOT NULL AND since IS NOT NULL AND (until IS NULL OR until > since)")
            .select("key", F.explode(F.array(F.struct(F.col("since").alias("at_us"), F.lit(1).alias("step")), F.struct(F.col("until").alias("at_us"), F.lit(-1).alias("step")))).alias("e"))
            .where("e.at_us IS NOT NULL")
            .groupBy("key", "e.at_us")
            .agg(F.sum("e.step").alias("step"))
            .select(F.lit(r.parent_table).alias("parent_table"), "key", "at_us", F.lit(0).alias("turn"), "step", F.lit(None).cast("string").alias("src_table"), F.lit(None).cast("bigint").alias("row_id"))
        )
        child = r.child.select(
            F.lit(r.parent_table).alias("parent_table"), plain_form(F.col(r.child_key)).alias("key"), F.unix_micros(F.col(r.child_time).cast("timestamp")).alias("at_us"),
            F.lit(1).alias("turn"), F.lit(0).cast("bigint").alias("step"), F.lit(r.child_table).alias("src_table"), F.col(r.child_row).cast("bigint").alias("row_id"),
        ).where("key IS NOT NULL")
        parts += [parent, child]
    return reduce(DataFrame.unionByName, parts)


def orphan_references(references: list[Reference]) -> DataFrame:
    """Every child row that refers to something, but to no parent row valid at its time.

    Method: parent and child keys are united in long form, tagged, and grouped by parent table and
    key; the parent flag of a group is the number of its parent rows that are valid at the place of
    a child in time, and children where it is 0 stay. A group is split into days, or into
    shorter blocks where a day is dense, so a key that holds a third of all rows is scanned by many
    tasks; the blocks' sums alone meet in one.

    Returns parent_table, key, src_table, row_id, at_us.

    Defined cases: a null key or one without letters and digits refers to nothing and is no orphan;
    a child without a time has no valid target and is an orphan; a parent without ``valid_from`` or
    with ``valid_to`` not after it is never valid; repeated child rows are reported one by one;
    empty tables give no rows, or all children where the parent table is empty; further columns are
    never read.
    """
    keys = ["parent_table", "key"]
    tagged = cut(tagged_keys(references), "keys")  # plain forms are dear, and the keys are read five times
    # a child without a time needs no order: it has no valid target
    timeless = tagged.where("at_us IS NULL AND turn = 1")
    rows = tagged.where("at_us IS NOT NULL")
    rows = rows.withColumn(BLOCK, block_of(F.col("at_us"), counted_width(rows, keys, F.col("at_us"), DAY_US)))
    local = rows.withColumn("_here", F.sum("step").over(upto(inside(keys, "at_us", "turn"))))
    days = rows.where("step <> 0").groupBy(*keys, BLOCK).agg(F.sum("step").alias("_step"))
    # a day without parent events still needs what earlier days carry into it
    asked = rows.where("turn = 1").groupBy(*keys, BLOCK).agg(F.lit(0).cast("bigint").alias("_step"))
    carry = (
        days.unionByName(asked).groupBy(*keys, BLOCK).agg(F.sum("_step").alias("_step"))
        .withColumn("_carry", F.coalesce(F.sum("_step").over(before(across(keys))), F.lit(0)))
        .select(*keys, BLOCK, "_carry")
    )
    children = local.where("turn = 1")
    names = ["parent_table", "key", "src_table", "row_id", "at_us"]
    return children.join(carry, [*keys, BLOCK]).where("_here + _carry <= 0").select(*names).unionByName(timeless.select(*names))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per referring table, parent table and month; null times count as ``unknown``."""
    month = F.coalesce(F.date_format(F.timestamp_micros("at_us"), "yyyy-MM"), F.lit("unknown"))
    return (
        orphans.groupBy("src_table", "parent_table", month.alias("period"))
        .agg(F.count("*").alias("orphan_rows"), F.countDistinct("key").alias("missing_keys"))
    )
