"""Further operators on turns, words, frames and evidence rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.blocked import scanned
from chronoloom.operators.intervals import interval_join, points_inside
from chronoloom.operators.periods import HOUR_US


def change_points(turns: DataFrame, keys: list[str], label: str = "label", scope: DataFrame | None = None, width: int = HOUR_US) -> DataFrame:
    """Starts where the label was not active before: (keys, at_us, label), inside *scope* if one is given.

    Before a point are the turns that began earlier. Those that reach it are active; a start is a
    change if none of them has its label. Where none reaches it, the labels that ended last count.
    A first start is no change. Two running maxima of the ends decide: of all labels and of the own.
    """
    own = turns.where("start_us IS NOT NULL").groupBy(*keys, label, "start_us").agg(F.max("end_us").alias("_e"))
    own = scanned(own, [*keys, label], "start_us", [], width, top_before={"_own": F.col("_e")})
    whole = turns.where("start_us IS NOT NULL").groupBy(*keys, "start_us").agg(F.max("end_us").alias("_e"))
    whole = scanned(whole, keys, "start_us", [], width, top_before={"_all": F.col("_e")}).where("_all IS NOT NULL").drop("_e")
    t = own.join(whole, [*keys, "start_us"]).withColumn("_own", F.coalesce("_own", F.lit(-(1 << 62))))
    changed = F.when(F.col("_all") >= F.col("start_us"), F.col("_own") < F.col("start_us")).otherwise(F.col("_own") < F.col("_all"))
    found = t.where(changed).select(*keys, F.col("start_us").alias("at_us"), label)
    return found if scope is None else points_inside(found, scope, keys, "at_us")


def as_of_next(points: DataFrame, turns: DataFrame, keys: list[str], at: str, width: int = HOUR_US) -> DataFrame:
    """For each point the first turn that ends after it: next_row, next_label (null: none).

    Points and ends are sorted together once; the next end is the first that follows. Ties of ends
    go to the smaller row.
    """
    p = points.select(*keys, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.struct(*points.columns).alias("_p"), F.lit(None).cast("struct<r:bigint,l:string>").alias("_q"))
    q = turns.select(*keys, F.col("end_us").alias("_t"), F.lit(-1).alias("_side"), F.lit(None).cast(p.schema["_p"].dataType).alias("_p"), F.struct(F.col("row_id").alias("r"), F.col("label").alias("l")).alias("_q"))
    # an end at the point itself is not after it, so ends sort before points of the same time
    found = scanned(p.unionByName(q), keys, "_t", ["_side", "_q"], width, after={"_n": F.col("_q")}).where("_side = 0")
    return found.select("_p.*", F.col("_n.r").alias("next_row"), F.col("_n.l").alias("next_label"))


def runs_of(rows: DataFrame, keys: list[str], label: str, wanted: str, width: int = HOUR_US) -> DataFrame:
    """Consecutive rows of one label: keys, start_us, end_us, n, total_us."""
    near = scanned(rows, keys, "start_us", ["row_id"], width, lag={"_l": F.col(label)})
    marked = scanned(near.withColumn("_f", F.when(F.col("_l") == F.col(label), 0).otherwise(1)), keys, "start_us", ["row_id"], width, total={"_r": F.col("_f")})
    return marked.where(F.col(label) == wanted).groupBy(*keys, "_r").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n"), F.sum(F.col("end_us") - F.col("start_us")).alias("total_us")).drop("_r")


def transcript_turns(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Turns of texts whose lines read ``[hh:mm:ss] label: words``.

    A turn ends where the next one of its text starts (null at the last); labels are numbered by
    first appearance in the text. Other lines are left out.
    """
    lines = documents.select(F.col(doc).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    pattern = r"^\[(\d{2}):(\d{2}):(\d{2})\] ([^:]+): (.*)$"
    part = lambda k: F.regexp_extract("line", pattern, k)
    t = lines.where(F.col("line").rlike(pattern)).select("doc_id", "line_no", ((part(1).cast("int") * 60 + part(2).cast("int")) * 60 + part(3).cast("int")).alias("start_s"), part(4).alias("label"), F.length(part(5)).alias("n_chars"))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    first = F.min("line_no").over(Window.partitionBy("doc_id", "label"))
    named = t.withColumn("end_s", F.lead("start_s").over(w)).withColumn("_f", first)
    return named.withColumn("speaker_no", F.dense_rank().over(Window.partitionBy("doc_id").orderBy("_f"))).drop("_f")


def flexible_us(text: Column, name: str) -> Column:
    """A time of a JSON object as microseconds: ``<name>_us``, ``<name>_sec``, or bare ``<name>``.

    A bare value is seconds if it has a fraction or is below 100000, else microseconds.
    """
    us = F.get_json_object(text, f"$.{name}_us").try_cast("bigint")
    sec = F.get_json_object(text, f"$.{name}_sec").try_cast("decimal(24,9)")
    bare = F.get_json_object(text, f"$.{name}")
    number = bare.try_cast("decimal(24,9)")
    as_us = lambda s: F.bround(s * F.lit(1_000_000).cast("decimal(8,0)")).cast("bigint")
    return F.coalesce(us, as_us(sec), F.when(bare.contains(".") | (F.abs(number) < 100_000), as_us(number)).otherwise(number.cast("bigint")))


def window_features(samples: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Per window of *size* samples: root mean square, zero-crossing rate, mean absolute step."""
    s = samples.withColumn("window", F.floor(F.col("k") / size))
    s = s.withColumn("_p", F.lag("x").over(Window.partitionBy(*keys, "window").orderBy("k")))
    crossed = F.when(F.col("x") * F.col("_p") < 0, 1).otherwise(0)
    step = F.abs(F.col("x") - F.col("_p"))
    return s.groupBy(*keys, "window").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 9).alias("rms"), F.round(F.sum(crossed) / F.count("*"), 9).alias("zcr"), F.round(F.coalesce(F.avg(step), F.lit(0.0)), 9).alias("step"))


def overlap_added(frames: DataFrame, keys: list[str], value: str, size: int, shift: int) -> DataFrame:
    """Hamming-weighted mean over the sliding windows a frame is in; a window's scores are its frames' *value* plus its number modulo two."""
    k = F.floor(F.col("start_us") / 32_000)
    first = F.greatest(F.lit(0), F.ceil((k - size + 1) / shift))
    wins = frames.withColumn("_k", k).withColumn("_w", F.explode(F.sequence(first, F.floor(k / shift))))
    place = F.col("_k") - F.col("_w") * shift
    weight = F.lit(0.54) - F.lit(0.46) * F.cos(F.lit(6.283185307179586) * place / (size - 1))
    scored = F.col(value) + F.col("_w") % 2
    return wins.groupBy(*keys, "start_us").agg(F.round(F.sum(weight * scored) / F.sum(weight), 6).alias("mean"), F.count("*").alias("n_windows"))


def scheduled(rows: DataFrame, keys: list[str], row: str = "row_id", width: int = HOUR_US) -> DataFrame:
    """A largest set of rows that do not overlap: earliest end first, ties by row.

    Rows of different islands of overlap cannot conflict, so each island is scheduled on its own; an
    island is named by the start of its first row.
    """
    base = rows.select(*keys, "start_us", "end_us", F.col(row).alias("row_id"))
    island = scanned(base, keys, "start_us", ["end_us", "row_id"], width, top_before={"_m": F.col("end_us")})
    begins = F.when(F.coalesce(F.col("start_us") < F.col("_m"), F.lit(False)), F.lit(None)).otherwise(F.struct("start_us", "end_us", "row_id"))
    island = scanned(island.withColumn("_s", begins).drop("_m"), keys, "start_us", ["end_us", "row_id"], width, top={"_i": F.col("_s")})

    @F.pandas_udf("array<bigint>")
    def chosen(lists: pd.Series) -> pd.Series:
        def one(rows):  # noqa: ANN001, ANN202
            kept, free = [], None
            for x in rows:
                if free is None or x["s"] >= free:
                    kept.append(x["r"])
                    free = x["e"]
            return kept

        return lists.map(one)

    listed = island.groupBy(*keys, "_i").agg(F.sort_array(F.collect_list(F.struct(F.col("end_us").alias("e"), F.col("row_id").cast("bigint").alias("r"), F.col("start_us").alias("s")))).alias("rows"))
    return listed.select(F.explode(F.when(F.size("rows") == 1, F.array(F.col("rows")[0]["r"])).otherwise(chosen("rows"))).alias("row_id"))


def word_issues(words: DataFrame, scope: DataFrame, keys: list[str], row: str = "word_id") -> DataFrame:
    """Rule codes of faulty words: DUPLICATE_ID, TIME_ORDER, OUTSIDE_SCOPE (in no scope at all)."""
    copies = Window.partitionBy(*keys, row)
    touched = interval_join(words.where("end_us > start_us").select(*keys, row, "start_us", "end_us"), scope, keys).select(*keys, row).distinct().withColumn("_in", F.lit(True))
    flagged = words.withColumn("_n", F.count("*").over(copies)).join(touched, [*keys, row], "left")
    codes = F.array_compact(F.array(F.when(F.col("_n") > 1, F.lit("DUPLICATE_ID")), F.when(F.col("end_us") <= F.col("start_us"), F.lit("TIME_ORDER")), F.when(F.col("_in").isNull(), F.lit("OUTSIDE_SCOPE"))))
    return flagged.select(*keys, row, F.explode(codes).alias("issue"))


def tree_digest(rows: DataFrame, keys: list[str], line: Column) -> DataFrame:
    """A digest of each key's rows that does not depend on their order.

    Rows are hashed, hashes digested in order within each three-digit prefix, and the prefixes'
    digests digested again, so a large key is 4096 small groups first.
    """
    h = rows.select(*keys, F.sha2(line, 256).alias("_h")).withColumn("_p", F.substring("_h", 1, 3))
    leaf = h.groupBy(*keys, "_p").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), ""), 256).alias("_d"), F.count("*").alias("_n"))
    return leaf.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_d"))), lambda x: x["_d"]), ""), 256).alias("digest"), F.sum("_n").alias("n_rows"))
