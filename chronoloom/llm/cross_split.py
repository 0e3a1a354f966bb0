"""Same or related records across splits: sharded automata over the holdout rows' normalised keys."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.ids import plain_form
from chronoloom.session import cut, drop

TRAIN = "calibration"
HOLDOUTS = ("developmentholdout", "releaseholdout")
#: Passages of an automaton on average, and characters of a passage's end that choose its shard.
SHARD_ROWS, ENDING = 50_000, 6
#: Training rows of a passage that one task pairs, and parts of the rows of one text.
SALT_ROWS, TEXT_SALTS = 10_000, 8
_MARK = "\u0001"


def originals(rows: DataFrame, recording: str = "recording_id", source: str = "source_recording_id") -> DataFrame:
    """(rec, original) of every listed recording, in plain form.

    Pointers to the source are doubled until none changes: a chain of any length takes the logarithm
    of it in rounds. A recording listed with different sources follows the smallest. Recordings that
    name each other in a circle have the smallest of the circle as original.
    """
    rec, src = plain_form(F.col(recording)), plain_form(F.col(source))
    listed = rows.select(rec.alias("rec"), src.alias("src")).where("rec IS NOT NULL").groupBy("rec").agg(F.min("src").alias("src"))
    stop = F.coalesce(F.col("src") == F.col("rec"), F.lit(True))
    now = cut(listed.select("rec", F.coalesce("src", "rec").alias("ptr"), F.col("rec").alias("low"), stop.alias("stop")), "pointers")
    for _ in range(max(1, now.count()).bit_length() + 1):
        far = now.select(F.col("rec").alias("ptr"), F.col("ptr").alias("_p"), F.col("low").alias("_l"))
        moved = cut(now.join(far, "ptr", "left").select("rec", F.coalesce("_p", "ptr").alias("ptr"), F.least("low", "_l").alias("low"), "stop", (F.col("_p") != F.col("ptr")).alias("moved")), "pointers")
        drop(now)
        now = moved
        if not moved.where("moved").limit(1).count():
            break
    # a pointer that ends at a listed recording which has another source is inside a circle
    ends = now.select(F.col("rec").alias("ptr"), "stop", F.col("low").alias("_l"))
    return now.select("rec", "ptr").join(ends, "ptr", "left").select("rec", F.when(F.col("stop") | F.col("stop").isNull(), F.col("ptr")).otherwise(F.col("_l")).alias("original"))


def keyed_rows(rows: DataFrame, row: str = "row_id") -> DataFrame:
    """row_id, side (train or the holdout's name), original and the normalised keys of each row."""
    named = rows.select(F.col(row).cast("bigint").alias("row_id"), plain_form(F.col("split")).alias("side"), plain_form(F.col("recording_id")).alias("rec"), plain_form(F.col("source_recording_id")).alias("src"), plain_form(F.col("session_id")).alias("s"), plain_form(F.col("augmentation_group")).alias("g"))
    named = named.where(F.col("side").isin(TRAIN, *HOLDOUTS))
    known = named.join(originals(rows), "rec", "left")
    # a row without a recording of its own still names its source
    o = F.coalesce("original", "rec", "src")
    key = lambda kind, c: F.when(c.isNotNull(), F.concat(F.lit(_MARK + kind + ":"), c, F.lit(_MARK)))
    return known.select("row_id", "side", o.alias("original"), key("s", F.col("s")).alias("ks"), key("g", F.col("g")).alias("kg"), key("o", o).alias("ko"))


def _keys() -> Column:
    return F.array_compact(F.array("ks", "kg", "ko"))


def _scan(t: pa.Table) -> pa.Table:
    """One shard: an automaton over its passages scans every training text that may hold one of them."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    is_passage = t.column("passage")
    passages = t.filter(is_passage).column("text").to_pylist()
    for p in passages:
        automaton.add_word(p, p)
    hits: list[tuple] = []
    if passages:
        automaton.make_automaton()
        scanned = t.filter(pc.invert(is_passage))
        for text, n in zip(scanned.column("text").to_pylist(), scanned.column("n_rows").to_pylist(), strict=True):
            hits += [(text, p, last + 1 - len(p), n) for last, p in automaton.iter(text)]
    kinds = (("text", pa.string()), ("passage", pa.string()), ("at", pa.int64()), ("n_rows", pa.int64()))
    return pa.table({name: pa.array([h[k] for h in hits], kind) for k, (name, kind) in enumerate(kinds)})


def matched_intervals(keyed: DataFrame) -> DataFrame:
    """Where the passages of the holdout rows stand in the training texts: text, passage, at, n_rows (of the text).

    Passages are the distinct normalised keys of the holdout rows, each between marks that stand in no
    key, so a match is a whole key. A training text is all keys of a row end to end; rows with the same
    text are one. Passages are sharded by their last characters, and a text goes to every shard that
    may hold a passage of it, that of the end of each of its keys: at most three, whatever their
    number, and an automaton a shard scans all of it. Only the passages are exact; that ends agree says
    nothing yet.
    """
    passages = keyed.where(F.col("side") != TRAIN).select(F.explode(_keys()).alias("text")).distinct()
    texts = keyed.where(F.col("side") == TRAIN).select(F.concat_ws("", "ks", "kg", "ko").alias("text"), _keys().alias("_keys")).where("text <> ''").groupBy("text").agg(F.first("_keys").alias("_keys"), F.count("*").alias("n_rows"))
    total, spark = passages.count(), keyed.sparkSession
    shards = max(1, -(-total // SHARD_ROWS), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    shard = lambda c: F.pmod(F.xxhash64(F.right(c, F.lit(ENDING))), F.lit(shards))
    held = passages.select(shard(F.col("text")).alias("shard"), F.lit(True).alias("passage"), "text", F.lit(0).cast("bigint").alias("n_rows"))
    seen = texts.select(F.explode(F.array_distinct(F.transform("_keys", shard))).alias("shard"), F.lit(False).alias("passage"), "text", "n_rows")
    # a shard without passages is scanned for nothing
    return held.unionByName(seen).groupBy("shard").applyInArrow(_scan, "text STRING, passage STRING, at BIGINT, n_rows BIGINT").distinct()


def cross_split_pairs(rows: DataFrame, row: str = "row_id") -> DataFrame:
    """Every pair of a training and a holdout row that are one recording or bound to it.

    Returns train_row, eval_row, side (the holdout), original (of the holdout row), once a pair.

    Method: Aho-Corasick automata over the sharded normalised keys of the holdout rows (session,
    augmentation group and original recording) scan the training rows' texts; rows of a text and of a
    passage it holds are paired. A pair bound by several keys is given by the first of them, so pairs
    need not be compared with each other. Passages in very many texts are salted on the training side,
    so one key is joined by many tasks.

    Defined cases: ids and split names are compared in plain form; null and blank ones match nothing,
    and rows of other splits are left out; repeated rows pair each; no rows give no pairs. The rows are
    all pairs, since that is what is asked for; :func:`row_links` counts them without making any.
    """
    keyed = cut(keyed_rows(rows, row), "keyed")
    return _paired(keyed, matched_intervals(keyed))


def _paired(keyed: DataFrame, found: DataFrame) -> DataFrame:
    kinds = ("ks", "kg", "ko")
    found = cut(found, "matches")
    hot = found.groupBy("passage").agg(F.sum("n_rows").alias("n")).select(F.col("passage").alias("key"), (F.floor(F.col("n") / SALT_ROWS) + 1).cast("int").alias("_salts"))
    train = keyed.where(F.col("side") == TRAIN).select(F.col("row_id").alias("train_row"), *[F.col(k).alias(f"t_{k}") for k in kinds], F.concat_ws("", *kinds).alias("text"))
    # a text may be that of very many rows
    part = F.explode(F.array(*[F.lit(x).cast("bigint") for x in range(TEXT_SALTS)]))
    train = train.withColumn("_part", F.pmod(F.xxhash64("train_row"), F.lit(TEXT_SALTS))).join(found.select("text", F.col("passage").alias("key"), part.alias("_part")), ["text", "_part"]).drop("_part", "text")
    train = train.join(hot, "key").withColumn("_salt", F.pmod(F.xxhash64("train_row"), F.col("_salts")).cast("int"))
    held = keyed.where(F.col("side") != TRAIN).select(F.col("row_id").alias("eval_row"), "side", "original", *[F.col(k).alias(f"e_{k}") for k in kinds], F.explode(_keys()).alias("key"))
    held = held.join(hot, "key").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    same = [F.coalesce(F.col(f"t_{k}") == F.col(f"e_{k}"), F.lit(False)) for k in kinds]
    first = F.when(same[0], F.col("e_ks")).when(same[1], F.col("e_kg")).when(same[2], F.col("e_ko"))
    return train.join(held, ["key", "_salt"]).where(first == F.col("key")).select("train_row", "eval_row", "side", "original")


def row_links(rows: DataFrame, row: str = "row_id") -> DataFrame:
    """Each row of the training and holdout splits with its class and how many rows of the other side it is
    bound to: row_id, side, class (its original, else its first key; '' without any), n_links.

    No pair is made: the rows on the other side with a key are counted key by key, those with two keys
    in common taken off and those with three added again.
    """
    keyed = cut(keyed_rows(rows, row), "keyed").withColumn("_train", F.col("side") == TRAIN)
    sets = [("ks",), ("kg",), ("ko",), ("ks", "kg"), ("ks", "ko"), ("kg", "ko"), ("ks", "kg", "ko")]
    joint = lambda ks: F.when(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in ks)), F.concat_ws("", *ks))
    entries = F.array_compact(F.array(*[F.when(joint(ks).isNotNull(), F.struct(F.lit(1 if len(ks) % 2 else -1).alias("sign"), F.concat(F.lit("".join(ks)), joint(ks)).alias("key"))) for ks in sets]))
    long = keyed.select("row_id", "_train", F.explode(entries).alias("e")).select("row_id", "_train", "e.*")
    counts = long.groupBy("key").agg(F.count(F.when(F.col("_train"), 1)).alias("n_train"), F.count(F.when(~F.col("_train"), 1)).alias("n_eval"))
    linked = long.join(counts, "key").groupBy("row_id").agg(F.sum(F.col("sign") * F.when(F.col("_train"), F.col("n_eval")).otherwise(F.col("n_train"))).alias("n_links"))
    return keyed.join(linked, "row_id", "left").select("row_id", "side", F.coalesce("original", F.expr("substring(coalesce(ks, kg, ''), 4, length(coalesce(ks, kg, '')) - 4)")).alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def coverage(rows: DataFrame, row: str = "row_id") -> DataFrame:
    """Per holdout row, how much of its normalised text the training texts cover.

    The text of a row is its keys end to end, without marks. Each passage found by the automata is an
    interval of it; overlapping and touching intervals are merged and their length counted. Returns
    row_id, side, n_keys, n_matched, covered (rounded to 9 places).
    """
    keyed = cut(keyed_rows(rows, row), "keyed")
    hits = matched_intervals(keyed).select(F.col("passage").alias("key")).distinct().withColumn("hit", F.lit(True))
    text = keyed.where(F.col("side") != TRAIN).select("row_id", "side", F.transform(_keys(), lambda k: F.struct(k.alias("key"), (F.length(k) - 2).alias("n"))).alias("_ks"))
    # each key with the place where it begins in the text
    upto = F.transform("_ks", lambda x, i: F.aggregate(F.slice("_ks", F.lit(1), i), F.lit(0), lambda s, y: s + y["n"]))
    long = text.withColumn("_at", upto).select("row_id", "side", F.explode_outer(F.arrays_zip("_ks", "_at")).alias("e")).select("row_id", "side", F.col("e._ks.key").alias("key"), F.col("e._ks.n").alias("n"), F.col("e._at").alias("at"))
    spans = F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct(F.col("at").alias("a"), (F.col("at") + F.col("n")).alias("z")))))
    seed = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("reach"))
    merged = F.aggregate(spans, seed, lambda s, x: F.struct((s["sum"] + F.greatest(F.lit(0), x["z"] - F.greatest(s["reach"], x["a"]))).alias("sum"), F.greatest(s["reach"], x["z"]).alias("reach")), lambda s: s["sum"])
    sums = long.join(hits, "key", "left").groupBy("row_id", "side").agg(F.count("key").alias("n_keys"), F.count("hit").alias("n_matched"), merged.alias("_m"), F.sum("n").alias("_n"))
    return sums.select("row_id", "side", "n_keys", "n_matched", F.round(F.coalesce(F.try_divide("_m", "_n"), F.lit(0.0)), 9).alias("covered"))


def overlap_report(pairs: DataFrame) -> DataFrame:
    """Pairs and rows on either side, per holdout split and source."""
    return pairs.groupBy("side", F.coalesce("original", F.lit("")).alias("source")).agg(F.count("*").alias("n_pairs"), F.countDistinct("eval_row").alias("n_eval"), F.countDistinct("train_row").alias("n_train"))
