"""Labels for words and pieces of speech: attribution by overlap, local gates, emissions, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.intervals import interval_join, overlap_us

#: Ceilings on stable and effective distance and the least margin, by class of a piece.
ROLE_LIMITS = {"ANCHOR": (0.35, 0.40, 0.03), "SUPPORT": (0.35, 0.40, 0.03), "MICRO": (0.25, 0.30, 0.08)}
#: Cost of leaving a piece unknown, a micro piece unknown, and of a third speaker.
UNKNOWN_COST, UNKNOWN_MICRO_COST, OTHER_COST = 0.40, 0.02, 0.40


def mapped_words(words: DataFrame, spans: DataFrame, keys: list[str], row: str = "word_id", span: str = "row_id", crosses: str | None = None, speakers: tuple[str, str] = ("A", "B"), material: int = 20, dominant: int = 80, most_unknown: int = 20) -> DataFrame:
    """Each word with a speaker or why it has none: the words' columns, speaker, status, evidence.

    *spans* (keys, *span*, label, start_us, end_us) are what a system said. In this order: a word without
    a positive length, or that *crosses* a seam of the time warp, is UNKNOWN_TIMEWARP_BOUNDARY; one that
    any OVERLAP span touches is OVERLAP_UNATTRIBUTED; with *material* percent or more of both speakers it
    is UNKNOWN_BOUNDARY; a speaker of *dominant* percent or more is ASSIGNED unless more than
    *most_unknown* percent are UNKNOWN or NON_SPEECH (ties: the first speaker); without a speaker but
    with OTHER it is OTHER; all else is UNKNOWN_INSUFFICIENT_EVIDENCE. ``evidence`` lists the spans that
    touch the word. Shares are compared as integers, so they are exact.

    One join on time buckets and one aggregate by word, which carries the word's own columns along: no
    second join. Defined cases: null starts or ends are malformed; null labels are no evidence; words of
    one id and equal columns are one; no spans give UNKNOWN_INSUFFICIENT_EVIDENCE.
    """
    own = F.struct(*words.columns)
    bad = F.coalesce(F.col("end_us") <= F.col("start_us"), F.lit(True))
    held = words.select(*keys, row, "start_us", "end_us", own.alias("_w"), (bad if crosses is None else bad | F.coalesce(F.col(crosses), F.lit(False))).alias("_bad"))
    said = spans.where("label IS NOT NULL").select(*keys, F.col(span).alias("_span"), F.col("label").alias("_label"), "start_us", "end_us")
    touched = interval_join(held.where("end_us > start_us"), said, keys)
    common = overlap_us(F.col("start_us"), F.col("end_us"), F.col("other_start_us"), F.col("other_end_us"))
    nothing = held.select(*keys, row, "_w", "_bad", F.lit(None).cast(spans.schema[span].dataType).alias("_span"), F.lit(None).cast("string").alias("_label"), F.lit(0).cast("bigint").alias("_us"))
    long = touched.select(*keys, row, "_w", "_bad", "_span", "_label", common.cast("bigint").alias("_us")).unionByName(nothing)
    part = lambda *labels: F.sum(F.when(F.col("_label").isin(*labels), F.col("_us")).otherwise(0))
    found = long.groupBy(*keys, row, "_w", "_bad").agg(part(speakers[0]).alias("_c0"), part(speakers[1]).alias("_c1"), part("OVERLAP").alias("_over"), part("UNKNOWN", "NON_SPEECH").alias("_none"), part("OTHER").alias("_other"), F.array_sort(F.collect_set("_span")).alias("evidence"))
    size = (F.col("_w.end_us") - F.col("_w.start_us")) * 1
    c0, c1, none = F.col("_c0") * 100, F.col("_c1") * 100, F.col("_none") * 100
    best = F.greatest(c0, c1)
    status = (
        F.when(F.col("_bad"), "UNKNOWN_TIMEWARP_BOUNDARY").when(F.col("_over") > 0, "OVERLAP_UNATTRIBUTED")
        .when((c0 >= size * material) & (c1 >= size * material), "UNKNOWN_BOUNDARY")
        .when((best > 0) & (best >= size * dominant) & (none <= size * most_unknown), "ASSIGNED")
        .when((best == 0) & (F.col("_other") > 0), "OTHER").otherwise("UNKNOWN_INSUFFICIENT_EVIDENCE")
    )
    s = F.col("status")
    speaker = F.when(s == "ASSIGNED", F.when(F.col("_c0") >= F.col("_c1"), speakers[0]).otherwise(speakers[1])).when(s == "OVERLAP_UNATTRIBUTED", "OVERLAP").when(s == "OTHER", "OTHER").otherwise("UNKNOWN")
    return found.withColumn("status", status).select("_w.*", speaker.alias("speaker"), "status", "evidence")


def neutral_words(words: DataFrame) -> DataFrame:
    """Attributed words without any claim on a speaker: those that had one are SPEAKER_NEUTRAL."""
    claimed = ~F.col("speaker").isin("UNKNOWN", "OVERLAP", "NON_SPEECH")
    return words.withColumn("status", F.when(claimed, "SPEAKER_NEUTRAL").otherwise(F.col("status"))).withColumn("evidence", F.when(claimed, F.slice("evidence", 1, 0)).otherwise(F.col("evidence"))).withColumn("speaker", F.when(claimed, "UNKNOWN").otherwise(F.col("speaker")))


def unattributed_words(words: DataFrame) -> DataFrame:
    """Words as they were spoken, after attribution as a whole has failed."""
    return words.select("*", F.lit("UNKNOWN").alias("speaker"), F.lit("UNKNOWN_INSUFFICIENT_EVIDENCE").alias("status"), F.lit("DIARIZATION_FAILED").alias("reason"))


def _by_role(kind: Column, at: int) -> Column:
    out = F.lit(None).cast("double")
    for role, limits in ROLE_LIMITS.items():
        out = F.when(kind == role, limits[at]).otherwise(out)
    return out


def effective_distance(stable: Column, recent: Column, blend: float = 0.2, most: float = 0.08) -> Column:
    """The stable distance less a bounded share of what a recent centroid is nearer; null recent: none."""
    gain = F.least(F.lit(most), F.greatest(F.lit(0.0), stable - F.coalesce(recent, stable)))
    return stable - F.lit(blend) * gain


def local_decisions(pieces: DataFrame, distances: dict[str, tuple[str, str]], kind: str = "kind", overlap: str = "overlap", mixed: str = "mixed", valid: str = "valid", confirmed: str = "confirmed") -> DataFrame:
    """Adds speaker, status, stable, effective, margin and reason of the decision on a piece alone.

    *distances* names, for each speaker, the columns of its stable and effective distance. Protected
    overlap is OVERLAP; an unconfirmed number of speakers, or a mixed or invalid piece, is UNKNOWN. The
    nearest by effective distance (ties: the smaller name) is a candidate if it keeps the limits of the
    piece's class in :data:`ROLE_LIMITS`; a single speaker needs no margin. Micro pieces are
    CANDIDATE_SPEAKER or UNKNOWN_SHORT instead. Null distances count as none.
    """
    c = F.col
    ranked = F.array_sort(F.filter(F.array(*[F.struct(c(e).alias("e"), F.lit(s).alias("s"), c(d).alias("d")) for s, (d, e) in sorted(distances.items())]), lambda x: x["e"].isNotNull()))
    micro = c(kind) == "MICRO"

    # each step binds what the next one reads, so that no expression is written out more than once
    def nearest(r: Column) -> Column:
        first, second = F.get(r, F.lit(0)), F.get(r, F.lit(1))
        return F.struct(F.size(r).alias("n"), first["s"].alias("s"), first["d"].alias("stable"), first["e"].alias("effective"), (second["e"] - first["e"]).alias("margin"))

    def judged(x: Column) -> Column:
        failed = F.concat_ws("+", F.when(x["stable"] > _by_role(c(kind), 0), "STABLE_DISTANCE"), F.when(x["effective"] > _by_role(c(kind), 1), "ABSOLUTE_DISTANCE"), F.when(F.round(x["margin"], 12) < _by_role(c(kind), 2), "MARGIN"))
        reason = (
            F.when(c(overlap), "PROTECTED_OVERLAP").when(~c(confirmed), "HYPOTHESIS_UNCONFIRMED").when(c(mixed) | ~c(valid), "MIXED_OR_INVALID_EMBEDDING")
            .when(x["n"] == 0, "NO_SPEAKER_STATE").otherwise(F.coalesce(F.concat(F.lit("LOCAL_GATE_"), F.nullif(failed, F.lit(""))), F.lit("LOCAL_CANDIDATE")))
        )
        return F.struct(x["s"].alias("s"), x["stable"].alias("stable"), x["effective"].alias("effective"), x["margin"].alias("margin"), reason.alias("reason"))

    def told(y: Column) -> Column:
        r = y["reason"]
        given, over = r == "LOCAL_CANDIDATE", r == "PROTECTED_OVERLAP"
        scored = given | r.startswith("LOCAL_GATE_")
        speaker = F.when(over, "OVERLAP").when(given, y["s"]).otherwise("UNKNOWN")
        status = F.when(over, "OVERLAP").when(given, F.when(micro, "CANDIDATE_SPEAKER").otherwise("LOCAL_CANDIDATE")).otherwise(F.when(micro, "UNKNOWN_SHORT").otherwise("UNKNOWN_INSUFFICIENT_EVIDENCE"))
        return F.struct(speaker.alias("speaker"), status.alias("status"), *[F.when(scored, y[n]).alias(n) for n in ("stable", "effective", "margin")], r.alias("reason"))

    return pieces.select("*", F.inline_outer(F.transform(F.transform(F.transform(F.array(ranked), nearest), judged), told)))


def emission_costs(decided: DataFrame, speakers: tuple[str, ...], kind: str = "kind", overlap: str = "overlap", third_risk: str | None = None) -> DataFrame:
    """Adds the map ``emissions`` of label to cost for the decoder; labels that cannot be are left out.

    Only the locally chosen speaker has a cost, its effective distance; UNKNOWN costs little for micro
    pieces; OVERLAP is free where overlap is protected, OTHER possible where a third speaker may be.
    """
    chosen = [F.when((F.col("speaker") == s) & F.col("effective").isNotNull(), F.struct(F.lit(s).alias("key"), F.col("effective").alias("value"))) for s in speakers]
    other = F.lit(False) if third_risk is None else F.col(third_risk)
    fixed = [
        F.struct(F.lit("UNKNOWN").alias("key"), F.when(F.col(kind) == "MICRO", UNKNOWN_MICRO_COST).otherwise(UNKNOWN_COST).alias("value")),
        F.when(F.col(overlap), F.struct(F.lit("OVERLAP").alias("key"), F.lit(0.0).alias("value"))), F.when(other, F.struct(F.lit("OTHER").alias("key"), F.lit(OTHER_COST).alias("value"))),
    ]
    return decided.withColumn("emissions", F.map_from_entries(F.array_compact(F.array(*chosen, *fixed))))


def soft_emissions(pieces: DataFrame, distances: dict[str, tuple[str, str]], kind: str = "kind", overlap: str = "overlap", mixed: str = "mixed", valid: str = "valid", confirmed: str = "confirmed") -> DataFrame:
    """Adds the map ``emissions`` of every speaker within the limits of the piece's class, margin aside."""
    open_ = ~F.col(overlap) & ~F.col(mixed) & F.col(valid) & F.col(confirmed)
    near = [F.when(open_ & (F.col(d) <= _by_role(F.col(kind), 0)) & (F.col(e) <= _by_role(F.col(kind), 1)), F.struct(F.lit(s).alias("key"), F.col(e).alias("value"))) for s, (d, e) in sorted(distances.items())]
    return pieces.withColumn("emissions", F.map_from_entries(F.array_compact(F.array(*near))))


def decision_groups(decided: DataFrame, kind: str = "kind", valid: str = "valid", length: str = "length_us", clean: str = "clean_us") -> DataFrame:
    """Decisions counted by class, validity and outcome: count, duration_us, clean_us."""
    return decided.groupBy(F.col(kind).alias("kind"), F.col(valid).alias("valid"), F.col("reason").alias("outcome")).agg(F.count("*").alias("n"), F.sum(length).cast("bigint").alias("duration_us"), F.sum(clean).cast("bigint").alias("clean_us"))


def decoder_overrides(decided: DataFrame, final: str, kind: str = "kind", length: str = "length_us") -> DataFrame:
    """Pieces whose final label is not the local one: by class and both labels, count and duration."""
    moved = ~F.col("speaker").eqNullSafe(F.col(final))
    counted = decided.groupBy(F.col(kind).alias("kind"), F.col("speaker").alias("local_label"), F.col(final).alias("final_label")).agg(F.count(F.when(moved, 1)).alias("n"), F.sum(F.when(moved, F.col(length))).cast("bigint").alias("duration_us"))
    return counted.where("n > 0")


def rescue_precision(old: DataFrame, new: DataFrame, truth: DataFrame, row: str = "row_id", unknown: str = "UNKNOWN") -> DataFrame:
    """Rows that were *unknown* and are labelled now: n_new, n_known (truth has them), n_right, precision (null: none known).

    Each side has *row* and label; truth labels are in the same names.
    """
    was = old.select(row, F.col("label").alias("_o")).where(F.col("_o") == unknown)
    j = was.join(new.select(row, F.col("label").alias("_n")), row).where(F.col("_n") != unknown).join(truth.select(row, F.col("label").alias("_t")), row, "left")
    known, right = F.count("_t"), F.count(F.when(F.col("_n") == F.col("_t"), 1))
    return j.agg(F.count("*").alias("n_new"), known.alias("n_known"), right.alias("n_right"), F.round(F.try_divide(right.cast("double"), known.cast("double")), 9).alias("precision"))
