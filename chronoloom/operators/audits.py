"""Audits of timelines, frames, ids and vectors: stability between systems, topology, contracts, parity."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.scalars import label_kind
from chronoloom.operators.blocked import scanned
from chronoloom.operators.intervals import interval_join, overlap_us
from chronoloom.operators.periods import HOUR_US, continuous_periods, sweep
from chronoloom.operators.scoring import boundary_matches, ratio
from chronoloom.session import cut

#: Names that are no pseudonym, whatever their form.
NO_PSEUDONYMS = ("unknown", "overlap", "anonymous", "anonymized", "name", "realname", "customer", "client", "transcript", "speaker", "person")


def flat_timeline(spans: DataFrame, keys: list[str], first: str, second: str, both: str = "OVERLAP") -> DataFrame:
    """A timeline of disjoint spans from two labels that may overlap: longest stretches of one state."""
    pick = lambda x: spans.where(F.col("label") == x).select(*keys, "start_us", "end_us")
    cells = sweep({"_a": pick(first), "_b": pick(second)}, keys).where("_a + _b > 0")
    state = F.when((F.col("_a") > 0) & (F.col("_b") > 0), both).when(F.col("_a") > 0, first).otherwise(second)
    return continuous_periods(cells.select(*keys, state.alias("label"), "start_us", "end_us"), [*keys, "label"]).select(*keys, "label", "start_us", "end_us")


def _mapping(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The variant's label for each canonical one with most time in common: keys, _variant, _canonical.

    At most two labels a side count as speakers, so a mapping is one of at most two; ties go to the one
    whose pairs come first by name. With more than two labels on a side a recording has no mapping.
    """
    known = pairs.where("_lk = 'assigned' AND _rk = 'assigned'").groupBy(*keys, "_l", "_r").agg(F.sum("_us").alias("_us"))
    rows = known.groupBy(*keys).agg(F.array_sort(F.collect_set("_l")).alias("ls"), F.array_sort(F.collect_set("_r")).alias("rs"), F.map_from_entries(F.collect_list(F.struct(F.struct(F.col("_r").alias("r"), F.col("_l").alias("l")).alias("key"), F.col("_us").alias("value")))).alias("us"))
    l0, l1, r0, r1 = F.get("ls", F.lit(0)), F.get("ls", F.lit(1)), F.get("rs", F.lit(0)), F.get("rs", F.lit(1))
    pair = lambda r, l: F.struct(r.alias("r"), l.alias("l"))
    us = lambda *ps: sum((F.coalesce(F.try_element_at("us", p), F.lit(0)) for p in ps), F.lit(0))
    straight, crossed = (pair(r0, l0), pair(r1, l1)), (pair(r0, l1), pair(r1, l0))
    n, m = F.size("rs"), F.size("ls")
    chosen = (
        F.when((n == 1) & (m == 1), F.array(pair(r0, l0)))
        .when((n == 1) & (m == 2), F.when(us(pair(r0, l1)) > us(pair(r0, l0)), F.array(pair(r0, l1))).otherwise(F.array(pair(r0, l0))))
        .when((n == 2) & (m == 2), F.when(us(*crossed) > us(*straight), F.array(*crossed)).otherwise(F.array(*straight)))
        .when((n == 2) & (m == 1), F.array(pair(r0, l0), pair(r1, l0)))
    )
    return rows.select(*keys, F.explode(chosen).alias("p")).select(*keys, F.col("p.r").alias("_r"), F.col("p.l").alias("_l"), F.lit(True).alias("_mapped"))


def stability_metrics(canonical: DataFrame, variants: DataFrame, keys: list[str], variant: str = "variant", central: str | None = None, tolerance_us: int = 250_000) -> DataFrame:
    """How far each variant of a timeline agrees with the canonical one, per key and variant.

    Both are disjoint spans (keys, label, start_us, end_us), variants with their name. Columns:
    co_assigned_agreement (time with a speaker on both sides that is the mapped one), speaker_flip_rate
    (canonical speaker time that is not kept), attribution_retention (that is kept), unknown_delta
    (variant's share of unknown time less the canonical one's), speech_iou, boundary_f1 within
    *tolerance_us*, and, with a flag column *central*, central_agreement. Null where there is nothing to
    divide by. Variant labels are mapped to canonical ones by most time in common.

    Defined cases: a key that one side lacks has only what the other can tell (rates of it are null);
    labels UNKNOWN, NON_SPEECH and blank are unknown, OVERLAP is speech but no speaker.
    """
    kv = [*keys, variant]
    size = F.col("end_us") - F.col("start_us")
    variants = cut(variants, "variants")
    names = cut(variants.select(*kv).distinct(), "names")
    base = cut(canonical.join(names, keys).select(*kv, F.col("label").alias("_l"), label_kind(F.col("label")).alias("_lk"), (F.lit(False) if central is None else F.col(central)).alias("_c"), "start_us", "end_us"), "canonical")
    other = variants.select(*kv, F.col("label").alias("_r"), label_kind(F.col("label")).alias("_rk"), "start_us", "end_us")
    pairs = interval_join(base, other, kv).withColumn("_us", overlap_us(F.col("start_us"), F.col("end_us"), F.col("other_start_us"), F.col("other_end_us")))
    sums = cut(pairs.groupBy(*kv, "_l", "_lk", "_r", "_rk", "_c").agg(F.sum("_us").alias("_us")), "pairs")
    told = sums.join(_mapping(sums, kv), [*kv, "_l", "_r"], "left")
    us = lambda cond: F.sum(F.when(F.expr(cond), F.col("_us")).otherwise(0))
    joint = told.groupBy(*kv).agg(us("_lk = 'assigned' AND _rk = 'assigned' AND _mapped").alias("_match"), us("_lk = 'assigned' AND _rk = 'assigned'").alias("_joint"), us("_lk = 'assigned' AND _mapped").alias("_kept"), us("_lk <> 'unknown' AND _rk <> 'unknown'").alias("_both"), us("_c AND _lk = 'assigned' AND _mapped").alias("_central"))
    total = lambda df, kind, p: df.groupBy(*kv).agg(F.sum(size).alias(f"_{p}all"), F.sum(F.when(F.col(kind) == "assigned", size).otherwise(0)).alias(f"_{p}known"), F.sum(F.when(F.col(kind) == "unknown", size).otherwise(0)).alias(f"_{p}none"), *([F.sum(F.when(F.col("_c") & (F.col(kind) == "assigned"), size).otherwise(0)).alias("_ccentral")] if p == "c" else []))
    # starts of all but the first span and ends of all but the last
    def edges(df: DataFrame) -> DataFrame:
        w = df.groupBy(*kv).agg(F.min("start_us").alias("_f"), F.max("end_us").alias("_z"))
        at = df.select(*kv, F.explode(F.array(F.struct(F.col("start_us").alias("at"), F.lit(0).alias("side")), F.struct(F.col("end_us").alias("at"), F.lit(1).alias("side")))).alias("e")).select(*kv, "e.*")
        return at.join(w, kv).where("(side = 0 AND at > _f) OR (side = 1 AND at < _z)").select(*kv, "at").distinct()

    points = boundary_matches(edges(base), edges(other), kv, "at", tolerance_us)
    all_ = names.join(joint, kv, "left").join(total(base, "_lk", "c"), kv, "left").join(total(other, "_rk", "v"), kv, "left").join(points, kv, "left")
    share = lambda a, b: ratio(F.coalesce(F.col(a), F.lit(0)), F.col(b), None)
    n = F.lit(2) * F.coalesce("tp", F.lit(0)) + F.coalesce("fp", F.lit(0)) + F.coalesce("fn", F.lit(0))
    there = F.col("_call").isNotNull() & F.col("_vall").isNotNull()
    f1 = F.when(there, F.when(n == 0, 1.0).otherwise(ratio(F.lit(2) * F.coalesce("tp", F.lit(0)), n)))
    speech = (F.col("_call") - F.col("_cnone")) + (F.col("_vall") - F.col("_vnone")) - F.coalesce("_both", F.lit(0))
    flips = F.when(F.col("_vall").isNotNull(), ratio(F.col("_cknown") - F.coalesce("_kept", F.lit(0)), F.col("_cknown"), None))
    return all_.select(
        *kv, share("_match", "_joint").alias("co_assigned_agreement"), flips.alias("speaker_flip_rate"), F.when(there, share("_kept", "_cknown")).alias("attribution_retention"),
        F.when(there, F.round(F.try_divide(F.col("_vnone").cast("double"), F.col("_vall").cast("double")) - F.try_divide(F.col("_cnone").cast("double"), F.col("_call").cast("double")), 9)).alias("unknown_delta"),
        F.when(there, ratio(F.coalesce("_both", F.lit(0)), speech, None)).alias("speech_iou"), f1.alias("boundary_f1"), *([F.when(there, share("_central", "_ccentral")).alias("central_agreement")] if central else []),
    )


def topology_safety(ref: DataFrame, hyp: DataFrame, keys: list[str], statuses: DataFrame | None = None, floor_us: int = 2, neutral: tuple[str, ...] = ("UNKNOWN", "NON_SPEECH", "OVERLAP", "OTHER")) -> DataFrame:
    """One row on how often the number of speakers is told wrongly: counts and rates over all recordings.

    A speaker counts with *floor_us* or more of united time. Of recordings with two reference speakers
    those with one are complete merges, unsafe where *statuses* (keys, status) passed them for speakers;
    of those with one, those told as two are false. No recordings give zeros.
    """
    def speakers(df: DataFrame, name: str) -> DataFrame:
        united = continuous_periods(df.where(F.col("label").isNotNull() & ~F.col("label").isin(*neutral)), [*keys, "label"]).groupBy(*keys, "label").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("_us"))
        return united.groupBy(*keys).agg(F.count(F.when(F.col("_us") >= floor_us, 1)).alias(name))

    both = speakers(ref, "r").join(speakers(hyp, "h"), keys, "left").na.fill(0, ["h"])
    both = both.withColumn("status", F.lit(None).cast("string")) if statuses is None else both.join(statuses.select(*keys, "status"), keys, "left")
    n = lambda cond: F.count(F.when(F.expr(cond), 1))
    aware, passed = "status IN ('PASS_HIGH', 'PASS_STANDARD')", "status IN ('PASS_HIGH', 'PASS_STANDARD', 'PASS_WITH_UNATTRIBUTED')"
    two, one, right = n("r = 2"), n("r = 1"), n("r IN (1, 2) AND r = h")
    return both.agg(
        F.count("*").alias("n_recordings"), two.alias("n_two"), one.alias("n_one"), ratio(n("r = 2 AND h = 1"), two).alias("complete_merge_rate"), ratio(n(f"r = 2 AND h = 1 AND {aware}"), two).alias("unsafe_merge_rate"),
        ratio(n("r = 1 AND h = 2"), one).alias("false_two_rate"), ratio(right, two + one).alias("count_accuracy"), ratio(n(f"r = 2 AND h = 1 AND {passed}"), F.count("*")).alias("false_pass_rate"),
    )


def annotation_checks(turns: DataFrame, scope: DataFrame, expected: DataFrame, keys: list[str], short_us: int = 1_000_000, width: int = HOUR_US) -> DataFrame:
    """Per recording of *expected* (keys, speaker_count): n_turns, n_speakers, short_turn, overlap_us, issues.

    Issues, in this order: SPEAKER_COUNT_MISMATCH, OUTSIDE_SCOPE (a turn that no period of the scope
    holds). ``overlap_us`` is the time with two speakers or more, a third one not counted again.
    Recordings without turns have counts of 0 and, if speakers were expected, a mismatch.
    """
    from chronoloom.operators.intervals import contained

    by_turn = contained(turns.select(*keys, "label", "start_us", "end_us"), scope.select(*keys, "start_us", "end_us"), keys)
    counts = by_turn.groupBy(*keys).agg(F.count("*").alias("n_turns"), F.countDistinct("label").alias("n_speakers"), F.bool_or(F.col("end_us") - F.col("start_us") <= short_us).alias("short_turn"), F.bool_or(~F.col("inside")).alias("_out"))
    united = continuous_periods(turns, [*keys, "label"], width)
    cells = sweep({"_n": united.select(*keys, "start_us", "end_us")}, keys, width)
    over = cells.where("_n >= 2").groupBy(*keys).agg(F.sum(F.col("end_us") - F.col("start_us")).alias("overlap_us"))
    all_ = expected.join(counts, keys, "left").join(over, keys, "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0)).alias(x)
    issues = F.concat_ws("+", F.when(~F.col("speaker_count").eqNullSafe(F.coalesce("n_speakers", F.lit(0))), "SPEAKER_COUNT_MISMATCH"), F.when(F.col("_out"), "OUTSIDE_SCOPE"))
    return all_.select(*keys, zero("n_turns"), zero("n_speakers"), F.coalesce("short_turn", F.lit(False)).alias("short_turn"), zero("overlap_us"), issues.alias("issues"))


def frame_faults(frames: DataFrame, keys: list[str], p: str = "p", width: int = HOUR_US) -> DataFrame:
    """Frames that a decoder must not take: keys, start_us, fault (NOT_FINITE before NOT_CONTIGUOUS)."""
    near = scanned(frames, keys, "start_us", ["end_us"], width, lag={"_e": F.col("end_us")})
    x = F.col(p).cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fault = F.when(bad, "NOT_FINITE").when(F.col("_e").isNotNull() & (F.col("_e") != F.col("start_us")), "NOT_CONTIGUOUS")
    return near.select(*keys, "start_us", fault.alias("fault")).where("fault IS NOT NULL")


def frame_parity(reference: DataFrame, candidate: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per column over frames of the same place: n, mean, 95th percentile and greatest absolute error.

    Frames that only one side has are counted in ``n_unmatched``, so no disagreement on them is lost.
    """
    j = reference.select(*keys, *[F.col(c).cast("double").alias(f"_r{k}") for k, c in enumerate(columns)], F.lit(1).alias("_a")).join(candidate.select(*keys, *[F.col(c).cast("double").alias(f"_c{k}") for k, c in enumerate(columns)], F.lit(1).alias("_b")), keys, "full")
    long = j.select((F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("_m"), F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.abs(F.col(f"_r{k}") - F.col(f"_c{k}")).alias("x")) for k, c in enumerate(columns)])).alias("e")).select("_m", "e.*")
    return long.groupBy("metric").agg(F.count(F.when(F.col("_m"), 1)).alias("n"), F.count(F.when(~F.col("_m"), 1)).alias("n_unmatched"), F.round(F.avg("x"), 9).alias("mean_error"), F.round(F.percentile("x", F.lit(0.95)), 9).alias("p95_error"), F.round(F.max("x"), 9).alias("max_error"))


def opaque_id(written: Column) -> Column:
    """Whether a text is a machine's identifier: 1 to 128 letters, digits, ``_.-``, the first a letter or
    digit, with at least one digit, and none of :data:`NO_PSEUDONYMS`. Null is none."""
    return F.coalesce(written.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.\-]{0,127}\z") & written.rlike("[0-9]") & ~F.lower(written).isin(*NO_PSEUDONYMS), F.lit(False))


def vector_faults(rows: DataFrame, row: str, vector: str) -> DataFrame:
    """Rows whose vector is not of unit length: EMPTY, NOT_FINITE or NOT_UNIT (beyond 1e-4)."""
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fault = F.when(v.isNull() | (F.size(v) == 0), "EMPTY").when(odd, "NOT_FINITE").when(F.abs(norm - 1) > F.greatest(F.lit(1e-4), 1e-4 * F.greatest(norm, F.lit(1.0))), "NOT_UNIT")
    return rows.select(row, fault.alias("fault")).where("fault IS NOT NULL")


def pcm_stats(samples: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Samples, sum of squares and peak of each key, in whole numbers."""
    v = F.col(x).cast("bigint")
    return samples.groupBy(*keys).agg(F.count(x).alias("n"), F.coalesce(F.sum(v * v), F.lit(0)).alias("squares"), F.coalesce(F.max(F.abs(v)), F.lit(0)).alias("peak"))


def window_energies(samples: DataFrame, keys: list[str], sizes: list[int], stride: int, rows: int = 100_000) -> DataFrame:
    """Mean square of every window of each size, starting every *stride* samples: keys, size, start, energy.

    *samples* (keys, k, x) are numbered from 0 without holes. A key shorter than a size has one window, of
    all it has; where the stride leaves a tail, one more window ends at the end. Sums of squares run
    through the key in blocks of *rows*, and a window is the difference of two of them.
    """
    sums = scanned(samples.select(*keys, "k", (F.col("x").cast("bigint") * F.col("x").cast("bigint")).alias("_q")), keys, "k", [], rows, total={"_s": F.col("_q")}).select(*keys, "k", "_s")
    n = samples.groupBy(*keys).agg((F.max("k") + 1).alias("_n"))
    last = lambda size: F.greatest(F.lit(0), F.col("_n") - size)
    starts = lambda size: F.array_distinct(F.concat(F.sequence(F.lit(0).cast("bigint"), last(size), F.lit(stride).cast("bigint")), F.array(last(size).cast("bigint"))))
    def sized(s: int) -> Column:
        return F.transform(starts(s), lambda a: F.struct(F.lit(s).alias("size"), a.alias("start")))

    wins = n.select(*keys, "_n", F.explode(F.flatten(F.array(*[sized(s) for s in sizes]))).alias("w")).select(*keys, "w.*", (F.least(F.col("w.start") + F.col("w.size"), F.col("_n")) - 1).alias("_z"))
    upto = wins.join(sums.select(*keys, F.col("k").alias("_z"), F.col("_s").alias("_to")), [*keys, "_z"])
    both = upto.withColumn("_p", F.col("start") - 1).join(sums.select(*keys, F.col("k").alias("_p"), F.col("_s").alias("_from")), [*keys, "_p"], "left")
    return both.select(*keys, "size", "start", F.round((F.col("_to") - F.coalesce("_from", F.lit(0))) / (F.col("_z") - F.col("start") + 1), 9).alias("energy"))


def pooled_events(rows: DataFrame, dims: list[str]) -> DataFrame:
    """tp, fp and fn summed over recordings, with precision, recall and F1 of the sums."""
    from chronoloom.operators.scoring import f_scores

    sums = rows.groupBy(*dims).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return sums.select("*", *f_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def third_speaker_risk(rows: DataFrame, keys: list[str], centres: DataFrame, vector: str, weight: str, block: str, residual: float = 0.45, dispersion: float = 0.2, separation: float = 0.15) -> DataFrame:
    """Whether what fits no centre of a key is a compact voice of its own: keys, n_residual, n_blocks, risk.

    *centres* (keys, centres: array of unit vectors) has one row a key. Residuals are rows further than
    *residual* from every centre; they are a risk with two blocks or more, a weighted spread of at most
    *dispersion* about their own centre, and that centre *separation* or more from every other. All by
    distributed sums: a key's vectors never meet in one task.
    """
    from chronoloom.operators.vectors import dot, unit, weighted_centroids

    far = lambda v, cs: F.array_min(F.transform(cs, lambda c: 1 - dot(v, c)))
    left = rows.select(*keys, unit(F.col(vector)).alias("_v"), F.col(weight).cast("double").alias("_w"), F.col(block).alias("_b")).join(centres.select(*keys, "centres"), keys)
    left = left.where(far(F.col("_v"), F.col("centres")) > residual)
    own = weighted_centroids(left, keys, "_v", "_w")
    spread = left.join(own, keys).groupBy(*keys).agg(F.count("*").alias("n_residual"), F.countDistinct("_b").alias("n_blocks"), F.try_divide(F.sum(F.col("_w") * (1 - dot(F.col("_v"), F.col("centroid")))), F.sum("_w")).alias("_d"))
    apart = own.join(centres, keys).select(*keys, far(F.col("centroid"), F.col("centres")).alias("_s"))
    told = centres.select(*keys).join(spread, keys, "left").join(apart, keys, "left")
    risk = F.coalesce((F.col("n_blocks") >= 2) & (F.col("_d") <= dispersion) & (F.col("_s") >= separation), F.lit(False))
    return told.select(*keys, F.coalesce("n_residual", F.lit(0)).alias("n_residual"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), risk.alias("risk"))


def file_quality(rows: DataFrame, unknown_warn: float = 0.2, overlap_warn: float = 0.1) -> DataFrame:
    """Adds status, mode and reasons of a file from its diagnostics.

    Columns read: unknown_ratio, overlap_ratio, out_of_profile, ambiguous, calibration_reasons,
    review_reasons (arrays), crossing, unattributed_overlap, all_high, evaluated_overlap. Measured
    evidence against a file stands without calibration; any reason against the calibration, then any for
    review, asks for review; then what speaks against attribution; a file is high only where all high
    rules pass and overlap was evaluated. Null flags are false, null ratios 0 and null arrays empty.
    """
    flag = lambda x: F.coalesce(F.col(x), F.lit(False))
    many = lambda x: F.coalesce(F.col(x), F.array().cast("array<string>"))
    value = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    odd = F.isnan(value("unknown_ratio")) | F.isnan(value("overlap_ratio"))
    when = lambda cond, code: F.when(cond, F.array(F.lit(code))).otherwise(F.array().cast("array<string>"))
    invalid = when(odd, "Q_INVALID_METRIC")
    outside = F.when(F.size(invalid) > 0, invalid).otherwise(F.array(F.lit("Q_CONFIRMED_OUT_OF_PROFILE_SPEAKER_COUNT")))
    review = F.concat(many("review_reasons"), when(flag("ambiguous"), "Q_H1_H2_AMBIGUOUS"))
    degrade = F.concat(when(flag("crossing"), "Q_WORD_BOUNDARY_CROSSING_PRESENT"), when(flag("unattributed_overlap"), "Q_OVERLAP_UNATTRIBUTED_PRESENT"), when(value("unknown_ratio") > unknown_warn, "Q_HIGH_UNKNOWN_RATIO"), when(value("overlap_ratio") > overlap_warn, "Q_HIGH_OVERLAP_RATIO"))
    calibration = many("calibration_reasons")
    status = (
        F.when(flag("out_of_profile"), "UNSUPPORTED").when((F.size(calibration) > 0) | (F.size(review) > 0), "REVIEW_REQUIRED").when(F.size(degrade) > 0, "PASS_WITH_UNATTRIBUTED")
        .when(flag("all_high") & flag("evaluated_overlap"), "PASS_HIGH").otherwise("PASS_STANDARD")
    )
    s = F.col("status")
    mode = F.when(s.isin("UNSUPPORTED", "PASS_WITH_UNATTRIBUTED"), "SPEAKER_NEUTRAL").when(s == "REVIEW_REQUIRED", "MANUAL_REVIEW").otherwise("SPEAKER_AWARE")
    reasons = F.when(s == "UNSUPPORTED", outside).when(F.size(calibration) > 0, F.concat(invalid, calibration, many("review_reasons"))).when(s == "REVIEW_REQUIRED", review).when(s == "PASS_WITH_UNATTRIBUTED", degrade).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("status", status).withColumn("mode", mode).withColumn("reasons", reasons)


def calibration_mismatches(rows: DataFrame, profile: str, hashes: dict[str, str], rate: int, config_hash: str) -> DataFrame:
    """Adds ``calibration_reasons``: how a file's diagnostics (profile_id, model_hashes map, source_rate,
    config_hash) differ from a calibration; missing ones are unbound, hashes differ regardless of case."""
    told = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v.lower()).alias("v")) for k, v in sorted(hashes.items())])
    given = F.array_sort(F.transform(F.map_entries("model_hashes"), lambda e: F.struct(e["key"].alias("k"), F.lower(e["value"]).alias("v"))))
    c = F.col
    unbound = c("profile_id").isNull() | c("model_hashes").isNull() | c("source_rate").isNull() | c("config_hash").isNull()
    codes = [
        F.when(unbound, F.lit("Q_CALIBRATION_UNBOUND")), F.when(c("profile_id") != profile, F.lit("Q_CALIBRATION_PROFILE_MISMATCH")), F.when(given != told, F.lit("Q_CALIBRATION_MODEL_HASH_MISMATCH")),
        F.when(c("source_rate") != rate, F.lit("Q_CALIBRATION_SOURCE_RATE_MISMATCH")), F.when(F.lower("config_hash") != config_hash.lower(), F.lit("Q_CALIBRATION_CONFIG_HASH_MISMATCH")),
    ]
    return rows.withColumn("calibration_reasons", F.array_compact(F.array(*codes)))


def matched_events(reference: DataFrame, candidate: DataFrame, keys: list[str], at: str, collar_us: int) -> DataFrame:
    """Each reference event, in order of time, takes the nearest free candidate within *collar_us* (ties: the
    earlier): keys, n_reference, n_candidate, n_matched, p95_error_us.

    Events are cut into clusters whose neighbours are more than the collar apart; a cluster is one
    pair of arrays of numbers.
    """
    both = reference.select(*keys, F.col(at).cast("bigint").alias("t"), F.lit(0).alias("side")).unionByName(candidate.select(*keys, F.col(at).cast("bigint").alias("t"), F.lit(1).alias("side"))).where("t IS NOT NULL")
    near = scanned(both, keys, "t", ["side"], HOUR_US, lag={"_p": F.col("t")}).withColumn("_f", F.when(F.col("t") - F.col("_p") <= collar_us, F.lit(None)).otherwise(F.col("t")))
    clusters = scanned(near, keys, "t", ["side"], HOUR_US, top={"_c": F.col("_f")})

    @F.pandas_udf("array<bigint>")
    def matches(refs: pd.Series, cands: pd.Series) -> pd.Series:
        def one(ref, cand):  # noqa: ANN001, ANN202
            free, out = sorted(cand), []
            for t in sorted(ref):
                k = bisect.bisect_left(free, t)
                near = [(abs(free[i] - t), i) for i in (k - 1, k) if 0 <= i < len(free) and abs(free[i] - t) <= collar_us]
                if near:
                    error, i = min(near)
                    out.append(error)
                    free.pop(i)
            return out

        return pd.Series([one(r, c) for r, c in zip(refs, cands, strict=True)])

    side = lambda k: F.collect_list(F.when(F.col("side") == k, F.col("t")))
    found = clusters.groupBy(*keys, "_c").agg(side(0).alias("_r"), side(1).alias("_h")).select(*keys, F.size("_r").alias("n_reference"), F.size("_h").alias("n_candidate"), matches("_r", "_h").alias("errors"))
    counts = found.groupBy(*keys).agg(F.sum("n_reference").alias("n_reference"), F.sum("n_candidate").alias("n_candidate"), F.sum(F.size("errors")).alias("n_matched"))
    errors = found.select(*keys, F.explode("errors").alias("x")).groupBy(*keys).agg(F.percentile("x", F.lit(0.95)).alias("p95_error_us"))
    return counts.join(errors, keys, "left")
