"""Operators on ordered sequences: thresholds with memory, changes, turns, decoding."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.blocked import scanned, with_halo
from chronoloom.operators.periods import HOUR_US
from chronoloom.session import cut


def hysteresis_regions(frames: DataFrame, keys: list[str], p: str = "p", on: float = 0.5, off: float = 0.35, min_silence_us: int = 100_000, most_us: int | None = None, width: int = HOUR_US) -> DataFrame:
    """Core regions of a two-threshold state machine over contiguous frames: keys, start_us, end_us, n_frames.

    A frame at or over *on* opens; frames under *off* are silence, and the region closes, at the start
    of that silence, on the first later frame that begins *min_silence_us* or more after it. Without a
    fold: silences are runs between louder frames, so the state at a frame is the latest of the last
    opening and the last closing, two running maxima, and the last closing names the region.

    A region longer than *most_us* is cut at every multiple of it from its start (n_frames is then that
    of the whole region); frames are taken to be no longer than that. Defined cases: frames without a
    start or p are ignored; a key of one frame is a region if the frame opens; no frames, no regions.
    """
    f = frames.where(F.col("start_us").isNotNull() & F.col(p).isNotNull()).withColumn("_quiet", F.col(p) < off)
    f = scanned(f, keys, "start_us", ["end_us"], width, top={"_loud": F.when(F.col(p) >= off, F.col("end_us")), "_first": -F.col("start_us")})
    since = F.coalesce("_loud", -F.col("_first"))
    opens = F.when(F.col(p) >= on, F.col("start_us"))
    closes = F.when(F.col("_quiet") & (F.col("start_us") - since >= min_silence_us), F.col("start_us"))
    f = scanned(f, keys, "start_us", ["end_us"], width, top={"_opens": opens, "_closes": closes})
    found = (
        f.where("_opens IS NOT NULL AND (_closes IS NULL OR _opens > _closes)").groupBy(*keys, "_closes")
        .agg(F.min("start_us").alias("start_us"), F.max(F.when(~F.col("_quiet"), F.col("end_us"))).alias("end_us"), F.count("*").alias("n_frames")).drop("_closes")
    )
    if most_us is None:
        return found
    cuts = found.withColumn("_s", F.explode(F.sequence(F.col("start_us"), F.col("end_us") - 1, F.lit(most_us).cast("bigint"))))
    return cuts.select(*keys, F.col("_s").alias("start_us"), F.least(F.col("_s") + most_us, "end_us").alias("end_us"), "n_frames")


def context_change(frames: DataFrame, keys: list[str], value: str, context: int = 15, width: int = HOUR_US) -> DataFrame:
    """Adds ``change``: difference of the means of the *context* frames after and before each frame."""
    spread, w = with_halo(frames, keys, "start_us", ["end_us"], width, context, context - 1)
    left, right = F.avg(value).over(w.rowsBetween(-context, -1)), F.avg(value).over(w.rowsBetween(0, context - 1))
    return spread.withColumn("change", F.round(F.abs(right - left), 9)).where("_own").select(*frames.columns, "change")


def separated_peaks(events: DataFrame, keys: list[str], score: str, threshold: float, separation_us: int, width: int = HOUR_US) -> DataFrame:
    """Local maxima over *threshold*, the strongest kept first and none within *separation_us* of a kept one.

    Peaks further apart cannot affect each other, so chains of near peaks are thinned on their own, each
    by one pass in order of score and time that looks at the two kept neighbours alone (two numbers a
    peak; a chain is one task). Ties go to the earlier peak; rows without a score are no peaks.
    """
    x = F.col(score).cast("double")
    near = scanned(events.where(F.col("start_us").isNotNull()).select(*keys, F.col("start_us").cast("bigint").alias("start_us"), x.alias("_s")), keys, "start_us", ["_s"], width, lag={"_a": F.col("_s")}, lead={"_b": F.col("_s")})
    peaks = near.where((F.col("_s") >= threshold) & F.coalesce(F.col("_s") >= F.col("_a"), F.lit(True)) & F.coalesce(F.col("_s") > F.col("_b"), F.lit(True))).drop("_a", "_b")
    chained = scanned(peaks, keys, "start_us", ["_s"], width, lag={"_p": F.col("start_us")})
    marked = chained.withColumn("_f", F.when(F.col("start_us") - F.col("_p") < separation_us, F.lit(None)).otherwise(F.col("start_us")))
    grouped = scanned(marked, keys, "start_us", ["_s"], width, top={"_chain": F.col("_f")}).groupBy(*keys, "_chain").agg(F.sort_array(F.collect_list(F.struct((-F.col("_s")).alias("s"), F.col("start_us").alias("t")))).alias("peaks"))

    @F.pandas_udf("array<bigint>")
    def kept(lists: pd.Series) -> pd.Series:
        def one(peaks):  # noqa: ANN001, ANN202
            held: list[int] = []
            for x in peaks:
                k = bisect.bisect_left(held, x["t"])
                if (k == len(held) or held[k] - x["t"] >= separation_us) and (k == 0 or x["t"] - held[k - 1] >= separation_us):
                    held.insert(k, x["t"])
            return held

        return lists.map(one)

    return grouped.select(*keys, F.explode(kept("peaks")).alias("at_us"))


def speaker_turns(words: DataFrame, keys: list[str], label: str = "word_label", gap_us: int = 1_000_000, width: int = HOUR_US, same: tuple[str, ...] = ()) -> DataFrame:
    """Words of one label with pauses of at most *gap_us* become a turn: turn, label, *same*, start, end, words, text.

    A turn also ends where one of the columns *same* (status, evidence) changes. Turn numbers come from
    flags summed in blocks of time and carried across, so a long recording is many tasks; a turn's words
    meet by its number. Null labels are a label of their own; ties of start are ordered by word_id.
    """
    told = F.struct(F.col(label).alias("l"), *[F.col(c).alias(f"s{k}") for k, c in enumerate(same)])
    rows = cut(words.select(*keys, label, *same, "start_us", "end_us", "word_id", "text", told.alias("_told")), "words")  # a scan reads its rows twice
    near = scanned(rows, keys, "start_us", ["word_id"], width, lag={"_pt": F.col("_told"), "_pe": F.col("end_us")})
    goes_on = F.col("_pt").eqNullSafe(F.col("_told")) & (F.col("start_us") - F.col("_pe") <= gap_us)
    flagged = cut(near.select(*keys, label, *same, "start_us", "end_us", "word_id", "text", F.when(goes_on, 0).otherwise(1).alias("_f")), "words")
    turns = scanned(flagged, keys, "start_us", ["word_id"], width, total={"turn": F.col("_f")})
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_us", "word_id", "text"))), lambda x: x["text"]), " ")
    return turns.groupBy(*keys, "turn", F.col(label).alias("label"), *same).agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count("*").alias("n_words"), said.alias("text"))


def neighbour_consensus(rows: DataFrame, keys: list[str], label: str, unknown: str, max_gap_us: int, width: int = HOUR_US) -> DataFrame:
    """Unknown rows whose nearest known neighbours on both sides agree within *max_gap_us*."""
    known = F.when(F.col(label) != unknown, F.struct(F.col(label).alias("l"), "start_us", "end_us"))
    both = scanned(rows, keys, "start_us", ["row_id"], width, last={"_l": known}, after={"_r": known}).where(F.col(label) == unknown)
    near = (F.col("start_us") - F.col("_l.end_us") <= max_gap_us) & (F.col("_r.start_us") - F.col("end_us") <= max_gap_us)
    return both.where((F.col("_l.l") == F.col("_r.l")) & near).select(*rows.columns, F.col("_l.l").alias("consensus"))


def transition_costs(rows: DataFrame, keys: list[str], base: float = 0.35, reset_us: int = 1_500_000, relief_us: int = 500_000, width: int = HOUR_US) -> DataFrame:
    """Adds ``gap_us`` and ``switch_cost``: *base*, less in proportion to the pause before, 0 from *reset_us* on."""
    gapped = scanned(rows, keys, "start_us", ["row_id"], width, lag={"gap_us": F.col("end_us")}).withColumn("gap_us", F.col("start_us") - F.col("gap_us"))
    return gapped.withColumn("switch_cost", F.when(F.col("gap_us").isNull() | (F.col("gap_us") >= reset_us), F.lit(0.0)).otherwise(F.round(F.lit(base) * (1 - F.least(F.lit(1.0), F.greatest(F.lit(0), F.col("gap_us")) / F.lit(2 * relief_us))), 9)))


def label_transition(previous: Column, current: Column, gap_us: Column, scd: Column, base: float = 0.35, scd_relief: float = 0.2, gap_relief: float = 0.1, uncertain: float = 0.12, reset_us: int = 1_500_000, speakers: tuple[str, ...] = ("A", "B")) -> Column:
    """Cost of going from one label to the next: 0 after a long pause and for the same label.

    Between speakers *base* less the relief of a change probe (*scd*, null: 0) and of the pause, never
    below 0; from or to any other label *uncertain*.
    """
    gap = F.greatest(F.lit(0), gap_us)
    relief = F.lit(scd_relief) * F.coalesce(scd, F.lit(0.0)) + F.lit(gap_relief) * F.least(F.lit(1.0), gap / F.lit(max(1, reset_us)))
    return F.when(gap >= reset_us, 0.0).when(previous == current, 0.0).when(previous.isin(*speakers) & current.isin(*speakers), F.greatest(F.lit(0.0), F.lit(base) - relief)).otherwise(F.lit(uncertain))


def decoded_labels(rows: DataFrame, keys: list[str], emissions: dict[str, Column], reset_us: int = 1_500_000, cost: str = "switch_cost", row: str = "row_id", width: int = HOUR_US) -> DataFrame:
    """Cheapest label sequence of each piece of a recording: emissions plus switch costs (row_id, label).

    A pause of *reset_us* makes every switch free, so pieces between such pauses are decoded apart,
    each as one array; a piece without such a pause is one row. Of predecessors, and of
    last labels, that cost the same UNKNOWN is taken first, then the smaller label.
    """
    paused = scanned(rows, keys, "start_us", [row], width, lag={"_pe": F.col("end_us")})
    opens = F.when(F.coalesce(F.col("start_us") - F.col("_pe") < reset_us, F.lit(False)), F.lit(None)).otherwise(F.struct("start_us", row))
    pieces = scanned(paused.withColumn("_opens", opens), keys, "start_us", [row], width, top={"_piece": F.col("_opens")})
    labels = sorted(emissions, key=lambda x: (x != "UNKNOWN", x))
    item = F.struct("start_us", F.col(row).alias("row_id"), F.col(cost).alias("w"), F.array(*[emissions[x].cast("double") for x in labels]).alias("e"))
    listed = pieces.groupBy(*keys, "_piece").agg(F.sort_array(F.collect_list(item)).alias("_rows"))
    n = range(len(labels))

    @F.pandas_udf("at array<int>, cost double")
    def decode(lists: pd.Series) -> pd.DataFrame:
        def one(rows):  # noqa: ANN001, ANN202
            best, back = list(rows[0]["e"]), []
            for x in rows[1:]:
                # labels stand in order of preference, so the first of equals is the one to take
                e, switch = list(x["e"]), x["w"]
                options = [[best[a] + (0.0 if a == b else switch) + e[b] for a in n] for b in n]
                back.append([o.index(min(o)) for o in options])
                best = [min(o) for o in options]
            at = best.index(min(best))
            path = [at]
            for b in reversed(back):
                at = b[at]
                path.append(at)
            return path[::-1], float(min(best))

        return pd.DataFrame([one(r) for r in lists], columns=["at", "cost"])

    named = F.array(*[F.lit(x) for x in labels])
    told = listed.withColumn("_d", decode("_rows")).select(F.explode(F.arrays_zip(F.transform("_rows", lambda x: x["row_id"]).alias("row_id"), F.transform("_d.at", lambda k: F.get(named, k)).alias("label"))).alias("x"), F.col("_d.cost").alias("cost"))
    return told.select(F.col("x.row_id").cast("bigint").alias("row_id"), F.col("x.label").alias("label"), "cost")


def isolated_runs(rows: DataFrame, keys: list[str], label: str, most_us: int, unknown: str, speakers: tuple[str, ...] | None = None, width: int = HOUR_US) -> DataFrame:
    """Single rows no longer than *most_us* between equal neighbours of another label become *unknown*.

    Taken from left to right in place: a row just made *unknown* is what the next one has before it. So
    whether a row changes depends on whether the one before did: always, never, likewise or the other
    way round. Since the last row that does not depend on it, the number of turnings decides. Only
    labels of *speakers* (None: any but *unknown*) change. Defined cases: the first and last row of a
    key never change; rows without label neither change nor are equal to any; ties of start are ordered
    by row_id.
    """
    x, at = F.col(label), ["row_id"]
    spoken = x.isin(*speakers) if speakers else x != unknown
    near = scanned(rows, keys, "start_us", at, width, lag={"_a": F.struct(x.alias("l"))}, lead={"_b": x}, total={"_at": F.lit(1).cast("bigint")})
    can = spoken & (x != unknown) & (F.col("end_us") - F.col("start_us") <= most_us) & F.col("_a").isNotNull()
    plain = F.coalesce(can & (F.col("_a.l") == F.col("_b")) & (F.col("_a.l") != x), F.lit(False))
    after = F.coalesce(can & (F.col("_b") == unknown), F.lit(False))  # where the row before was just made unknown
    near = near.withColumn("_c0", plain).withColumn("_c1", after).drop("_a", "_b")
    turned = scanned(near, keys, "start_us", at, width, total={"_n": F.when(F.col("_c0") & ~F.col("_c1"), 1).otherwise(0)})
    fixed = F.when(F.col("_c0") == F.col("_c1"), F.struct("_at", F.col("_c0").alias("v"), F.col("_n").alias("n")))
    marked = scanned(turned, keys, "start_us", at, width, top={"_z": fixed})
    odd = (F.pmod(F.col("_n") - F.coalesce("_z.n", F.lit(0)), F.lit(2)) == 1) != F.coalesce("_z.v", F.lit(False))
    return marked.withColumn(label, F.when(odd, unknown).otherwise(x)).select(*rows.columns)


def interleaving(rows: DataFrame, keys: list[str], label: str, first: str, second: str, width: int = HOUR_US) -> DataFrame:
    """Whether the labels of a recording change both ways: forth, back, both."""
    before_ = scanned(rows, keys, "start_us", ["row_id"], width, lag={"_p": F.col(label)})
    prev = F.col("_p")
    marked = before_.select(*keys, ((prev == first) & (F.col(label) == second)).alias("f"), ((prev == second) & (F.col(label) == first)).alias("b"))
    forth, back = F.coalesce(F.bool_or("f"), F.lit(False)), F.coalesce(F.bool_or("b"), F.lit(False))
    return marked.groupBy(*keys).agg(forth.alias("forth"), back.alias("back"), (forth & back).alias("interleaved"))


def counter_deltas(rows: DataFrame, keys: list[str], counter: str, at: str, width: int = 24 * HOUR_US) -> DataFrame:
    """Adds ``delta`` of a counter to its predecessor; null at the first row and where it was reset."""
    timed = rows.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    d = F.col(counter) - F.col("_p")
    return scanned(timed, keys, "_t", [counter], width, lag={"_p": F.col(counter)}).withColumn("delta", F.when(d >= 0, d)).select(*rows.columns, "delta")


def probe_discontinuities(rows: DataFrame, keys: list[str], vector: str, at: str, least: float = 0.2, width: int = 100_000) -> DataFrame:
    """Neighbouring probes whose cosine distance is *least* or more."""
    from chronoloom.operators.vectors import dot, unit

    near = scanned(rows.withColumn("_u", unit(F.col(vector))), keys, at, [], width, lag={"_v": F.col("_u")})
    return near.withColumn("distance", F.round(1 - dot(F.col("_u"), F.col("_v")), 6)).where(F.col("distance") >= least).drop("_u", "_v")
