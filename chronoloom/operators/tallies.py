"""Small tables over evidence, manifests and submissions: counts, gates, parity, latest states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.ids import plain_form
from chronoloom.functions.scalars import threshold_outcome
from chronoloom.operators.blocked import counted_rank
from chronoloom.operators.intervals import duration_class, interval_join

SHA256 = r"^[0-9a-f]{64}\z"


def loud_runs(samples: DataFrame, keys: list[str], size: int, width: int = 100_000) -> DataFrame:
    """Runs of windows of *size* samples (keys, k, x) at or over the key's mean energy: first_window, last_window, n_windows."""
    f = samples.groupBy(*keys, F.floor(F.col("k") / size).alias("w")).agg(F.avg(F.col("x") * F.col("x")).alias("_e"))
    loud = f.join(f.groupBy(*keys).agg(F.avg("_e").alias("_m")), keys).where("_e >= _m")
    runs = counted_rank(loud, keys, "w", [], width, "_n").withColumn("_g", F.col("w") - F.col("_n"))
    return runs.groupBy(*keys, "_g").agg(F.min("w").alias("first_window"), F.max("w").alias("last_window"), F.count("*").alias("n_windows")).drop("_g")


def core_share(frames: DataFrame, regions: DataFrame, keys: list[str], width: int = 640_000) -> DataFrame:
    """Frames that lie in a core region, cut at its edges: n_core, core_us per key."""
    both = interval_join(frames, regions, keys, width=width)
    cut = F.least("end_us", "other_end_us") - F.greatest("start_us", "other_start_us")
    return both.groupBy(*keys, "start_us").agg(F.sum(cut).alias("_c")).groupBy(*keys).agg(F.count("*").alias("n_core"), F.sum("_c").alias("core_us"))


def span_counts(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans, their time and the longest, per key and label."""
    size = F.col("end_us") - F.col("start_us")
    return spans.groupBy(*keys, "label").agg(F.count("*").alias("n_spans"), F.sum(size).alias("total_us"), F.max(size).alias("longest_us"))


def label_parity(old: DataFrame, new: DataFrame, row: str = "row_id") -> DataFrame:
    """Labels of the same rows in two versions (*row*, label, start_us, end_us of the new): rows and time by both."""
    j = old.select(row, F.col("label").alias("before")).join(new.select(row, F.col("label").alias("after"), (F.col("end_us") - F.col("start_us")).alias("_n")), row)
    return j.groupBy("before", "after").agg(F.count("*").alias("n_rows"), F.sum("_n").alias("total_us"))


def speaker_order(spans: DataFrame, keys: list[str], unknown: str = "UNKNOWN") -> DataFrame:
    """Labels of a key numbered by their first start, ties by label; a key's labels alone meet."""
    first = spans.where(F.col("label") != unknown).groupBy(*keys, "label").agg(F.min("start_us").alias("first_us"))
    rank = first.join(first.select(*keys, F.struct(F.col("first_us").alias("f"), F.col("label").alias("l")).alias("_o")), keys).where(F.col("_o") <= F.struct(F.col("first_us").alias("f"), F.col("label").alias("l")))
    return rank.groupBy(*keys, "label", "first_us").agg(F.count("*").cast("int").alias("speaker_no"))


def split_leakage(rows: DataFrame, split: str, bindings: dict[str, str]) -> DataFrame:
    """Keys that stand in more than one split: kind, key, n_splits, n_rows.

    *bindings* names a column a kind, a text or an array of texts. Ids and splits count in plain form;
    null and blank ones bind nothing.
    """
    def entries(kind: str, c: str) -> Column:
        listed = F.coalesce(c, F.array().cast("array<string>")) if rows.schema[c].dataType.typeName() == "array" else F.array(c)
        return F.transform(listed, lambda x: F.struct(F.lit(kind).alias("kind"), plain_form(x).alias("key")))

    long = rows.select(plain_form(F.col(split)).alias("_split"), F.explode(F.flatten(F.array(*[entries(k, c) for k, c in bindings.items()]))).alias("e"))
    keys = long.select("_split", "e.*").where("key IS NOT NULL AND _split IS NOT NULL")
    return keys.groupBy("kind", "key").agg(F.countDistinct("_split").alias("n_splits"), F.count("*").alias("n_rows")).where("n_splits > 1")


def first_submissions(rows: DataFrame, keys: list[str], at: str, row: str = "row_id") -> DataFrame:
    """Submissions by key: the first row counts, later ones of the key are repeats; null keys are left out."""
    held = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    return held.groupBy(*keys).agg(F.min_by(row, F.struct(at, row)).alias("first_row"), F.count("*").alias("n_submitted"))


def latest_values(rows: DataFrame, key: str, value: str, at: str, row: str = "row_id") -> DataFrame:
    """The value of the last row of each key in time, ties to the greater row; null values are blank."""
    held = rows.where(F.col(key).isNotNull())
    return held.groupBy(key).agg(F.max_by(F.coalesce(value, F.lit("")), F.struct(at, row)).alias("status"), F.count("*").alias("n_versions"))


def summary_mode(status: Column) -> Column:
    """How a summary may name speakers at a quality status; unknown ones give none."""
    return F.when(status.isin("PASS_HIGH", "PASS_STANDARD"), "SPEAKERS").when(status == "PASS_WITH_UNATTRIBUTED", "PARTIAL").when(status == "REVIEW_REQUIRED", "NEUTRAL").otherwise("NONE")


def manifest_issues(rows: DataFrame, row: str = "row_id") -> DataFrame:
    """Rule codes of manifest rows, one row each: AUDIO_ID, AUDIO_HASH, SAMPLE_RATE, SPEAKER_COUNT, SPEAKER_GROUPS, CONDITIONS."""
    c = F.col
    rules = [
        ("AUDIO_ID", plain_form(c("audio_id")).isNull()), ("AUDIO_HASH", ~F.coalesce(c("audio_sha256").rlike(SHA256), F.lit(False))), ("SAMPLE_RATE", ~F.coalesce(c("sample_rate_hz").isin(8000, 16000), F.lit(False))),
        ("SPEAKER_COUNT", F.coalesce(c("speaker_count"), F.lit(0)) < 1), ("SPEAKER_GROUPS", c("speaker_group_ids").isNull() | F.coalesce(F.array_size("speaker_group_ids") != c("speaker_count"), F.lit(False))), ("CONDITIONS", c("conditions").isNull()),
    ]
    return rows.select(row, F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))).alias("issue"))


def value_counts(rows: DataFrame, dims: dict[str, Column], listed: dict[str, str] | None = None) -> DataFrame:
    """Rows per dimension and value in one grouping; *listed* dimensions are arrays. Null values are blank."""
    entry = lambda dim, v: F.struct(F.lit(dim).alias("dim"), v.cast("string").alias("value"))
    many = [_entries(dim, c) for dim, c in (listed or {}).items()]
    long = rows.select(F.explode(F.concat(F.array(*[entry(d, v) for d, v in dims.items()]), *many)).alias("e"))
    return long.groupBy("e.dim", F.coalesce("e.value", F.lit("")).alias("value")).agg(F.count("*").alias("n_rows"))


def _entries(dim: str, column: str) -> Column:
    return F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.struct(F.lit(dim).alias("dim"), x.cast("string").alias("value")))


def averaged_pairs(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Half the rate: the mean of samples 2k and 2k + 1, a last one alone."""
    return samples.groupBy(*keys, F.floor(F.col("k") / 2).alias("k")).agg(F.round(F.avg("x"), 9).alias("x"))


def speed_summary(runs: DataFrame, kind: str, rtf: str) -> DataFrame:
    """Runs, those with a real-time factor, its maximum, mean and 95th percentile per kind of run."""
    return runs.groupBy(kind).agg(F.count("*").alias("n_runs"), F.count(rtf).alias("n_rtf"), F.round(F.max(rtf), 9).alias("max_rtf"), F.round(F.avg(rtf), 9).alias("mean_rtf"), F.round(F.percentile(rtf, F.lit(0.95)), 9).alias("p95_rtf"))


def gates(rows: DataFrame, row: str, limits: dict[str, tuple[Column, float, bool]]) -> DataFrame:
    """Outcome of each gate: name to (value, threshold, whether higher is better)."""
    return rows.select(row, *[threshold_outcome(v, F.lit(t), F.lit(up)).alias(name) for name, (v, t, up) in limits.items()])


def lattice_parity(rows: DataFrame, keys: list[str], vector: str, steps: int = 127, least: float = 0.99) -> DataFrame:
    """Vectors against their lattice of *steps*: n, median and worst cosine, whether the worst is *least* or more."""
    from chronoloom.operators.vectors import dot

    a, b = F.col("_a"), F.col("_b")
    e = rows.select(*keys, F.col(vector).cast("array<double>").alias("_a")).withColumn("_b", F.transform("_a", lambda x: F.bround(x * steps) / steps))
    cos = F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))
    return e.select(*keys, cos.alias("_c")).groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.percentile("_c", F.lit(0.5)), 6).alias("median_cosine"), F.round(F.min("_c"), 6).alias("worst_cosine"), (F.min("_c") >= least).alias("passed"))


def anchor_evidence(pieces: DataFrame, quality: DataFrame, row: str = "row_id", most_us: int = 5_000_000, floor: float = 0.000001) -> DataFrame:
    """Pieces (keys, start_us, end_us) with the quality of their vector: class, whether embedded, evidence, weight.

    *quality* (*row*, q) has a row for each piece's origin with a vector; others are DEFERRED. The weight
    is the quality, *floor* at least, times the length, *most_us* at most.
    """
    size = F.col("end_us") - F.col("start_us")
    p = pieces.join(quality.select(row, F.col("q").cast("double").alias("_q")), row, "left").withColumn("kind", duration_class(size))
    weight = F.round(F.greatest(F.lit(floor), F.coalesce("_q", F.lit(floor))) * F.least(size, F.lit(most_us)), 6)
    return p.select(*pieces.columns, "kind", F.col("_q").isNotNull().alias("embedded"), F.when(F.col("_q").isNull(), "DEFERRED").otherwise(F.col("kind")).alias("evidence"), weight.alias("weight"))


def raised_gain(stats: DataFrame, target: float, ceiling: float, most: float = 4.0) -> DataFrame:
    """Adds gain and reason to pcm stats (n, squares, peak): towards *target* mean square root, never lowering,
    never beyond *most* and never lifting the peak over *ceiling*."""
    want, room = F.lit(target) / F.sqrt(F.col("squares") / F.col("n")), F.lit(ceiling) / F.col("peak")
    return stats.select("*", F.round(F.greatest(F.lit(1.0), F.least(F.lit(most), want, room)), 9).alias("gain"), F.when(want <= 1, "LOUD").when(room < F.least(F.lit(most), want), "PEAK_LIMITED").otherwise("RAISED").alias("reason"))
