"""Permissive loading of raw annotation lines, with the reason for every line that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the two line formats.
PRED_COLUMNS = ("audio_id", "rttm", "rttm_sha256", "quality_status")
QUALITY_STATUSES = ("PASS_HIGH", "PASS_STANDARD", "PASS_WITH_UNATTRIBUTED", "REVIEW_REQUIRED", "UNSUPPORTED")
FILE_ID = r"^[A-Za-z0-9][A-Za-z0-9_.\-]{0,127}\z"
PLAIN_DECIMAL = r"^[0-9]+(\.[0-9]+)?\z"
RTTM_FIELDS = 10
DAY_SECONDS = 86_400
READER_COLUMNS = 10_000

_BLANKS = " \t\r\n\f\u000b"
_CSV = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
_SCHEMA = ", ".join(f"{c} STRING" for c in PRED_COLUMNS) + ", corrupt STRING"


def seconds(text: Column) -> Column:
    """A plain decimal as exact whole part and 18 places, cut and not rounded; null beyond 18 whole digits."""
    whole = F.regexp_replace(F.split_part(text, F.lit("."), F.lit(1)), r"^0+(?=[0-9])", "")
    places = F.rpad(F.substring(F.split_part(text, F.lit("."), F.lit(2)), 1, 18), 18, "0")
    return F.when(F.length(whole) <= 18, F.concat(whole, F.lit("."), places).try_cast("decimal(36,18)"))


def _beyond(text: Column) -> Column:
    """Whether a plain decimal has non-zero digits after its 18th place."""
    return F.substring(F.split_part(text, F.lit("."), F.lit(2)), 19, 1 << 30).rlike("[1-9]")


def rttm_reason(fields: Column) -> Column:
    """COLUMN_COUNT, VALUE or null of an RTTM line's fields."""
    start, length = F.get(fields, F.lit(3)), F.get(fields, F.lit(4))
    end = seconds(start) + seconds(length)
    fits = (end < DAY_SECONDS) | ((end == DAY_SECONDS) & ~_beyond(start) & ~_beyond(length))
    good = (
        (F.upper(F.get(fields, F.lit(0))) == "SPEAKER")
        & F.get(fields, F.lit(1)).rlike(FILE_ID)
        & start.rlike(PLAIN_DECIMAL)
        & length.rlike(PLAIN_DECIMAL)
        & length.rlike("[1-9]")
        & F.coalesce(fits, F.lit(False))
    )
    return F.when(F.size(fields) != RTTM_FIELDS, "COLUMN_COUNT").when(~F.coalesce(good, F.lit(False)), "VALUE")


def well_quoted(pieces: Column) -> Column:
    """Whether each comma-separated field is free of quotes or wholly enclosed, inner ones doubled.

    *pieces* is the line split at its quotes, so pieces at odd places (from 0) stand inside quotes.
    Those at even places are what separates the quoted parts: nothing at either end of the line or
    between the two quotes of a doubled one, else text that begins and ends with a comma. Linear in
    the line, where one expression for the whole would backtrack.
    """
    n = F.size(pieces)
    outside = F.filter(
        F.transform(pieces, lambda x, i: F.when(
            (i % 2 == 1) | (x == "") | (F.when(i == 0, F.lit(True)).otherwise(x.startswith(",")) & F.when(i == n - 1, F.lit(True)).otherwise(x.endswith(","))),
            F.lit(None).cast("int"),
        ).otherwise(F.lit(1))),
        lambda bad: bad.isNotNull(),
    )
    return (n % 2 == 1) & (F.size(outside) == 0)


def comma_fields(pieces: Column) -> Column:
    """Number of fields of a well quoted line: one more than its commas outside quotes."""
    outside = F.array_join(F.filter(pieces, lambda x, i: i % 2 == 0), "")
    return F.length(outside) - F.length(F.translate(outside, ",", "")) + 1


def classify_lines(lines: DataFrame, raw: str = "raw", fmt: str = "fmt") -> DataFrame:
    """Read every line permissively under its format's explicit schema and say why it fails.

    Adds ``kind`` (``skip``, ``load``, ``fail``), ``reason`` (COLUMN_COUNT, QUOTING, VALUE or null),
    the split ``fields`` of rttm lines and ``parsed``, the row of a pred line as the permissive CSV
    reader gives it under the explicit schema, the raw text kept in ``corrupt`` where it is malformed.
    The reader alone accepts stray quotes and surplus columns, so every row is classified again by
    count, quoting and casts. A projection only: no shuffle, no Python.

    Defined cases: null lines, blank lines, lines that begin with ``#``, the pred header and lines of
    an unknown or null format are skipped; very long lines are read whole; columns of *lines* are
    kept, those named kind, reason, fields or parsed are replaced.
    """
    text = F.col(raw)
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    fields = F.when(F.col(fmt) == "rttm", F.split(F.trim(text, F.lit(" \t")), "[ \t]+"))
    pieces = F.split(text, '"', -1)
    head = ",".join(PRED_COLUMNS)
    # the CSV reader holds 20,480 columns at most; lines beyond the counted bound fail by count or quoting unread.
    # Commas inside quotes part no columns, but only where the quoting is sound
    commas = F.length(text) - F.length(F.translate(text, ",", ""))
    readable = (commas < READER_COLUMNS) | (well_quoted(pieces) & (comma_fields(pieces) < READER_COLUMNS))
    parsed = F.when(F.col(fmt) == "pred", F.from_csv(F.when(readable, text), _SCHEMA, _CSV))
    p = F.col("parsed")
    values = (
        F.coalesce(p["audio_id"].rlike(FILE_ID), F.lit(False))
        & (F.coalesce(p["rttm"], F.lit("")) != "")
        & F.coalesce(p["rttm_sha256"].rlike(r"^[0-9A-Fa-f]{64}\z"), F.lit(False))
        & F.coalesce(p["quality_status"].isin(*QUALITY_STATUSES), F.lit(False))
    )
    pred_reason = F.when(~well_quoted(pieces), "QUOTING").when(comma_fields(pieces) != len(PRED_COLUMNS), "COLUMN_COUNT").when(~values, "VALUE")
    skip = (bare == "") | bare.startswith("#") | ((F.col(fmt) == "pred") & (bare == head)) | ~F.coalesce(F.col(fmt).isin("rttm", "pred"), F.lit(False))
    return (
        lines.withColumn("fields", fields)
        .withColumn("parsed", parsed)
        .withColumn("reason", F.when(skip, F.lit(None)).when(F.col(fmt) == "rttm", rttm_reason(F.col("fields"))).otherwise(pred_reason))
        .withColumn("kind", F.when(skip, "skip").when(F.col("reason").isNull(), "load").otherwise("fail"))
    )


def turns_loaded(classified: DataFrame, keep: list[str]) -> DataFrame:
    """The valid rttm lines as turns, in whole microseconds rounded half to even."""
    us = lambda c: F.bround(c * F.lit(1_000_000).cast("decimal(8,0)")).cast("bigint")
    f = F.col("fields")
    start, length = seconds(f[3]), seconds(f[4])
    return classified.where("kind = 'load' AND fmt = 'rttm'").select(*keep, f[1].alias("file_id"), f[2].alias("channel"), f[7].alias("speaker_id"), us(start).alias("start_us"), us(start + length).alias("end_us"))


def predictions_loaded(classified: DataFrame, keep: list[str]) -> DataFrame:
    """The valid pred lines as prediction rows."""
    return classified.where("kind = 'load' AND fmt = 'pred'").select(*keep, *[F.col("parsed")[c].alias(c) for c in PRED_COLUMNS])


def failure_report(classified: DataFrame) -> DataFrame:
    """Lines per format, batch and outcome."""
    return classified.groupBy("fmt", "batch", "kind", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n_lines"))
