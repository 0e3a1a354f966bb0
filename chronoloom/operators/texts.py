"""Text comparison: normalisation, character and word error rates, edit operations, speaker texts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized(text: Column, form: str = "NFC", punctuation: bool = False) -> Column:
    """Unicode normal form, then white space folded and, unless kept, punctuation removed."""
    @F.pandas_udf("string")
    def unicode_form(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize(form, t))

    out = unicode_form(text)
    if not punctuation:
        out = F.regexp_replace(out, r"\p{P}+", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def error_rate(distance: Column, size: Column) -> Column:
    """distance / size; without a reference 0 where nothing was said and 1 where something was."""
    return F.when(size > 0, F.round(distance / size.cast("double"), 9)).when(distance > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def character_errors(rows: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Adds char_distance, ref_chars and cer; null texts count as empty."""
    r, h = F.coalesce(ref, F.lit("")), F.coalesce(hyp, F.lit(""))
    d = rows.withColumn("char_distance", F.levenshtein(r, h).cast("bigint")).withColumn("ref_chars", F.length(r).cast("bigint"))
    return d.withColumn("cer", error_rate(F.col("char_distance"), F.col("ref_chars")))


def edit_counts(a: list, b: list) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of a cheapest alignment; ties: substitute, delete, insert."""
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        rows[i][0] = i
    rows[0] = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, here = rows[i - 1], rows[i]
        for j, y in enumerate(b, 1):
            here[j] = min(above[j - 1] + (x != y), above[j] + 1, here[j - 1] + 1)
    i, j, sub, gone, added = len(a), len(b), 0, 0, 0
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            sub += a[i - 1] != b[j - 1]
            i, j = i - 1, j - 1
        elif i and rows[i][j] == rows[i - 1][j] + 1:
            gone, i = gone + 1, i - 1
        else:
            added, j = added + 1, j - 1
    return sub, gone, added


def word_errors(rows: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Adds substitutions, deletions, insertions, ref_words and wer, by Arrow batches."""
    @F.pandas_udf("substitutions BIGINT, deletions BIGINT, insertions BIGINT, ref_words BIGINT")
    def count(r: pd.Series, h: pd.Series) -> pd.DataFrame:
        pairs = [((x or "").split(), (y or "").split()) for x, y in zip(r, h, strict=True)]
        return pd.DataFrame([(*edit_counts(x, y), len(x)) for x, y in pairs], columns=["substitutions", "deletions", "insertions", "ref_words"])

    got = rows.withColumn("_e", count(F.col(ref), F.col(hyp)))
    flat = got.select(*rows.columns, "_e.*")
    return flat.withColumn("wer", error_rate(F.col("substitutions") + F.col("deletions") + F.col("insertions"), F.col("ref_words")))


def speaker_texts(words: DataFrame, keys: list[str], label: str, order: list[str], text: str = "text") -> DataFrame:
    """The words of each speaker in order, joined by blanks."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return words.groupBy(*keys, label).agg(F.array_join(F.transform(listed, lambda x: x["_t"]), " ").alias("text"), F.count("*").alias("n_words"))


def cheapest_assignment(cost: list[list[int]]) -> int:
    """Least total of a square cost matrix over all one-to-one assignments, in cubic time.

    Rows are added one by one along a shortest augmenting path, with prices on rows and columns.
    """
    n = len(cost)
    row_price, col_price, owner = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        slack, came, done = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while owner[at]:
            done[at] = True
            r, step, to = owner[at], float("inf"), 0
            for c in range(1, n + 1):
                if not done[c]:
                    d = cost[r - 1][c - 1] - row_price[r] - col_price[c]
                    if d < slack[c]:
                        slack[c], came[c] = d, at
                    if slack[c] < step:
                        step, to = slack[c], c
            for c in range(n + 1):
                if done[c]:
                    row_price[owner[c]] += step
                    col_price[c] -= step
                else:
                    slack[c] -= step
            at = to
        while at:
            owner[at], at = owner[came[at]], came[at]
    return sum(cost[owner[c] - 1][c - 1] for c in range(1, n + 1))


def assigned_word_errors(rows: DataFrame, refs: str, hyps: str) -> DataFrame:
    """Adds errors, ref_words and rate: fewest word errors over all assignments of speakers.

    *refs* and *hyps* are arrays of one text a speaker, of any number; the shorter is filled up with
    empty texts. The assignment is solved as such, not by trying all.
    """
    @F.pandas_udf("errors BIGINT, ref_words BIGINT")
    def count(r: pd.Series, h: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(r, h, strict=True):
            x, y = [(t or "").split() for t in (a if a is not None else [])], [(t or "").split() for t in (b if b is not None else [])]
            x, y = x + [[]] * (len(y) - len(x)), y + [[]] * (len(x) - len(y))
            cost = [[sum(edit_counts(p, q)) for q in y] for p in x]
            out.append((cheapest_assignment(cost), sum(map(len, x))))
        return pd.DataFrame(out, columns=["errors", "ref_words"])

    got = rows.withColumn("_e", count(F.col(refs), F.col(hyps))).select(*rows.columns, "_e.*")
    return got.withColumn("rate", error_rate(F.col("errors"), F.col("ref_words")))
