import random
import struct

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import intervals as I
from chronoloom.operators import scoring as S
from chronoloom.operators import selection as P
from chronoloom.operators import sequences as Q
from chronoloom.operators.texts import edit_counts
from chronoloom.operators.vectors import propagated_labels, two_clusters
from chronoloom.sources.formats import WavSource, read_rttm, read_uem, rttm_lines, uem_lines
from chronoloom.streaming.sessions import drained, streaming_hysteresis

SPANS = "recording STRING, label STRING, start_us BIGINT, end_us BIGINT"


def scores(spark, ref, hyp, scope):
    mk = lambda rows: spark.createDataFrame([("r", *x) for x in rows], SPANS)
    cells = S.two_label_cells(mk(ref), mk(hyp), mk([("", *x) for x in scope]), ["recording"])
    return S.recording_scores(S.cell_sums(cells, ["recording"]), ["recording"]).first()


def test_error_rate_example(spark):
    s = 1_000_000
    r = scores(spark, [("REF_00", 0, 4 * s), ("REF_01", 4 * s, 7 * s)], [("A", 0, 3 * s), ("B", 5 * s, 6 * s), ("A", 4 * s, 5 * s), ("B", 7 * s, 8 * s)], [(0, 8 * s)])
    assert (r.ref_us, r.miss_us, r.fa_us, r.conf_us, r.swapped) == (7 * s, 2 * s, s, s, False)
    assert r.der == round(4 / 7, 9)


def test_one_label_covers_both(spark):
    r = scores(spark, [("REF_00", 0, 10), ("REF_01", 10, 20)], [("A", 0, 20)], [(0, 20)])
    assert r.swapped is False and r.conf_us == 10 and r.jer == 0.75


def best_match(ref, hyp, collar):
    best = 0
    used, count = set(), 0
    for r in sorted(ref):
        for k, h in enumerate(sorted(hyp)):
            if k not in used and abs(h - r) <= collar:
                used.add(k)
                count += 1
                break
    return max(best, count)


def test_boundary_matches(spark):
    rng = random.Random(3)
    rows = [(str(k), [rng.randrange(300) for _ in range(rng.randrange(20))], [rng.randrange(300) for _ in range(rng.randrange(20))]) for k in range(40)]
    long = lambda side: spark.createDataFrame([(k, t) for k, *both in rows for t in both[side]], "recording STRING, at BIGINT")
    got = {r.recording: (r.tp, r.fp, r.fn) for r in S.boundary_matches(long(0), long(1), ["recording"], "at", 7).collect()}
    for k, ref, hyp in rows:
        if ref or hyp:
            tp = best_match(ref, hyp, 7)
            assert got[k] == (tp, len(hyp) - tp, len(ref) - tp)


def machine(frames, on, off, silence):
    out, opened, quiet, last = [], None, None, None
    for s, e, p in frames:
        if opened is None:
            if p >= on:
                opened, quiet = s, None
        elif p >= off:
            quiet = None
        else:
            quiet = s if quiet is None else quiet
            if s - quiet >= silence:
                out.append((opened, quiet))
                opened = None
        last = e
    if opened is not None:
        out.append((opened, quiet if quiet is not None else last))
    return out


def test_hysteresis_batch_and_stream(spark, tmp_path):
    rng = random.Random(2)
    rows = {k: [(i * 32_000, (i + 1) * 32_000, rng.choice([0.1, 0.2, 0.3, 0.4, 0.5, 0.9])) for i in range(rng.randrange(1, 120))] for k in range(12)}
    df = spark.createDataFrame([(k, *f) for k, fs in rows.items() for f in fs], "recording BIGINT, start_us BIGINT, end_us BIGINT, p DOUBLE")
    expected = sorted((k, *r) for k, fs in rows.items() for r in machine(fs, 0.5, 0.35, 100_000))
    assert sorted((r.recording, r.start_us, r.end_us) for r in Q.hysteresis_regions(df, ["recording"]).collect()) == expected
    # a loud frame far after the end closes what is open, as the end of the batch does
    ends = spark.createDataFrame([(k, fs[-1][1] + 10**9, fs[-1][1] + 10**9 + 32_000, 0.0) for k, fs in rows.items()], df.schema)
    df.union(ends).coalesce(1).write.parquet(str(tmp_path / "frames"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "frames"))
    assert sorted((r.recording, r.start_us, r.end_us) for r in drained(streaming_hysteresis(stream, "recording")).collect()) == expected


def test_peaks(spark):
    rng = random.Random(4)
    rows = [(k, i * 100, rng.randrange(10)) for k in range(5) for i in range(60)]
    df = spark.createDataFrame(rows, "recording BIGINT, start_us BIGINT, s INT")
    got = sorted(map(tuple, Q.separated_peaks(df, ["recording"], "s", 5, 350).select("recording", "at_us").collect()))
    expected = []
    for k in range(5):
        v = [s for r, _, s in rows if r == k]
        peaks = [(-v[i], i * 100) for i in range(60) if v[i] >= 5 and (i == 0 or v[i] >= v[i - 1]) and (i == 59 or v[i] > v[i + 1])]
        kept = []
        for _, t in sorted(peaks):
            if all(abs(t - x) >= 350 for x in kept):
                kept.append(t)
        expected += [(k, t) for t in kept]
    assert got == sorted(expected)


def test_decoding_is_cheapest(spark):
    from itertools import product

    rng = random.Random(7)
    rows = [(k, i, i * 100, i * 100 + 90, rng.randrange(4) / 10, rng.randrange(10) / 10, rng.randrange(10) / 10) for k in range(6) for i in range(6)]
    df = spark.createDataFrame(rows, "recording BIGINT, row_id BIGINT, start_us BIGINT, end_us BIGINT, switch_cost DOUBLE, a DOUBLE, b DOUBLE")
    got = Q.decoded_labels(df, ["recording"], {"A": F.col("a"), "B": F.col("b")}).groupBy().agg(F.sum(F.col("cost") / 6)).first()[0]
    total = 0
    for k in range(6):
        own = [r for r in rows if r[0] == k]
        total += min(sum(r[5 + c] for r, c in zip(own, path, strict=True)) + sum(own[t][4] for t in range(1, 6) if path[t] != path[t - 1]) for path in product((0, 1), repeat=6))
    assert got == pytest.approx(total)


def test_knapsack(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.randrange(1, 9), float(rng.randrange(9))) for k in range(6) for i in range(9)]
    got = {r.k: r.g for r in P.best_within(spark.createDataFrame(rows, "k BIGINT, id BIGINT, w BIGINT, g DOUBLE"), ["k"], "w", "g", "id", 0.4).join(spark.createDataFrame([(k, i) for k, i, *_ in rows if k == 0], "k BIGINT, id BIGINT"), "id").groupBy("k").agg(F.sum("g").alias("g")).collect()}
    assert got
    for k in range(1):
        own = [(w, g) for kk, _, w, g in rows if kk == k]
        capacity = int(sum(w for w, _ in own) * 0.4)
        best = max(sum(own[i][1] for i in range(9) if m >> i & 1) for m in range(512) if sum(own[i][0] for i in range(9) if m >> i & 1) <= capacity)
        one = P.best_within(spark.createDataFrame([r for r in rows if r[0] == k], "k BIGINT, id BIGINT, w BIGINT, g DOUBLE"), ["k"], "w", "g", "id", 0.4).agg(F.sum("g"), F.sum("w")).first()
        assert one[0] == best and one[1] <= capacity


def test_edit_counts():
    assert edit_counts(list("kitten"), list("sitting")) == (2, 0, 1)
    assert edit_counts([], ["a"]) == (0, 0, 1) and edit_counts(["a", "b"], []) == (0, 2, 0) and edit_counts([], []) == (0, 0, 0)


def test_propagation_and_clusters(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (4, 5, 2.0)], "a BIGINT, b BIGINT, weight DOUBLE")
    got = {r.id: r.label for r in propagated_labels(edges, spark.createDataFrame([(1, "x"), (4, "y")], "id BIGINT, label STRING")).collect()}
    assert got == {1: "x", 2: "x", 3: "x", 4: "y", 5: "y"}
    v = spark.createDataFrame([("r", i, [1.0, 0.01 * i] if i % 2 else [0.01 * i, 1.0]) for i in range(1, 11)], "rec STRING, id BIGINT, v ARRAY<DOUBLE>")
    clusters = {r.id: r.cluster for r in two_clusters(v, ["rec"], "v", "id").collect()}
    assert clusters == {i: 0 if i % 2 else 1 for i in range(1, 11)}


def test_intervals_small(spark):
    df = spark.createDataFrame([("r", 0, 10), ("r", 14, 20)], "recording STRING, start_us BIGINT, end_us BIGINT")
    p = sorted(map(tuple, I.padded(df, ["recording"], 5, F.lit(0), F.lit(22)).select("padded_start_us", "padded_end_us").collect()))
    assert p == [(0, 12), (12, 22)]
    assert [tuple(r) for r in I.merge_within(df, ["recording"], 4).select("start_us", "end_us", "n_rows").collect()] == [(0, 20, 2)]
    assert I.merge_within(df, ["recording"], 3).count() == 2
    assert I.interval_join(df, df, ["recording"], width=3).count() == 2
    assert I.interval_join(df, df.where("start_us = 0"), ["recording"], "left_anti", 3).count() == 1


def test_files_round_trip(spark, tmp_path):
    turns = spark.createDataFrame([("f", "1", "S", 1_500_000, 2_000_001), ("g", "2", "T", 0, 86_399_999_999)], "file_id STRING, channel STRING, speaker_id STRING, start_us BIGINT, end_us BIGINT")
    rttm_lines(turns).write.text(str(tmp_path / "r"))
    assert sorted(map(tuple, read_rttm(spark, str(tmp_path / "r")).collect())) == sorted(map(tuple, turns.collect()))
    uem_lines(turns).write.text(str(tmp_path / "u"))
    assert sorted(map(tuple, read_uem(spark, str(tmp_path / "u")).collect())) == sorted(map(tuple, turns.drop("speaker_id").collect()))


def test_wav(spark, tmp_path):
    samples = [0, 1000, -1000, 32767, -32768, 5]
    data = struct.pack("<6h", *samples)
    body = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"junk" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data
    path = tmp_path / "a.wav"
    path.write_bytes(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)
    spark.dataSource.register(WavSource)
    rows = spark.read.format("wav").option("path", str(path)).option("framesPerChunk", 4).load().orderBy("first_frame").collect()
    assert [r.first_frame for r in rows] == [0, 4] and rows[0].sample_rate_hz == 8000
    assert [round(x * 32768) for r in rows for x in r.samples] == samples
