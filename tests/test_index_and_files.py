import random
import struct
import wave

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import vectors as V
from chronoloom.operators.nested import rejected_reports
from chronoloom.sources.formats import WavSource, read_words


def vectors(spark, n=400, hot=0.4):
    rng = random.Random(5)
    rows = [(i, [1.0 + rng.gauss(0, 0.05), rng.gauss(0, 0.05), rng.gauss(0, 0.05), 0.1] if rng.random() < hot else [rng.gauss(0, 1) for _ in range(4)]) for i in range(n)]
    return spark.createDataFrame([*rows, (1000, None), (1001, rows[0][1])], "vec_id BIGINT, embedding ARRAY<DOUBLE>")


def test_index_is_exact_with_all_cells_and_near_with_some(spark, monkeypatch):
    """A hot cell is split into many pieces on both sides, and nothing is lost."""
    monkeypatch.setattr(V, "CELL_ROWS", 30)
    monkeypatch.setattr(V, "CELL_QUERIES", 40)
    monkeypatch.setattr(V, "SAMPLE_ROWS", 100)
    df = vectors(spark)
    exact = V.nearest_neighbours(df, df, 3, block_rows=150)
    every = V.indexed_neighbours(df, df, 3, probes=1_000)
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, exact.collect()))
    told = V.neighbour_recall(exact, V.indexed_neighbours(df, df, 3, probes=12)).first()
    assert told.n_queries == 401 and told.recall >= 0.9
    assert V.indexed_neighbours(df.where("false"), df, 3).count() == 0 and V.indexed_neighbours(df, df.where("false"), 3).count() == 0


def test_centroids_in_blocks(spark):
    df = vectors(spark).where("embedding IS NOT NULL")
    c = df.where("vec_id < 25").select(F.col("vec_id").alias("label"), V.unit(F.col("embedding")).alias("centroid"))
    whole = sorted(map(tuple, V.nearest_centroid(df, c, "embedding", "vec_id").collect()))
    assert whole == sorted(map(tuple, V.nearest_centroid(df, c, "embedding", "vec_id", most=4).collect())) and len(whole) == 401
    assert V.nearest_centroid(df, c.where("label = 3"), "embedding", "vec_id").where("margin IS NOT NULL").count() == 0


def test_words_have_a_closed_schema(spark, tmp_path):
    good = tmp_path / "good"
    good.write_text('{"recording_id": "r", "word_id": "w", "start_us": 1, "end_us": 2, "text": "x"}\n\n')
    assert [tuple(r) for r in read_words(spark, str(good)).collect()] == [("r", "w", 1, 2, "x", None, True, False)]
    for bad in ('{"word_id": "w", "colour": 1}', '{"word_id": '):
        path = tmp_path / f"bad{len(bad)}"
        path.write_text(bad)
        with pytest.raises(Exception):  # noqa: B017
            read_words(spark, str(path)).collect()


def test_rejected_reports(spark):
    deep = '{"a":' * 1500 + "1" + "}" * 1500
    rows = [(1, None), (2, ""), (3, '{"a": 1'), (4, '{"a": 1} x'), (5, '{"a": 1}'), (6, "[1, {}]"), (7, deep)]
    got = {r.row_id: r.reason for r in rejected_reports(spark.createDataFrame(rows, "row_id BIGINT, report STRING")).collect()}
    assert {k: v for k, v in got.items() if k < 7} == {1: "MISSING", 2: "UNREADABLE", 3: "UNREADABLE", 4: "UNREADABLE"} and got[7] in ("TOO_LARGE", "UNREADABLE")


def test_bucket_width_bounds_what_is_spread(spark):
    from chronoloom.operators.intervals import bucket_width, interval_join

    long = spark.createDataFrame([("r", 0, 86_400_000_000), ("r", 5, 10)], "recording STRING, start_us BIGINT, end_us BIGINT")
    short = spark.createDataFrame([("r", k * 1_000_000, k * 1_000_000 + 10) for k in range(50)], "recording STRING, start_us BIGINT, end_us BIGINT")
    assert bucket_width(long, short) >= 43_200_000_000 and bucket_width(short) == 60_000_000 and bucket_width(short.where("false")) == 60_000_000
    assert interval_join(long, short, ["recording"], width=None).count() == interval_join(long, short, ["recording"]).count() == 51


def test_two_clusters_of_a_hot_key(spark):
    rows = [("hot", i, [1.0, 0.01 * (i % 7)] if i % 3 else [0.01 * (i % 5), 1.0]) for i in range(2, 300)] + [("one", 900, [1.0, 0.0]), (None, 901, [0.0, 2.0]), (None, 902, [2.0, 0.0]), ("hot", 903, None)]
    df = spark.createDataFrame(rows, "rec STRING, id BIGINT, v ARRAY<DOUBLE>")
    got = {r.id: r.cluster for r in V.two_clusters(df, ["rec"], "v", "id").collect()}
    assert got == {**{i: 0 if i % 3 else 1 for i in range(2, 300)}, 900: 0, 901: 0, 902: 1}
    assert V.two_clusters(df.where("false"), ["rec"], "v", "id").count() == 0


def wav(path, samples):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"".join(struct.pack("<hh", x, x) for x in samples))


def test_small_wav_files_share_a_task_and_large_ones_are_split(spark, tmp_path):
    sizes = {"large": 5_000, "none": 0, **{f"s{k}": 1 + k % 80 for k in range(60)}}
    for name, n in sizes.items():
        wav(tmp_path / f"{name}.wav", range(n))
    (tmp_path / ".left").write_bytes(b"RIFF")
    spark.dataSource.register(WavSource)
    whole = sorted((f"{name}.wav", at, [x / 32768 for x in range(n)[at : at + 37]]) for name, n in sizes.items() for at in range(0, n, 37))
    for limit in (None, 1_000, 37 * 4, 101):
        read = spark.read.format("wav").option("path", f"file://{tmp_path}").option("framesPerChunk", 37)
        df = (read.option("bytesPerTask", limit) if limit else read).load()
        assert sorted((r.path.rpartition("/")[2], r.first_frame, list(r.samples)) for r in df.collect()) == whole
        assert df.rdd.getNumPartitions() == 1 if limit is None else df.rdd.getNumPartitions() >= 5_000 * 4 // limit
