import random

from test_timelines import machine

from chronoloom.streaming.sessions import drained, streaming_hysteresis

FRAMES = "recording BIGINT, start_us BIGINT, end_us BIGINT, p DOUBLE"


def test_open_regions_are_given_when_drained(spark, tmp_path):
    rng = random.Random(11)
    rows = {k: [(i * 32_000, (i + 1) * 32_000, rng.choice([0.1, 0.2, 0.4, 0.5, 0.9])) for i in range(rng.randrange(1, 60))] for k in range(20)}
    expected = sorted((k, *r) for k, fs in rows.items() for r in machine(fs, 0.5, 0.35, 100_000))
    # the frames come in two batches, so regions also stay open from one to the next
    for n, part in enumerate((slice(0, 20), slice(20, None))):
        spark.createDataFrame([(k, *f) for k, fs in rows.items() for f in fs[part]], FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "frames" / f"n={n}"))
    assert any(fs[-1][2] >= 0.5 for fs in rows.values())
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "frames" / "n=*"))
    got = drained(streaming_hysteresis(stream, "recording"))
    assert sorted((r.recording, r.start_us, r.end_us) for r in got.collect()) == expected


def test_nothing_comes(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert drained(streaming_hysteresis(spark.readStream.schema(FRAMES).parquet(str(tmp_path / "none")), "recording")).count() == 0
