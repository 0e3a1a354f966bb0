import random

from pyspark.sql import functions as F

from chronoloom.functions.ids import plain_form
from chronoloom.functions.scalars import half_away_mean, half_up_div, label_kind, softmax
from chronoloom.operators.blocked import counted_rank
from chronoloom.operators.evidence import as_of_next, change_points, flexible_us, scheduled, tree_digest, transcript_turns
from chronoloom.operators.scoring import bootstrap_ci
from chronoloom.operators.selection import evenly_ranked, first_best
from chronoloom.operators.vectors import nearest_neighbours


def test_plain_form(spark):
    cases = {"aud-0012": "aud12", "(AUD 12)": "aud12", "aud-００12": "aud12", "a-0": "a0", "00": "0", "--": None, "": None, None: None, "Straße_7": "straße7", "x": "x"}
    df = spark.createDataFrame([(k,) for k in cases], "k STRING").select("k", plain_form(F.col("k")).alias("p"))
    assert {r.k: r.p for r in df.collect()} == cases


def test_scalars(spark):
    r = spark.range(1).select(half_up_div(F.lit(5), F.lit(2)).alias("a"), half_up_div(F.lit(-5), F.lit(2)).alias("b"), half_away_mean(F.lit(-1), F.lit(-2)).alias("c"), half_away_mean(F.lit(1), F.lit(2)).alias("d"), label_kind(F.lit(" unknown")).alias("e"), F.round(softmax(F.array(F.lit(0.0), F.lit(0.0)))[0], 6).alias("f")).first()
    assert tuple(r) == (3, -2, -2, 2, "unknown", 0.5)


def test_counted_rank_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", None]), rng.choice([None, *range(-50, 50)]), i) for i in range(300)]
    got = counted_rank(spark.createDataFrame(rows, "k STRING, x INT, id INT"), ["k"], "x", [F.col("id")], 7).collect()
    for key in ("a", None):
        order = sorted(((-(1 << 62) if x is None else x), i) for k, x, i in rows if k == key)
        assert [i for _, i in order] == [r.id for r in sorted((r for r in got if r.k == key), key=lambda r: r["rank"])]


def test_changes(spark):
    rows = [("r", "A", 0, 10), ("r", "B", 10, 20), ("r", "A", 20, 25), ("r", "A", 30, 40), ("r", "B", 32, 34), ("r", "B", 50, 60)]
    got = change_points(spark.createDataFrame(rows, "recording STRING, label STRING, start_us BIGINT, end_us BIGINT"), ["recording"])
    assert sorted((r.at_us, r.label) for r in got.collect()) == [(10, "B"), (20, "A"), (32, "B"), (50, "B")]


def test_as_of(spark):
    points = spark.createDataFrame([("r", 5), ("r", 10), ("r", 99)], "recording STRING, at BIGINT")
    turns = spark.createDataFrame([("r", 1, "A", 0, 10), ("r", 2, "B", 3, 12)], "recording STRING, row_id BIGINT, label STRING, start_us BIGINT, end_us BIGINT")
    got = {r["at"]: r.next_row for r in as_of_next(points, turns, ["recording"], "at").collect()}
    assert got == {5: 1, 10: 2, 99: None}


def test_schedule_is_largest(spark):
    rng = random.Random(4)
    rows = [(k, i, s := rng.randrange(60), s + rng.randrange(1, 15)) for k in range(4) for i in range(k * 9, k * 9 + 9)]
    kept = {r.row_id for r in scheduled(spark.createDataFrame(rows, "recording BIGINT, row_id BIGINT, start_us BIGINT, end_us BIGINT"), ["recording"]).collect()}
    for k in range(4):
        own = [r for r in rows if r[0] == k]
        free = lambda some: all(a[3] <= b[2] or b[3] <= a[2] for a in some for b in some if a[1] < b[1])
        best = max(bin(m).count("1") for m in range(512) if free([own[i] for i in range(9) if m >> i & 1]))
        mine = [r for r in own if r[1] in kept]
        assert free(mine) and len(mine) == best


def test_json_times_and_transcripts(spark):
    texts = ['{"start_us": 5}', '{"start_sec": 1.5}', '{"start": 99999}', '{"start": 100000}', '{"start": 100000.0}', "{}", "x", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING").select("i", flexible_us(F.col("t"), "start").alias("u")).orderBy("i")
    assert [r.u for r in df.collect()] == [5, 1_500_000, 99_999_000_000, 100_000, 100_000_000_000, None, None, None]
    doc = spark.createDataFrame([(1, "# x\n[00:00:05] B: hi\n[00:01:00] A: yes\nnoise\n[00:01:02] B: b"), (2, None), (3, "")], "doc_id BIGINT, text STRING")
    assert [(r.start_s, r.end_s, r.speaker_no) for r in transcript_turns(doc).orderBy("line_no").collect()] == [(5, 60, 1), (60, 62, 2), (62, None, 1)]


def test_digest_and_picks(spark):
    df = spark.createDataFrame([("a", i) for i in range(50)], "k STRING, i INT")
    one, two = (tree_digest(x, ["k"], F.col("i").cast("string")).first() for x in (df, df.repartition(5).orderBy(F.desc("i"))))
    assert one == two and one.n_rows == 50
    assert [r.i for r in evenly_ranked(df, ["k"], "i", [], 3, 10).orderBy("i").collect()] == [0, 24, 49]
    arms = spark.createDataFrame([(0, 5, 1), (1, 9, 1), (2, 9, 1)], "arm INT, score INT, ok INT")
    assert first_best(arms, "ok = 1", [-F.col("score")], "arm").first().arm == 1
    assert first_best(arms.withColumn("ok", F.lit(0)), "ok = 1", [-F.col("score")], "arm").first().arm == 0


def test_neighbours_in_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>").repartition(3)
    got = {(r.query_id, r["rank"]): r.id for r in nearest_neighbours(df, df, 3, block_rows=17).collect()}
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, v in rows if v}
    for q in unit:
        near = sorted((round(1 - sum(a * b for a, b in zip(unit[q], unit[i], strict=True)), 6), i) for i in unit if i != q)
        assert [got[q, k] for k in (1, 2, 3)] == [i for _, i in near[:3]]


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(f"r{i}", i / 10) for i in range(30)], "recording STRING, v DOUBLE")
    a, b = (tuple(bootstrap_ci(x, "v", 40).first()) for x in (df, df.repartition(7)))
    assert a == b and a[2] < a[1] < a[3]
    assert bootstrap_ci(df.where("false"), "v").count() == 0
