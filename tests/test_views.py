from chronoloom.plans.timelines import sliding_windows
from chronoloom.plans.views import WORD_US, words


def test_words_reach_the_end_of_long_turns(spark, tmp_path):
    turns = [(1, "f", "1", "s1", 0, 60_000_000), (2, "f", "1", "s2", 5, 5 + 12_300_000), (3, "f", "2", "s3", 0, 299_999)]
    spark.createDataFrame(turns, "row_id BIGINT, file_id STRING, channel STRING, speaker_id STRING, start_us BIGINT, end_us BIGINT").write.parquet(str(tmp_path / "rttm.parquet"))
    got = {r.word_id: (r.start_us, r.end_us) for r in words(spark, str(tmp_path)).collect()}
    assert got == {f"{i}-{k}": (s + k * WORD_US, s + (k + 1) * WORD_US) for i, _, _, _, s, e in turns for k in range((e - s) // WORD_US)}


def test_sliding_windows_shift_by_a_second(spark, tmp_path):
    scopes = [(1, "f", "1", 0, 14_500_000), (2, "f", "1", 500_000, 3_000_000), (3, "g", "2", 7, 12_000_007)]
    spark.createDataFrame(scopes, "row_id BIGINT, file_id STRING, channel STRING, start_us BIGINT, end_us BIGINT").write.parquet(str(tmp_path / "uem.parquet"))
    got = sorted((r.row_id, r.window_us) for r in sliding_windows(spark, str(tmp_path)).collect())
    assert got == sorted((i, w) for i, _, _, s, e in scopes for w in {*range(s, max(s, e - 10_000_000) + 1, 1_000_000), max(s, e - 10_000_000)})
