import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for n in (1, 2, 6, 7):
        assert f"p{n}_found" in entry.queries()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["kind", "file_id", "channel", "speaker_id", "start_us", "end_us"]
    assert df.count() > 0
