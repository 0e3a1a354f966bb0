import os

import pytest

from chronoloom.session import cut, drop, shared_dir


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    class conf:
        @staticmethod
        def get(name, default=None):
            return default

    class sparkContext:
        master = "spark://host:7077"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Elsewhere())


def test_cut_tables_are_dropped(spark):
    held = cut(spark.range(5), "test")
    path = held._cut_path.removeprefix("file://")
    assert held.count() == 5 and os.path.isdir(path)
    drop(held)
    assert not os.path.exists(path)
    drop(spark.range(1))


def test_what_is_left_goes_with_the_application(tmp_path):
    import subprocess
    import sys

    code = f"""
from pyspark.sql import SparkSession
from chronoloom.session import cut
s = SparkSession.builder.master('local[1]').config('spark.checkpoint.dir', 'file://{tmp_path}').config('spark.ui.enabled', 'false').getOrCreate()
cut(s.range(3), 'left').count()
s.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, capture_output=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    for _ in range(40):
        left = [x for x in os.listdir(tmp_path) if x.startswith("left-")]  # Spark makes a folder of its own beside
        if not left:
            break
        time.sleep(0.5)
    assert left == []
