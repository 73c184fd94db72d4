import os
import tempfile
import time

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallyscope import session
from tallyscope.llm.components import components


class _Unset:
    """A session without a shared folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        @staticmethod
        def getCheckpointDir():
            return None


def test_a_shared_folder_is_required():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Unset)


def test_settled_tables_are_discarded(spark):
    table = session.settle(spark.range(10))
    assert table.count() == 10
    path = session._settled[-1]
    session.discard_settled(spark)
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = jvm.Path(path)
    assert not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def _files(folder):
    return [name for _, _, names in os.walk(folder) for name in names]


def test_a_settled_table_leaves_no_shuffle_files(spark):
    local = spark.conf.get("spark.local.dir", None) or os.environ.get("SPARK_LOCAL_DIRS") or tempfile.gettempdir()
    old = {name for name in _files(local) if name.startswith("shuffle_")}
    table = session.settle(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    for _ in range(50):
        left = {name for name in _files(local) if name.startswith("shuffle_")} - old
        if not left:
            break
        time.sleep(0.1)
    assert not left and table.agg(F.sum("n")).first()[0] == 1000


def test_only_the_named_tables_are_discarded(spark):
    one, two = session.settle(spark.range(5)), session.settle(spark.range(6))
    first, second = session._settled[-2:]
    session.discard(one)
    assert first not in session._settled and second in session._settled and two.count() == 6
    with pytest.raises(AnalysisException):
        spark.read.parquet(first)


def test_components_keep_only_their_last_tables(spark):
    pairs = session.settle(spark.range(1, 30).selectExpr("id as a", "id - 1 as b"))
    before = len(session._settled)
    found = components(pairs).collect()
    assert {r.root for r in found} == {0} and len(found) == 30 and len(session._settled) == before + 1
