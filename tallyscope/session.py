"""Session settings the operators rely on.

Only runtime-settable SQL options are touched, so the same call works on a cluster session
that was built elsewhere.
"""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_settled: list[str] = []
#: Folders of the settled tables that are still held.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()

#: Whether Spark deletes the shuffle files of an execution as soon as it has ended.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> SparkSession:
    """Pin the time zone and the adaptive settings (coalescing, skew-join splitting)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    }
    for key, value in settings.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def use_rocksdb_state(spark: SparkSession) -> SparkSession:
    """Arbitrary-state streaming queries need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; an error where none is set, since a folder of one machine would lose rows."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Compute a table once and keep it as Parquet in the shared checkpoint folder.

    For tables that several later steps read: without this each of them would recompute the whole
    upstream plan. A written table is computed exactly once (a checkpoint runs its last stage
    twice), survives executor loss, and later reads prune columns and push filters into it. The shuffle files behind it
    are deleted at once: nothing reads them again, since a write has an execution of its own.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    _settled.append(path)
    before = spark.conf.get(_SHUFFLE_CLEANUP, None)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLE_CLEANUP)
        else:
            spark.conf.set(_SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _folders[table] = path
    return table


def settle_observed(df: DataFrame, keep: list[str], **measures: Column) -> tuple[DataFrame, dict]:
    """``settle`` for the columns to keep, and aggregates over all rows, collected by the job that writes them.

    So a rule on the rows costs no job of its own. A table without rows has no measures: they are null then.
    """
    observation = Observation()
    observed = df.observe(observation, *[measure.alias(name) for name, measure in measures.items()])
    settled = settle(observed.select(*keep))
    return settled, {name: observation.get.get(name) for name in measures}


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Delete these settled tables, once no result that reads them is needed any more; others are left alone."""
    for table in tables:
        path = _folders.pop(table)
        if path in _settled:
            _settled.remove(path)
            _delete(table.sparkSession, path)


def discard_settled(spark: SparkSession) -> None:
    """Delete the tables settled so far, once no result that reads them is needed any more."""
    while _settled:
        _delete(spark, _settled.pop())


#: Bytes of a part by Spark's estimate, which counts compressed files by their share of columns read.
PART_BYTES = 2 << 20


def parts_of(df: DataFrame) -> int:
    """Partitions that hold about ``PART_BYTES`` each, and as many as a shuffle has at least."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """Deal few large rows out over the cores before costly work on each of them.

    A small file, or one that cannot be split, is one task whatever is done to its rows. Tables that have a full read
    partition for every core are left as they are, so only small ones are moved.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    full = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(4 * cores) if size < cores * full else df


def computed(df: DataFrame) -> DataFrame:
    """Keep later filters from recomputing the columns of ``df``.

    Catalyst pushes a filter on a computed column below the projection by inlining the whole
    expression, so costly parsing would run for the filter and again for the value. Columns that
    come out of a generator are taken as they are.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
