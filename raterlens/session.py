"""SparkSession construction and lineage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Session settings the jobs are written against. AQE turns small shuffle
# outputs into broadcast joins at run time (a size-checked broadcast), splits
# skewed join partitions and coalesces small partitions.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "raterlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``. Where it is unset, a
    session on a local master gets a fresh scratch folder; any other raises,
    since executors would each write to a disk of their own."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.split("[")[0] == "local":
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {sc.master} share")
    local = tempfile.mkdtemp(prefix="raterlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


ROWS_A_TASK = 500_000  # held by one task of a join or aggregate by keys that hardly repeat


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as its rows need, so a task's
    memory stays the same however many rows there are. The rows are counted:
    for stored tables."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))
    return df.repartition(tasks, *keys)


@contextmanager
def shuffle_tasks(spark: SparkSession, rows: int):
    """What is run inside deals its joins and aggregates over one task per
    ROWS_A_TASK of ``rows``, or as many as the session has set if that is more.
    Unlike :func:`spread` it is the planner's own exchange, which it leaves out
    where it can broadcast and whose hot keys AQE splits."""
    n, to_set = -(-rows // ROWS_A_TASK), {}
    if n > int(spark.conf.get("spark.sql.shuffle.partitions")):
        # not united again: 64 MB of narrow rows are millions of them
        to_set = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in to_set}
    try:
        for k, v in to_set.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Cut lineage by writing ``df`` as a Parquet table into the shared
    checkpoint folder and reading it back (survives lost executors; never a
    local checkpoint). Unlike ``DataFrame.checkpoint`` the result is a file
    scan with size statistics, so the planner and AQE still see how small or
    large it is when choosing join strategies."""
    spark = df.sparkSession
    root = spark.sparkContext.getCheckpointDir() or ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/raterlens-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
