"""Session helpers.

Everything in the library takes a ``SparkSession`` from the caller; this
module only offers a sensible local session for tests and the bench, and the
lineage-cutting helper that writes to the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for the plans in this library. AQE re-plans joins and
# coalesces shuffle partitions at runtime, and splits skewed join partitions.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "ebb") -> SparkSession:
    """Local session for tests and the bench (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
          .config("spark.driver.memory", os.environ.get("EBB_DRIVER_MEMORY", "16g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared folder and is read as is. Only when
    it is unset in a local session is a scratch folder created; on a cluster
    each executor would write to a disk of its own, so there it is an error.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="ebb-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read
    it back: the lineage ends at that table.

    Used where a frame feeds several jobs (statistics passes, CV folds,
    calibration): they read the written table instead of recomputing the
    joins, and a lost executor re-reads files instead of re-running the plan.
    (``Dataset.checkpoint`` would compute the plan twice, once to count and
    once to save; ``localCheckpoint`` keeps blocks on executors and dies with
    them, so neither is used.)
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/ebb-tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Source rows for which a large frame gets a shuffle partition, and what AQE then merges them to.
SHUFFLE_ROWS, SHUFFLE_SIZE = 250_000, "8m"


@contextmanager
def sized_shuffles(spark: SparkSession, rows: int):
    """Shuffles of queries that run inside get a partition per SHUFFLE_ROWS rows
    if that is more than the session's number, so that what a task sorts or
    aggregates does not grow with the input."""
    n = -(-rows // SHUFFLE_ROWS)
    if n <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        yield
        return
    wanted = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.advisoryPartitionSizeInBytes": SHUFFLE_SIZE}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
