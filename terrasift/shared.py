"""The folder that all executors share: checkpoints and intermediate tables go there, never to a folder of one machine."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is missing, a folder of our own is set, but only if driver and executors
    are one process; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="terrasift-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the shared one."""
    return f"{shared_root(spark).rstrip('/')}/terrasift-{uuid.uuid4().hex}"


def checkpointer(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table to the shared folder, which cuts its lineage."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return lambda df: df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder: cuts its lineage, survives lost executors, and its size is known to whoever joins it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch: Python workers and the JVM's buffers hold some batches for each task.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> None:
    """Bounds the Arrow batches of the session, which are bounded by rows only where rows are small; long texts aren't."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.match(r"\d+", df.sparkSession.conf.get(name, str(64 << 20)))
    if now is None or int(now[0]) > BATCH_BYTES:
        df.sparkSession.conf.set(name, str(BATCH_BYTES))
