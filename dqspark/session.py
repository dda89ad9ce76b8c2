"""Session with the settings the operators are written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_session(
    master: str | None = None, app_name: str = "dqspark", shuffle_partitions: int | None = None, **settings: str
) -> SparkSession:
    """Session with adaptive execution; ``settings`` override (dots as ``__``).

    ``shuffle_partitions`` is what shuffles begin with: about the bytes of the
    largest shuffle over 200 MB.  Adaptive execution merges small ones, but does
    not cut large ones except in skewed joins.
    """
    if shuffle_partitions is not None:
        settings = {"spark__sql__shuffle__partitions": str(shuffle_partitions), **settings}
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where none is set, a local session gets a temporary one; a cluster does not,
    as its machines could not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all machines share")
    return tempfile.mkdtemp(prefix="dqspark-")


def new_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, so that runs do not meet."""
    return f"{checkpoint_dir(spark)}/dqspark-{uuid.uuid4().hex}"
