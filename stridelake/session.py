"""Session defaults and the one place that cuts lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "stridelake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which every executor can reach.

    Only a local session without the setting gets a temporary folder; a cluster must name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="stridelake-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder.

    Used where a small derived table feeds several branches, so the large upstream
    plan runs once and a lost executor re-reads files instead of recomputing it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(df: DataFrame) -> int:
    """Configured shuffle width, for exchanges ahead of work that is heavy per byte.

    Runtime coalescing goes by bytes and would fold such a stage into a task or two.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
