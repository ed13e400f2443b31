"""Session construction and the few session settings the operators rely on."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def get_spark(app_name: str = "pairgate", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; ``conf`` wins over the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the folder of ``spark.checkpoint.dir``.

    The folder must be one that the driver and all executors share, so there is no default: a
    session without it is refused.  With ``spark.cleaner.referenceTracking.cleanCheckpoints``
    (set by ``get_spark``) files go once their DataFrame is no longer used.  Rows are kept while they
    are written, since a checkpoint is a count and then a write and would compute them twice.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder)
    if df.storageLevel.useMemory or df.storageLevel.useDisk:  # the caller keeps them
        return df.checkpoint(eager=True)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()
