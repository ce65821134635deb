"""Cutting a plan at a result that several later steps read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate results.

    The folder that ``spark.checkpoint.dir`` names, else one in the warehouse, which
    all executors share as well. There is no machine-local default.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


#: Shuffle files are deleted at the end of an execution, not when the driver next collects garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, on reliable storage, and go on from there.

    The files go with the frame where ``spark.cleaner.referenceTracking.cleanCheckpoints``
    is set, as ``session.local_session`` does; on a cluster set it at start. Those that were shuffled for it go at
    once, since what follows reads the kept rows.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    before = spark.conf.get(CLEAN_SHUFFLES, None)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        # A frame follows the settings of the time when it was made.
        return df.select("*").checkpoint(eager=True)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_SHUFFLES)
        else:
            spark.conf.set(CLEAN_SHUFFLES, before)
