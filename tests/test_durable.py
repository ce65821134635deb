from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import functions as F

from railpulse.operators.durable import CLEAN_SHUFFLES, keep


def shuffle_files(spark) -> set[str]:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(path) for folder in folders for path in Path(str(folder)).rglob("shuffle_*")}


def test_kept_rows_need_no_shuffle_files(spark):
    counted = spark.range(0, 10_000, 1, 8).groupBy((F.col("id") % 100).alias("k")).count()
    before = shuffle_files(spark)
    setting = spark.conf.get(CLEAN_SHUFFLES, None)
    kept = keep(counted)
    for _ in range(100):
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert spark.conf.get(CLEAN_SHUFFLES, None) == setting
    # What was kept is still there, and so is the way to compute the frame again.
    assert sorted(kept.collect()) == sorted(counted.collect()) == [(k, 100) for k in range(100)]
