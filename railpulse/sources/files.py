"""Publishing results as files through the Hadoop file system that the session uses."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    system = _system(spark, path)
    if not system.exists(_path(spark, path)):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(_path(spark, path)))


def publish_csv(df: DataFrame, path: str) -> str:
    """Write ``df`` as one CSV file with a header at ``path``, also if it has no rows, and return the path.

    One task writes the rows, in the order of ``df``, to a folder beside ``path``; the file is then renamed. A
    reader sees the old file or the new one, and a failed job leaves the old one. For reports, which
    have some thousand rows at most; ``export_csv`` writes large results by many tasks.
    """
    spark = df.sparkSession
    system = _system(spark, path)
    parent, name = path.rsplit("/", 1)
    aside = f"{parent}/.{name}.{uuid4().hex}"
    try:
        df.coalesce(1).write.option("header", True).csv(aside)
        parts = [f for f in children(spark, aside) if f.startswith("part-")]
        if len(parts) > 1:
            raise ValueError(f"{len(parts)} part files instead of one")
        if not parts:  # a frame without partitions
            header = spark.createDataFrame([], df.schema).repartition(1)
            header.write.mode("overwrite").option("header", True).csv(aside)
            parts = [f for f in children(spark, aside) if f.startswith("part-")]
        target, part = _path(spark, path), _path(spark, f"{aside}/{parts[0]}")
        _replace(spark, system, part, target)
    finally:
        system.delete(_path(spark, aside), True)
    return path


def _replace(spark: SparkSession, system, source, target) -> None:
    """Rename over a file that may be there; in one step where the file system can."""
    context = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = context.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(context.Options.Rename, 1)
    overwrite[0] = context.Options.Rename.OVERWRITE
    files.rename(system.makeQualified(source), system.makeQualified(target), overwrite)
