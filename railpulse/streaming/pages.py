"""The hourly pages, refreshed as a whole while their hours are still open.

Every micro-batch of new log rows is first landed in a folder of its own, named by the batch, and the
pages are then computed from the rows of this batch and all before it, again into a folder of its own. So a batch that
runs twice, after a failure, replaces its own rows and pages by the same ones, and a page equals the batch
form over the rows landed so far. Landed rows are partitioned by batch, log and day: a page reads its eight days.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from railpulse.plans import hourly
from railpulse.sources.files import children, exists
from railpulse.sources.tables import _CLOCK, DAY_COLUMN, SCHEMAS, PaymentTables
from railpulse.streaming.hourly import REFRESH

# The logs that the pages read, and the pages.
PAGE_LOGS = ("txn_requests", "txn_responses", "txn_devices", "bio_log")
PAGES: dict[str, Callable[[PaymentTables, date], DataFrame]] = {
    "txn_hourly_health": hourly.txn_hourly_health,
    "bio_hourly_health": hourly.bio_hourly_health,
}


def _columns() -> dict[str, T.DataType]:
    return {f.name: f.dataType for log in PAGE_LOGS for f in SCHEMAS[log].fields}


def merged(logs: Mapping[str, DataFrame]) -> DataFrame:
    """The rows of several logs, streams or not, as one frame with the name in ``log`` and the day."""
    found = None
    for name in PAGE_LOGS:
        df, own = logs[name], {f.name for f in SCHEMAS[name].fields}
        columns = [
            (F.col(c) if c in own else F.lit(None)).cast(kind).alias(c) for c, kind in _columns().items()
        ]
        rows = df.select(*columns, F.lit(name).alias("log"), F.to_date(_CLOCK[name]).alias(DAY_COLUMN))
        found = rows if found is None else found.union(rows)
    return found


def land(rows: DataFrame, root: str, batch_id: int) -> None:
    """Write a batch of ``merged`` rows in place of what the same batch wrote before."""
    rows.write.mode("overwrite").partitionBy("log", DAY_COLUMN).parquet(f"{root}/rows/batch={batch_id}")


def landed_tables(spark: SparkSession, root: str, batch_id: int) -> PaymentTables:
    """The logs as they were when ``batch_id`` had been landed."""
    schema = T.StructType([
        *[T.StructField(name, kind) for name, kind in _columns().items()],
        T.StructField("batch", T.LongType()), T.StructField("log", T.StringType()), T.StructField(DAY_COLUMN, T.DateType()),
    ])
    rows = spark.read.schema(schema).parquet(f"{root}/rows").where(F.col("batch") <= batch_id)

    def read(name: str) -> DataFrame:
        return rows.where(F.col("log") == name).select(*[f.name for f in SCHEMAS[name].fields], DAY_COLUMN)

    return PaymentTables(spark, read)


def refresh_pages(root: str, as_of: date) -> Callable[[DataFrame, int], None]:
    """What a stream of ``merged`` rows does with a batch: land it, then write every page."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        land(batch, root, batch_id)
        tables = landed_tables(spark, root, batch_id)
        for name, page in PAGES.items():
            page(tables, as_of).write.mode("overwrite").parquet(f"{root}/pages/{name}/batch={batch_id}")

    return run


def start_pages(
    logs: Mapping[str, DataFrame], root: str, checkpoint: str, as_of: date, every: str | None = REFRESH
) -> StreamingQuery:
    """Refresh the pages of the day ``as_of`` every ``every``; with None take what is there and stop."""
    writer = merged(logs).writeStream.foreachBatch(refresh_pages(root, as_of)).option("checkpointLocation", checkpoint)
    trigger = writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)
    return trigger.start()


def current_page(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The page of the last batch that is complete, None before the first."""
    folder = f"{root}/pages/{name}"
    batches = sorted((int(b.split("=")[1]) for b in children(spark, folder) if b.startswith("batch=")), reverse=True)
    for batch in batches:
        if exists(spark, f"{folder}/batch={batch}/_SUCCESS"):
            return spark.read.parquet(f"{folder}/batch={batch}")
    return None
