"""The seven payment tables: schemas, reading, date-bounded scans and layout."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railpulse.functions.timeparts import DayRange, within
from railpulse.session import require_utc

# Name of the optional partition column written by ``write_partitioned``.
DAY_COLUMN = "log_day"


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_LONG, _TEXT, _TIME = T.LongType(), T.StringType(), T.TimestampType()

SCHEMAS: dict[str, T.StructType] = {
    # change log of transaction requests
    "txn_requests": _schema(
        op_time=_TIME, op_name=_TEXT, request_id=_LONG, trans_amt=_LONG, client_id=_LONG,
        master_trans_type=_TEXT, trans_mode=_TEXT, aggregator=_TEXT,
    ),
    # change log of transaction responses: an INSERT, then one or more UPDATEs
    "txn_responses": _schema(
        op_time=_TIME, op_name=_TEXT, request_id=_LONG, rc=_TEXT, message=_TEXT,
        amount=_LONG, response_message=_TEXT,
    ),
    # capture devices; a request may have several rows
    "txn_devices": _schema(request_id=_LONG, dpid=_TEXT, rdsid=_TEXT, op_time=_TIME),
    # change log of biometric authentication attempts
    "bio_log": _schema(
        op_time=_TIME, op_name=_TEXT, request_id=_LONG, client_id=_LONG,
        aggregator=_TEXT, rc=_TEXT, rm=_TEXT,
    ),
    # final daily requests and responses, each on its own clock
    "daily_requests": _schema(
        request_id=_LONG, client_id=_LONG, log_date_time=_TIME, trans_amt=_LONG,
        cust_bank_name=_TEXT,
    ),
    "daily_responses": _schema(request_id=_LONG, log_date_time=_TIME, message=_TEXT),
    # where a client is located
    "client_locations": _schema(retailer_id=_LONG, final_state=_TEXT),
}

_CLOCK = {
    "txn_requests": "op_time", "txn_responses": "op_time", "txn_devices": "op_time",
    "bio_log": "op_time", "daily_requests": "log_date_time", "daily_responses": "log_date_time",
}


class PaymentTables:
    """The seven tables as attributes, each read when it is first asked for.

    A plan lists the files only of the tables it uses.
    """

    def __init__(self, spark: SparkSession, read: Callable[[str], DataFrame]):
        self.spark = spark
        self._read = read

    @classmethod
    def of(cls, spark: SparkSession, **frames: DataFrame) -> PaymentTables:
        """Tables from frames at hand."""
        return cls(spark, lambda name: conform(frames[name], name))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        df = self._read(name)
        setattr(self, name, df)
        return df

    def as_views(self, *names: str) -> None:
        """Register tables (all by default) as temp views for ``spark.sql``."""
        for name in names or SCHEMAS:
            getattr(self, name).createOrReplaceTempView(name)


def conform(df: DataFrame, table: str, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Lower-case the column names and check them against the table's schema.

    ``rename`` maps our column names to the source's. Columns we do not know are
    left out; the partition column is kept. A missing column is an error.
    """
    source = {name.lower(): name for name in df.columns}
    rename = {ours: theirs.lower() for ours, theirs in (rename or {}).items()}
    wanted = {f.name: rename.get(f.name, f.name) for f in SCHEMAS[table].fields}
    missing = [theirs for theirs in wanted.values() if theirs not in source]
    if missing:
        raise ValueError(f"{table}: missing columns {sorted(missing)}")
    out: list[Column] = []
    for f in SCHEMAS[table].fields:
        name = source[wanted[f.name]]
        column = F.col(f"`{name}`")
        actual = df.schema[name].dataType
        if actual != f.dataType:
            # Fractional amounts become whole numbers by rounding half away from zero.
            if isinstance(f.dataType, T.LongType) and isinstance(
                actual, (T.DoubleType, T.FloatType, T.DecimalType)
            ):
                column = F.round(column)
            column = column.cast(f.dataType)
        out.append(column.alias(f.name))
    if DAY_COLUMN in source:
        out.append(F.col(f"`{source[DAY_COLUMN]}`").alias(DAY_COLUMN))
    return df.select(out)


def load_tables(
    spark: SparkSession, root: str, rename: Mapping[str, Mapping[str, str]] | None = None
) -> PaymentTables:
    """Read ``<root>/<table>`` Parquet data sets. Nothing is inferred beyond the footer."""
    require_utc(spark)
    rename = rename or {}
    return PaymentTables(
        spark,
        lambda name: conform(spark.read.parquet(f"{root}/{name}"), name, rename.get(name)),
    )


def scan_days(df: DataFrame, clock: str, days: DayRange) -> DataFrame:
    """Rows whose ``clock`` lies in ``days``.

    The predicate on the clock reaches the Parquet reader as a timestamp range;
    where the data is partitioned by day the partitions are pruned as well.
    """
    kept = df.where(within(F.to_date(clock), days))
    if DAY_COLUMN in df.columns:
        kept = kept.where(within(F.col(DAY_COLUMN), days))
    return kept


def write_partitioned(
    df: DataFrame, table: str, path: str, files_per_day: int, mode: str = "append"
) -> None:
    """Write one of the log tables as Parquet, partitioned by its day.

    A day becomes ``files_per_day`` files of about equal size, whatever ids it holds, and as many
    tasks write it: choose it by the size of a day. The session must run in UTC;
    rows are spread by a hash of request and time, which a retried task repeats.
    """
    require_utc(df.sparkSession)
    clock = _CLOCK[table]
    part = F.pmod(F.xxhash64("request_id", clock), F.lit(files_per_day))
    (
        df.withColumn(DAY_COLUMN, F.to_date(clock))
        .repartition(DAY_COLUMN, part)
        .write.mode(mode)
        .partitionBy(DAY_COLUMN)
        .parquet(path)
    )
