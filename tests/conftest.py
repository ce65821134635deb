from __future__ import annotations

from datetime import datetime

import pytest

from railpulse.session import local_session
from railpulse.sources.tables import SCHEMAS, PaymentTables


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, shuffle_partitions=4, memory="4g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


class Logs:
    """Collects hand-made rows of the payment tables."""

    def __init__(self, spark):
        self.spark = spark
        self.rows: dict[str, list[dict]] = {name: [] for name in SCHEMAS}

    def add(self, table: str, **row) -> Logs:
        self.rows[table].append(row)
        return self

    def txn(self, request_id, when, message="Success", amount=10_000_000, aggregator="ybl",
            kind="CW", inserts=1, devices=1, client=1) -> Logs:
        """A request with its response rows and device rows, all within the minute."""
        when = at(when)
        self.add("txn_requests", op_time=when, op_name="INSERT", request_id=request_id,
                 trans_amt=amount, client_id=client, master_trans_type=kind,
                 aggregator=aggregator)
        for _ in range(inserts):
            self.add("txn_responses", op_time=when, op_name="INSERT", request_id=request_id)
        self.add("txn_responses", op_time=when.replace(second=1), op_name="UPDATE",
                 request_id=request_id, message=message)
        for i in range(devices):
            self.add("txn_devices", request_id=request_id, dpid=f"DP{i}", op_time=when)
        return self

    def bio(self, request_id, when, rc="00", client=1, aggregator="NSDL", updates=1) -> Logs:
        when = at(when)
        self.add("bio_log", op_time=when, op_name="INSERT", request_id=request_id,
                 client_id=client, aggregator=aggregator)
        for _ in range(updates):
            self.add("bio_log", op_time=when.replace(second=2), op_name="UPDATE",
                     request_id=request_id, client_id=client, aggregator=aggregator, rc=rc)
        return self

    def daily(self, request_id, when, client=1, amount=10_000_000, bank="A",
              message="SUCCESS", answered=None) -> Logs:
        self.add("daily_requests", request_id=request_id, client_id=client,
                 log_date_time=at(when), trans_amt=amount, cust_bank_name=bank)
        self.add("daily_responses", request_id=request_id,
                 log_date_time=at(answered or when), message=message)
        return self

    def place(self, client, state) -> Logs:
        return self.add("client_locations", retailer_id=client, final_state=state)

    def frame(self, name: str):
        schema = SCHEMAS[name]
        rows = [tuple(r.get(f.name) for f in schema.fields) for r in self.rows[name]]
        return self.spark.createDataFrame(rows, schema)

    def tables(self) -> PaymentTables:
        return PaymentTables(self.spark, self.frame)


@pytest.fixture
def logs(spark):
    return Logs(spark)


def by(df, *keys):
    """Rows as dictionaries under one or more key columns."""
    rows = [r.asDict() for r in df.collect()]
    if len(keys) == 1:
        return {r[keys[0]]: r for r in rows}
    return {tuple(r[k] for k in keys): r for r in rows}
