"""The latest answer of every request on a stream, in keyed state with event-time timers.

A request is open while answers come; ``quiet`` after its last one, by the watermark, a timer gives its
latest row and forgets it. So state holds the requests of the last ``quiet`` + ``delay`` only, and a request whose
answers lie no further apart has exactly one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from railpulse.operators.cdc import UPDATE

# What a stream with keyed state and timers has to be started with.
KEYED_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


# Requests share state by a hash: so many groups of them, each read, merged and written as one table per batch.
GROUPS = 1024


def _latest(table: pa.Table, time: str) -> pa.Table:
    """The latest row per request; of equal times the greater message wins, and any message before none."""
    known = table.append_column("known", pc.is_valid(table.column("message")))
    order = pc.sort_indices(known, [(name, "ascending") for name in ("request_id", time, "known", "message")])
    ids = np.asarray(table.column("request_id").take(order))
    last = np.append(ids[1:] != ids[:-1], True) if len(ids) else np.empty(0, bool)
    return table.take(pc.filter(order, pa.array(last)))


def latest_in_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per request of each Arrow batch, so that a request with very many answers costs a batch one row."""
    for batch in batches:
        yield from _latest(pa.Table.from_batches([batch]), "op_time").to_batches()


_OPEN = pa.schema([("request_id", pa.int64()), ("micros", pa.int64()), ("message", pa.string())])


class LatestAnswers(StatefulProcessor):
    """Holds one answer per open request of a group, as a table, and a timer for the first of them that closes.

    State and timers of a request of its own would cost every request several calls from Python.
    """

    def __init__(self, quiet: timedelta):
        self.quiet = quiet // timedelta(milliseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "answers binary")

    def _read(self) -> pa.Table:
        if not self.open.exists():
            return _OPEN.empty_table()
        return pa.ipc.open_stream(self.open.get()[0]).read_all()

    def _closes(self, answers: pa.Table) -> np.ndarray:
        return answers.column("micros").to_numpy() // 1000 + self.quiet

    def _write(self, answers: pa.Table) -> None:
        if not len(answers):
            self.open.clear()
            return
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, _OPEN) as writer:
            writer.write_table(answers)
        self.open.update((out.getvalue().to_pybytes(),))
        self.handle.registerTimer(int(self._closes(answers).min()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self._read()
        new = [pa.Table.from_pandas(part[_OPEN.names], _OPEN, preserve_index=False) for part in rows]
        if len(known):
            self.handle.deleteTimer(int(self._closes(known).min()))
        self._write(_latest(pa.concat_tables([known, *new]), "micros"))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._read()
        closed = self._closes(known) <= timerValues.getCurrentWatermarkInMs()
        self._write(known.filter(pa.array(~closed)))
        yield known.filter(pa.array(closed)).to_pandas()

    def close(self) -> None:
        pass


def latest_per_request(
    responses: DataFrame, delay: str = "10 minutes", quiet: timedelta = timedelta(minutes=10)
) -> DataFrame:
    """(request_id, message, last_time): the last UPDATE of every request that has been quiet for ``quiet``.

    Rows later than ``delay`` and rows without a request id are left out. Start it with
    ``settings=KEYED_STATE``, and from a checkpoint of its own: one that an earlier version began has state by
    request. Ties are settled as in ``latest_by(..., ties=["message"])``.
    """
    updates = responses.where((F.col("op_name") == UPDATE) & F.col("request_id").isNotNull() & F.col("op_time").isNotNull())
    reduced = updates.select("request_id", "op_time", "message").mapInArrow(
        latest_in_batch, "request_id bigint, op_time timestamp, message string"
    )
    closed = (
        reduced.withColumn("micros", F.unix_micros("op_time")).withWatermark("op_time", delay)
        .withColumn("part", F.pmod(F.xxhash64("request_id"), F.lit(GROUPS))).groupBy("part")
        .transformWithStateInPandas(
            LatestAnswers(quiet), "request_id bigint, micros bigint, message string", "Append", "EventTime"
        )
    )
    return closed.select("request_id", "message", F.timestamp_micros("micros").alias("last_time"))
