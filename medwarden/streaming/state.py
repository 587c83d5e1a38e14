"""Keyed state: every batch meets all earlier rows of its keys, without reading any history."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Rows that go into a key's state at once.
_CHUNK = 1000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_NO_ROWS = "spark.sql.streaming.noDataMicroBatches.enabled"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RowsOfKey(StatefulProcessor):
    """Keeps the rows of each key and gives all of them whenever new ones come.

    With ``keep_ms``, the rows of a key go when it has had none for so long. What comes for the key
    after that is given alone and marked ``late``.
    """

    def __init__(self, schema: T.StructType, keep_ms: int | None) -> None:
        self._schema, self._keep_ms = schema, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._made = Row(*self._schema.names, "late")
        self._rows = handle.getListState("rows", self._schema)
        self._closed = handle.getValueState("closed", "closed boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        late = self._closed.exists()
        if late:
            yield from (self._made(*row, True) for row in rows)
            return
        while part := [tuple(row) for row in islice(rows, _CHUNK)]:
            self._rows.appendList(part)
        if self._keep_ms is not None:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self._keep_ms)
        for row in self._rows.get():
            yield self._made(*row, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._rows.clear()
        self._closed.update((True,))
        return iter(())

    def close(self) -> None:
        pass


def touched_rows(rows: DataFrame, key: str, keep_ms: int | None = None) -> DataFrame:
    """A stream of all rows so far of the keys of each batch, with ``late`` (see ``RowsOfKey``).

    The state of a key lives in one task, as the rows that are made of it do. Rows with a NULL key
    are left out.
    """
    out = T.StructType([*rows.schema.fields, T.StructField("late", T.BooleanType())])
    return (
        rows.filter(F.col(key).isNotNull())
        .groupBy(key)
        .transformWithState(
            statefulProcessor=RowsOfKey(rows.schema, keep_ms),
            outputStructType=out,
            outputMode="Append",
            timeMode="None" if keep_ms is None else "ProcessingTime",
        )
    )


@contextmanager
def state_settings(spark: SparkSession, timers: bool = False) -> Iterator[None]:
    """Settings of streams that start within: their state is in RocksDB, as list states need it.

    With ``timers``, batches without rows are left out: there would be one after the other, and a job
    that runs what is there would never end. Timers that are due then wait for the next rows.
    """
    own = {_PROVIDER: _ROCKSDB} | ({_NO_ROWS: "false"} if timers else {})
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
