"""Crawl worker: a stream of work items, each fetched until it is answered or its attempts are spent."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.utils import AnalysisException

from ..operators import web

#: Maps an item (its columns) and the number of the attempt, from 1, to a status code and a body. An exception counts as code 0.
Transport = Callable[[dict, int], tuple[int, str | None]]


@dataclass(frozen=True)
class Policy:
    """How often an item is tried, how long a body must be, and the waits before the next attempt."""

    attempts: int = 4
    least_body: int = 2000
    busy_codes: tuple[int, ...] = (429, 502, 503, 0)
    #: Milliseconds; a busy site is left alone longer after each attempt.
    busy_wait: int = 20_000
    other_wait: int = 3_000

    def answered(self, code: int, body: str | None) -> bool:
        return code == 200 and body is not None and len(body) > self.least_body

    def wait(self, code: int, attempt: int) -> int:
        return self.busy_wait * attempt if code in self.busy_codes else self.other_wait


class Fetcher(StatefulProcessor):
    """State of a key: the item with its last attempt and whether it is done; while it isn't, there is a timer for the next attempt.

    One state of a few columns, as each call on a state is a message to the JVM.
    """

    def __init__(self, columns: list[str], kept: ty.StructType, transport: Transport, policy: Policy):
        self.columns, self.kept, self.transport, self.policy = columns, kept, transport, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", self.kept)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        item = None
        for row in rows:
            item = item or row  # the first one; the same item again is skipped
        if not self.state.exists():
            yield self._try([item[c] for c in self.columns], 1, timerValues)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        *item, attempt, _ = self.state.get()
        yield self._try(item, attempt + 1, timerValues)

    def _try(self, item: list, attempt: int, now: TimerValues) -> Row:
        try:
            code, body = self.transport(dict(zip(self.columns, item, strict=True)), attempt)
        except Exception:  # whatever the transport raises, the item is tried again
            code, body = 0, None
        good = self.policy.answered(code, body)
        final = good or attempt >= self.policy.attempts
        # Of an item that is done the key alone matters.
        self.state.update((*([None] * len(item) if final else item), attempt, final))
        if not final:
            self.handle.registerTimer(now.getCurrentProcessingTimeInMs() + self.policy.wait(code, attempt))
        return Row(**dict(zip(self.columns, item, strict=True)), attempt=attempt, code=code, final=final, body=body if good else None)

    def close(self) -> None:
        pass


#: The state store of a worker: changes are written after each batch, not the whole store; the last few batches are kept; many small stores set no space aside.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.minBatchesToRetain": "3",
}
ATTEMPT = (ty.StructField("attempt", ty.IntegerType()), ty.StructField("code", ty.IntegerType()), ty.StructField("final", ty.BooleanType()), ty.StructField("body", ty.StringType()))


def start(items: DataFrame, key: str, transport: Transport, out: str, checkpoint: str, policy: Policy = Policy(), every: str = "0 seconds", carry: tuple[str, ...] | None = None) -> StreamingQuery:
    """Starts the worker over `items`, a stream with a column `key`, and writes a row for each attempt to `out`, as Parquet.

    Rows have the columns `carry` of their item (all by default), attempt, code, final (no attempt follows) and body (of an answer that Policy takes). Items of a key that is waiting or done
    are skipped. Started again with the same checkpoint it goes on where it was: each attempt is in the table once, though a killed one may have been sent twice.
    As many items are fetched at a time as there are tasks; `spark.sql.shuffle.partitions` at the first start is the number of workers.
    """
    spark = items.sparkSession
    columns = items.columns
    schema = ty.StructType([*items.schema.fields, *ATTEMPT])
    kept = ty.StructType([ty.StructField(f"_{f.name}", f.dataType, True) for f in items.schema.fields] + [ty.StructField("attempt", ty.IntegerType()), ty.StructField("done", ty.BooleanType())])
    before = {name: spark.conf.get(name, None) for name in STATE}
    for name, value in STATE.items():
        spark.conf.set(name, value)  # a query keeps what the session has when it starts
    try:
        rows = items.groupBy(key).transformWithState(Fetcher(columns, kept, transport, policy), schema, "append", "ProcessingTime")
        rows = rows.select(*(carry or columns), *[f.name for f in ATTEMPT])
        return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def attempts(spark: SparkSession, out: str) -> DataFrame | None:
    """The attempts written so far, or None before the first ones."""
    try:
        return spark.read.parquet(out)
    except AnalysisException:
        return None


def waiting(spark: SparkSession, out: str, key: str) -> DataFrame | None:
    """Keys with attempts of which none is final."""
    rows = attempts(spark, out)
    return None if rows is None else rows.groupBy(key).agg(F.max("final").alias("final")).where("not final").select(key)


def finish(spark: SparkSession, query: StreamingQuery, out: str, key: str, idle: float = 0.2, most: float | None = None) -> None:
    """Waits until every item of the stream is done, then stops the query. Fails if the query does, or after `most` seconds."""
    began, looked = time.time(), -1
    while True:
        if query.exception():
            raise query.exception()
        if most is not None and time.time() - began > most:
            query.stop()
            raise TimeoutError("items are still waiting")
        last = query.lastProgress
        if last and last["numInputRows"] == 0 and last["batchId"] != looked:
            looked = last["batchId"]
            left = waiting(spark, out, key)
            if left is None or left.isEmpty():
                query.stop()
                return
        time.sleep(idle)


def results(spark: SparkSession, out: str, extract: Callable[[DataFrame], DataFrame], least_text: int = 200, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """(saved, failed) of the final attempts: answers of which `extract`, which adds title and body to rows with html, gives enough text, and all others."""
    final = spark.read.parquet(out).where("final").withColumnRenamed("body", "html")
    rows = extract(final).withColumnRenamed("body", "text")
    return web.accepted(rows.withColumnRenamed("html", "body"), policy.least_body, least_text)
