"""Keyed state of streams: the last version of every document, and the times at which sources are due.

State lives in the stream's store (RocksDB with changelogs), by key, or by bucket of documents: a micro-batch
reads and writes the buckets of the documents that it has. Event-time timers end what was not seen for long, and
call what is due.
"""

from __future__ import annotations

import pickle
from collections.abc import Hashable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_STORE = "spark.sql.streaming.stateStore.rocksdb"


@contextmanager
def keyed_store(spark: SparkSession, executor_mb: int = 64) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, whose caches and buffers share `executor_mb` of an executor's memory;
    the session's own settings come back afterwards."""
    wanted = {_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", f"{_STORE}.changelogCheckpointing.enabled": "true", f"{_STORE}.boundedMemoryUsage": "true", f"{_STORE}.maxMemoryUsageMB": str(executor_mb)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Tracker(StatefulProcessor):
    """Of a bucket's documents: the hash and number of the last version, and when it was seen. Emits at most one change of a document a micro-batch.

    A bucket's documents are one value of the store, as each visit of the store costs Python about as much as hundreds of rows.
    """

    def __init__(self, columns: list[str], key: str, digest: str, ttl_ms: int | None):
        self.columns, self.key, self.digest, self.ttl_ms = columns, key, digest, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "documents binary")

    def _last(self) -> dict:
        """{document: (key, hash, version, seen)}"""
        value = self.kept.get()
        return {} if value is None else pickle.loads(bytes(value[0]))

    def _keep(self, last: dict) -> None:
        if last:
            self.kept.update((pickle.dumps(last, pickle.HIGHEST_PROTOCOL),))
        else:
            self.kept.clear()
        if self.ttl_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if last:
                self.handle.registerTimer(min(seen for *_, seen in last.values()) // 1000 + self.ttl_ms)

    @staticmethod
    def _same(key) -> Hashable:
        """What is equal for equal keys."""
        return bytes(key) if isinstance(key, bytearray) else "NaN" if isinstance(key, float) and key != key else key

    def _row(self, values: dict, change: str, version: int, replaces: int | None) -> Row:
        return Row(**{c: values.get(c) for c in self.columns}, change=change, version=version, replaces=replaces)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        best = {}
        for r in rows:
            at, digest, doc = r["__micros"], r[self.digest] or "", self._same(r[self.key])
            if at is not None and (doc not in best or best[doc][:2] < (at, digest)):
                best[doc] = (at, digest, r)
        if not best:
            return
        last = self._last()
        for doc, (at, digest, r) in best.items():
            _, hash_, number, seen = last.get(doc, (None, None, None, None))
            if seen is not None and at < seen:
                continue  # an older delivery that comes late
            if seen is not None and digest == hash_:
                last[doc] = (r[self.key], hash_, number, at)
                continue
            version = at if seen is None else max(at, number + 1)
            last[doc] = (r[self.key], digest, version, at)
            yield self._row(r.asDict(), "new" if seen is None else "changed", version, number)
        self._keep(last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        last, reached, mark = self._last(), expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        for doc, (name, digest, number, seen) in list(last.items()):
            due = seen // 1000 + self.ttl_ms
            if due <= reached or due < mark:
                del last[doc]
                yield self._row({self.key: name, self.digest: digest}, "expired", number + 1, number)
        self._keep(last)

    def close(self) -> None:
        pass


def track(stream: DataFrame, key: str = "doc_id", digest: str = "hash", at: str = "at", late: str = "1 day", ttl_seconds: int | None = None, buckets: int = 16384) -> DataFrame:
    """The changes in a stream of documents: its columns, `change`, `version`, `replaces`.

    Of the deliveries of a document in a micro-batch the last by `at` counts (of equal ones that with the
    highest hash). It is `new`, or `changed` if its hash isn't the last one's, so a return to an older
    content is a change; a delivery older than the last, or without a time, is ignored. A version's number is
    its time in microseconds, and grows. With `ttl_seconds` a document that was not delivered for as long, by
    the watermark, is `expired` (other columns are null) and forgotten. Null keys are one document. Columns
    named like the three give way. State is kept by bucket of documents (some 60 bytes each), and a micro-batch reads and
    writes the buckets that it meets; `buckets` stays as it is over a stream's restarts. To be started within `keyed_store`.
    """
    columns = [c for c in stream.columns if c.lower() not in ("change", "version", "replaces", "__micros", "__bucket")]
    stream = stream.select(*columns)
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in stream.schema.fields], T.StructField("change", T.StringType()), T.StructField("version", T.LongType()), T.StructField("replaces", T.LongType())])
    timed = stream.withWatermark(at, late) if ttl_seconds is not None else stream
    processor = Tracker(columns, key, digest, None if ttl_seconds is None else 1000 * ttl_seconds)
    dealt = timed.withColumn("__micros", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    return dealt.groupBy("__bucket").transformWithState(processor, schema, "Append", "None" if ttl_seconds is None else "EventTime")


class Calendar(StatefulProcessor):
    """Of one source: its interval and the time it is due next, as a timer."""

    def __init__(self, source: str):
        self.source = source

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.every = handle.getValueState("every", "ms bigint, told bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        told, seconds = max(((r["__micros"] // 1000, r["every_seconds"]) for r in rows if r["every_seconds"] is not None and r["__micros"] is not None), default=(None, None))
        if told is not None:
            old = self.every.get()
            if old is None or told >= old[1]:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.every.update((max(0, 1000 * seconds), told))
                if seconds > 0:
                    self.handle.registerTimer(told + 1000 * seconds)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        every, due = self.every.get()[0], expiredTimerInfo.getExpiryTimeInMs()
        if every > 0:
            calls = range(due, max(due, timerValues.getCurrentWatermarkInMs()) + 1, every)
            self.handle.registerTimer(calls[-1] + every)
            yield from (Row(**{self.source: key[0], "ms": at}) for at in calls)

    def close(self) -> None:
        pass


def due_updates(orders: DataFrame, source: str = "source", late: str = "0 seconds") -> DataFrame:
    """(source, due): the times at which sources are due, from a stream of orders (source, every_seconds, at).

    An order starts a schedule from its time, or replaces the source's earlier one; an interval of 0 stops
    it; older orders that come late, and orders without an interval, are ignored. Rows of any other key
    (a null interval, say a clock's) move the watermark on, and with it the time up to which calls are made.
    """
    schema = T.StructType([T.StructField(source, orders.schema[source].dataType), T.StructField("ms", T.LongType())])
    timed = orders.withWatermark("at", late).withColumn("__micros", F.unix_micros("at"))
    called = timed.groupBy(source).transformWithState(Calendar(source), schema, "Append", "EventTime")
    return called.select(source, F.timestamp_millis("ms").alias("due"))
