"""State that ends: active sessions, trailing verification and expiring caches, with list and value state and event-time timers.

Processors keep what they know of a key in the state store until a timer ends it, so state
grows with what is active, not with all that ever came. Timers are never taken back: one
that later rows have put off finds so in the state and does nothing.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..storage import shared_dir

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSION = "key long, started timestamp, ended timestamp, n long, names string"
DUE = "key long, item string, since timestamp"
CACHED = "key long, value double, hit boolean"


# the state server's own Python doesn't get the driver's search path: processors are sent whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class ActiveNames(StatefulProcessor):
    """What a key (a session) has named since it was last idle for `idle_ms`. A session is reported when it ends: its names, distinct and in order."""

    def __init__(self, idle_ms: int):
        self.idle = idle_ms
        self.schema = T.StructType.fromDDL("name string, micros long")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("named", self.schema)

    def report(self, key: Any, sessions: list[list[tuple[str, int]]]) -> pd.DataFrame:
        """A row for each session, in one table: Spark takes as long for a table of one row as for one of thousands."""
        at = lambda k: pd.to_datetime([s[k][1] for s in sessions], unit="us")
        names = [",".join(sorted({n for n, _ in s})) for s in sessions]
        return pd.DataFrame({"key": [key[0]] * len(sessions), "started": at(0), "ended": at(-1), "n": [len(s) for s in sessions], "names": names})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        all_ = [(r[0], r[1]) for r in self.held.get()] if self.held.exists() else []
        for b in rows:
            all_ += zip(b["name"].tolist(), (b["ts"].astype("datetime64[us]").astype("int64")).tolist(), strict=True)
        all_.sort(key=lambda r: (r[1], r[0]))
        begin, ended = 0, []
        for k in range(1, len(all_)):
            if all_[k][1] - all_[k - 1][1] > self.idle * 1000:
                ended.append(all_[begin:k])
                begin = k
        self.held.put(all_[begin:])
        self.handle.registerTimer(all_[-1][1] // 1000 + self.idle)
        if ended:
            yield self.report(key, ended)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        rows = [(r[0], r[1]) for r in self.held.get()] if self.held.exists() else []
        # a timer that later rows have put off does nothing
        if rows and rows[-1][1] // 1000 + self.idle <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
            yield self.report(key, [rows])

    def close(self) -> None:
        pass


class TrailingVerifier(StatefulProcessor):
    """The latest item of a key, once no newer one has come for `wait_ms`: then it is due for verification, and forgotten."""

    def __init__(self, wait_ms: int):
        self.wait = wait_ms
        self.schema = T.StructType.fromDDL("item string, micros long")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best = tuple(self.latest.get()) if self.latest.exists() else None
        for b in rows:
            for item, us in zip(b["item"].tolist(), b["ts"].astype("datetime64[us]").astype("int64").tolist(), strict=True):
                if best is None or (us, item) > (best[1], best[0]):
                    best = (item, us)
        self.latest.update(best)
        self.handle.registerTimer(best[1] // 1000 + self.wait)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.latest.exists():
            item, us = self.latest.get()
            if us // 1000 + self.wait > expiredTimerInfo.getExpiryTimeInMs():  # put off by a later item
                return
            self.latest.clear()
            yield pd.DataFrame({"key": [key[0]], "item": [item], "since": [pd.Timestamp(us, unit="us")]})

    def close(self) -> None:
        pass


class ExpiringCache(StatefulProcessor):
    """Requests of a key in their order: the value that is held, or the one that the request brings, which is then held for `ttl_ms` of event time."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms
        self.schema = T.StructType.fromDDL("value double, until long")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("value", self.schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        value, until = tuple(self.held.get()) if self.held.exists() else (None, 0)
        asked = sorted((ms, v) for b in rows for ms, v in zip(b["ts"].astype("datetime64[ms]").astype("int64").tolist(), b["value"].tolist(), strict=True))
        out = []
        for ms, v in asked:
            hit = value is not None and ms < until
            if not hit:
                value, until = v, ms + self.ttl
            out.append((key[0], value, hit))
        self.held.update((value, until))
        self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=["key", "value", "hit"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.held.exists() and self.held.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def run(stream: DataFrame, processor: StatefulProcessor, out: str, name: str, path: str | None = None) -> DataFrame:
    """Drain a stream (key: long, ts, and what the processor reads) through a processor and read what it gave; the same path goes on where it ended.

    The stream needs a watermark on ts. The state store is RocksDB for this stream alone.
    """
    spark = stream.sparkSession
    base = path or f"{shared_dir(spark)}/state-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(PROVIDER)

    def put(batch: DataFrame, n: int) -> None:
        # a batch that runs again writes the same folder again
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")

    spark.conf.set(PROVIDER, ROCKS)
    try:
        states = stream.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Update", timeMode="EventTime")
        q = states.writeStream.outputMode("update").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(put).start()
        q.awaitTermination()
        if q.exception():
            raise q.exception()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(out).parquet(f"{base}/out/batch=*")
