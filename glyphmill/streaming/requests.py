"""Idempotent requests as a stream: a keyed log whose entries end by event time.

The batch form is :func:`glyphmill.operators.library.idempotent_requests`; outcomes are the same as long as
requests come in the order of their time up to the watermark's delay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

KEY = ["user_id", "scope", "key"]
OUT = "user_id string, scope string, key string, request_id string, outcome string"
STATE = StructType([StructField("request_hash", StringType()), StructField("ends", LongType())])
#: The store that keyed state with timers needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RequestLog(StatefulProcessor):
    """One entry a key: the hash of the request that ran, and when its lifetime ends (milliseconds).  A timer frees the key then."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entry = handle, handle.getValueState("request", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.entry.get()
        live, out = None if held is None else (held[0], held[1]), []
        batch = pd.concat(list(rows)).sort_values(["requested_at", "request_id"], kind="stable")
        times = batch["requested_at"].astype("datetime64[ms]").astype("int64")
        for at, request, body in zip(times, batch["request_id"], batch["request_hash"], strict=True):
            if live is None or at >= live[1]:
                if live is not None:
                    self.handle.deleteTimer(live[1])
                live = (body, int(at) + self.ttl)
                self.handle.registerTimer(live[1])
                out.append((*key, request, "RUN"))
            else:
                out.append((*key, request, "REPLAY" if body == live[0] else "CONFLICT"))
        self.entry.update(live)
        yield pd.DataFrame(out, columns=[*KEY, "request_id", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.entry.get()
        if held is not None and held[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        yield pd.DataFrame(columns=[*KEY, "request_id", "outcome"])

    def close(self) -> None:
        pass


def with_store(spark: SparkSession) -> SparkSession:
    """Sets the state store that :func:`request_outcomes` needs, for queries that start later."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return spark


def request_outcomes(requests: DataFrame, ttl_seconds: int = 86_400, delay: str = "10 minutes") -> DataFrame:
    """Outcome of each request of a stream (user_id, scope, key, request_id, request_hash, requested_at): RUN, REPLAY or CONFLICT.

    The first request of a key runs; until its lifetime ends, others replay it or, with another body, conflict.  Requests
    later than the watermark's ``delay`` are dropped.  State is one entry a live key and survives restarts with the checkpoint.
    """
    rows = requests.select(*[F.col(c).cast("string").alias(c) for c in KEY], F.col("request_id").cast("string").alias("request_id"), "request_hash", "requested_at")
    return rows.withWatermark("requested_at", delay).groupBy(*KEY).transformWithStateInPandas(RequestLog(ttl_seconds), OUT, "Append", "EventTime")
