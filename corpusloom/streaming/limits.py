"""Request limiting by key: an anchored fixed window, in batch and as a stateful stream.

A key's window opens with its first request and ends when a request comes more than ``window`` seconds later; that
request opens the next one. In a window at most ``limit`` requests pass, the others are rejected and not counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def step(anchor: int | None, count: int, now: int, window: int, limit: int) -> tuple[int, int, bool]:
    """(anchor, count, rejected) after a request at second ``now``."""
    if anchor is None or anchor < now - window:
        return now, 1, False
    if count >= limit:
        return anchor, count, True
    return anchor, count + 1, False


def limited(events: DataFrame, key: str, ts: str, tie: str, window: int = 60, limit: int = 30) -> DataFrame:
    """key, tie, rejected for every event. Tasks read their keys in order and hold one key's window at a time."""
    kind = events.schema[key].dataType.simpleString()
    width = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select(F.col(key).alias("k"), F.unix_timestamp(ts).alias("s"), F.col(tie).cast("long").alias("t"), F.col(ts).alias("x"))
    ordered = rows.repartition(width, "k").sortWithinPartitions("k", "x", "t").select("k", "s", "t")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, anchor, count, first = None, None, 0, True
        for pdf in batches:
            out = []
            for k, s in zip(pdf["k"].tolist(), pdf["s"].tolist()):
                if first or k != last:
                    last, anchor, count, first = k, None, 0, False
                anchor, count, rejected = step(anchor, count, s, window, limit)
                out.append(rejected)
            yield pd.DataFrame({key: pdf["k"], tie: pdf["t"], "rejected": out})

    return ordered.mapInPandas(scan, f"`{key}` {kind}, `{tie}` long, rejected boolean")


class LimitProcessor(StatefulProcessor):
    """The same over a stream: state is (anchor, count) of a key."""

    def __init__(self, window: int = 60, limit: int = 30):
        self.window, self.limit = window, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "anchor long, count long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        anchor, count = self.state.get() if self.state.exists() else (None, 0)
        pdf = pd.concat(list(rows)).sort_values(["s", "t"])
        out = []
        for s in pdf["s"].tolist():
            anchor, count, rejected = step(anchor, count, s, self.window, self.limit)
            out.append(rejected)
        self.state.update((anchor, count))
        yield pd.DataFrame({"k": [key[0]] * len(pdf), "t": pdf["t"], "rejected": out})

    def close(self) -> None:
        pass


def limited_stream(events: DataFrame, key: str, ts: str, tie: str, window: int = 60, limit: int = 30) -> DataFrame:
    """k, t (the tie column), rejected as a stream; needs the RocksDB state store."""
    rows = events.select(F.col(key).cast("string").alias("k"), F.unix_timestamp(ts).alias("s"), F.col(tie).cast("long").alias("t"))
    return rows.groupBy("k").transformWithStateInPandas(LimitProcessor(window, limit), "k string, t long, rejected boolean", "Append", "None")
