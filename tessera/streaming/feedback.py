"""Online feedback: weights held within bounds, learnt from a stream of events as time settles them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from tessera.operators.learning import ROUTING, run_of_steps

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settled_runs(events: DataFrame, keys: list[str], step: str, at: str, order: list[str], size: str = "1 minute", late: str = "1 hour", bounds: tuple[float, float] = ROUTING) -> DataFrame:
    """keys, began, ended, n and the run (sum, low, high) of each window of a key that the watermark has closed.

    A window is one group of the streaming aggregation, so the events of a busy
    key are spread over as many tasks as it has windows; `size` bounds what one
    window holds. Events later than `late` behind the newest one are dropped.
    """
    steps = F.transform(F.array_sort(F.collect_list(F.struct(F.col(at), *order, F.col(step).cast("double").alias("_step")))), lambda x: x["_step"])
    windows = events.withWatermark(at, late).groupBy(*keys, F.window(at, size)).agg(F.count("*").alias("n"), steps.alias("steps"))
    return windows.select(*keys, F.col("window.start").alias("began"), F.col("window.end").alias("ended"), "n", run_of_steps("steps", bounds).alias("run"))


class BoundedFold(StatefulProcessor):
    """The weight of a key and how many events it has seen; both are the whole state."""

    def __init__(self, keys: list[str], start: float):
        self.keys, self.start = keys, float(start)

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "value double, events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        value, events = self.held.get() if self.held.exists() else (self.start, 0)
        runs = pd.concat(list(rows)).sort_values("began")
        for total, low, high, n in zip(runs["sum"], runs["low"], runs["high"], runs["n"], strict=True):
            value, events = min(high, max(low, value + total)), events + int(n)
        self.held.update((value, events))
        yield pd.DataFrame({**{c: [k] for c, k in zip(self.keys, key, strict=True)}, "settled": [runs["ended"].iloc[-1]], "events": [events], "value": [value]})

    def close(self) -> None:
        pass


def learnt_online(events: DataFrame, keys: list[str], step: str, at: str, order: list[str], size: str = "1 minute", late: str = "1 hour", start: float = 1.0, bounds: tuple[float, float] = ROUTING) -> DataFrame:
    """keys, settled, events, value: a row for a key whenever windows of it have closed, with its weight up to then.

    The weight is that of `learning.folded` over the same events: windows close in
    the order of time, a window's events become one run, and runs compose.
    """
    runs = settled_runs(events, keys, step, at, order, size, late, bounds).select(*keys, "began", "ended", "n", "run.sum", "run.low", "run.high")
    out = StructType([*(runs.schema[k] for k in keys), runs.schema["ended"]])
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out.fields[:-1])
    return runs.groupBy(*keys).transformWithStateInPandas(BoundedFold(keys, start), f"{names}, settled timestamp, events long, value double", "append", "none")


def start_learning(learnt: DataFrame, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends what `learnt_online` gives to a Parquet table; a batch that is run again appends nothing twice.

    The state of keys lives in RocksDB, the only store this operator has, and is
    saved under `checkpoint`, which driver and executors must share.
    """
    conf = learnt.sparkSession.conf
    before = conf.get(PROVIDER)
    conf.set(PROVIDER, ROCKS)
    try:
        return learnt.writeStream.format("parquet").outputMode("append").option("path", table).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        conf.set(PROVIDER, before)


def current_weights(table: DataFrame, keys: list[str]) -> DataFrame:
    """keys, settled, events, value: the last row of each key."""
    return table.groupBy(*keys).agg(F.max_by(F.struct("settled", "events", "value"), F.struct("settled", "events")).alias("last")).select(*keys, "last.*")
