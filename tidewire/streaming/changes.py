"""A stream of readings that emits changes only: of consecutive readings of equal value and source, the first.

Readings wait in keyed state until the watermark has passed them, so late ones take their place in order of time; a
timer for each time releases them. State holds a metric's last released reading and those that wait, so it is bounded by the
watermark's delay. A reading that comes again while it waits is one; one that comes after the watermark is dropped.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHANGE = "metric_key string, as_of timestamp, id long, value double, source string"


class _Changes(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "value double, source string")
        self.waiting = handle.getMapState("waiting", "at long, id long", "value double, source string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            for r in batch.itertuples(index=False):
                at = int(r.as_of.timestamp() * 1000)
                if at > passed:
                    self.waiting.updateValue((at, int(r.id)), (None if pd.isna(r.value) else float(r.value), r.source))
                    self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = sorted(k for k in self.waiting.keys() if k[0] <= expiredTimerInfo.getExpiryTimeInMs())  # noqa: SIM118
        out = []
        for at, i in due:
            now = tuple(self.waiting.getValue((at, i)))
            if not self.last.exists() or tuple(self.last.get()) != now:
                out.append((key[0], dt.datetime.fromtimestamp(at / 1000, tz=dt.UTC), i, *now))
                self.last.update(now)
            self.waiting.removeKey((at, i))
        if out:
            made = pd.DataFrame(out, columns=["metric_key", "as_of", "id", "value", "source"])
            yield made.astype({"value": "float64"})

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers asks for this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def changes(readings: DataFrame, late: str = "1 day") -> DataFrame:
    """metric_key, as_of, id, value, source of the readings (a stream of these columns) that differ from the one before."""
    rows = readings.select("metric_key", "as_of", "id", "value", "source").withWatermark("as_of", late)
    return rows.groupBy("metric_key").transformWithStateInPandas(_Changes(), CHANGE, "Append", "EventTime")
