"""Zone temperatures over a stream of readings, with state by zone and timers in event time.

Readings may come late, up to the watermark's delay, in any order and more than once. They wait in a list until the watermark
has passed them; a zone has one timer, for the first of them, and when it is due all that the watermark has passed are folded in time
order: the state that stays is one temperature, the time of the last reading folded, and a count. So a stream ends with the temperatures that ``zone_temperatures`` gives over the same readings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from citygeo.operators.thermal import CONSTANTS, facing_share, step_all

OUT = "zone_id long, ts timestamp, temp_k double, readings long"
NUMBERS = ["dt_s", "irradiance", "sun_x", "sun_y", "sun_z", "ambient_k", "sky_k", "wind"]
ZONE = ["temp_k", *CONSTANTS, "normal_x", "normal_y", "normal_z"]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DUE_US = 60_000_000  # timers are set to whole minutes of event time


class ZoneTemperature(StatefulProcessor):
    """State of a zone: its last temperature, its constants, and the readings that wait for the watermark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "temp_k double, ts long, readings long")
        self.zone = handle.getValueState("zone", ", ".join(f"{c} double" for c in ZONE))
        self.waiting = handle.getListState("waiting", "ts long, " + ", ".join(f"{c} double" for c in NUMBERS))

    def _wake(self, ts: int) -> None:
        """Sets the zone's timer to the minute of ts, unless it is set to an earlier one."""
        due = -(-ts // DUE_US) * (DUE_US // 1000)
        for set_to in list(self.handle.listTimers()):
            if set_to <= due:
                return
            self.handle.deleteTimer(set_to)
        self.handle.registerTimer(due)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()[1] if self.last.exists() else None
        known, least = self.zone.exists(), None
        for frame in rows:
            if not known:
                self.zone.update(tuple(float(v) for v in frame.iloc[0][ZONE]))
                known = True
            frame = frame if before is None else frame[frame["ts_us"] > before]  # others were told, or are later than the watermark allows
            frame = frame.sort_values(["ts_us", *NUMBERS], kind="stable").drop_duplicates("ts_us")
            if len(frame):
                self.waiting.appendList(list(zip(frame["ts_us"].tolist(), *(frame[c].astype(float).tolist() for c in NUMBERS))))
                first = int(frame["ts_us"].iloc[0])
                least = first if least is None else min(least, first)
        if least is not None:
            self._wake(least)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        waiting = {}
        for ts, *numbers in self.waiting.get():  # of several at one time the least counts
            numbers = tuple(numbers)
            if ts not in waiting or numbers < waiting[ts]:
                waiting[ts] = numbers
        ready = sorted(ts for ts in waiting if ts <= until)
        rest = [(ts, *numbers) for ts, numbers in waiting.items() if ts > until]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(-(-min(rest)[0] // DUE_US) * (DUE_US // 1000))
        else:
            self.waiting.clear()
        if not ready:
            return
        zone = dict(zip(ZONE, self.zone.get()))
        temp, _, n = self.last.get() if self.last.exists() else (zone["temp_k"], None, 0)
        series = np.array([waiting[ts] for ts in ready], float)
        normal = np.array([[zone["normal_x"], zone["normal_y"], zone["normal_z"]]])
        facing = facing_share(np.repeat(normal, len(series), axis=0), series[:, 2:5])
        constants = {c: np.array([zone[c]]) for c in CONSTANTS}
        state = np.array([temp])
        for row, share in zip(series, facing):
            numbers = dict(zip(NUMBERS, row))
            state = step_all(state, constants, share, numbers)
        self.last.update((float(state[0]), ready[-1], n + len(ready)))
        yield pd.DataFrame({"zone_id": [key[0]], "ts": [pd.Timestamp(ready[-1], unit="us")], "temp_k": [float(state[0])], "readings": [n + len(ready)]})

    def close(self) -> None:
        pass


def zone_temperatures_stream(zones: DataFrame, readings: DataFrame, late: str = "1 hour") -> DataFrame:
    """A row for each zone whenever the watermark has passed readings of it: zone_id, ts of the last reading, temp_k, readings so far.

    readings is a stream of (zone_id, ts, dt_s, irradiance, sun, ambient_k, sky_k, wind); zones is a static table with temp_k at the
    start and the constants. Readings later than the watermark are dropped; of several of a zone at one time the least counts.
    Append mode. State lies in RocksDB, so it may outgrow an executor's memory; the session's state store is set to it.
    """
    readings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    axis = lambda v: [F.coalesce(F.get(v, F.lit(i)), F.lit(0.0)).alias(f"{v}_{k}") for i, k in enumerate("xyz")]
    constants = zones.select("zone_id", "temp_k", *CONSTANTS, *axis("normal"))
    own = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).join(constants, "zone_id")
    numbers = ["zone_id", "ts", F.unix_micros("ts").alias("ts_us"), "dt_s", "irradiance", *axis("sun"), "ambient_k", "sky_k", "wind", *ZONE]
    return own.select(*numbers).groupBy("zone_id").transformWithStateInPandas(ZoneTemperature(), OUT, "append", "eventTime")
