"""Series of readings, in one pass and over a stream."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citygeo.operators import materials as K
from citygeo.operators import thermal as H
from citygeo.streaming.thermal_stream import zone_temperatures_stream

READING = "zone_id long, ts timestamp, dt_s double, irradiance double, sun array<double>, ambient_k double, sky_k double, wind double"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def zones(spark):
    own = spark.createDataFrame([(1, "Asphalt"), (2, "Soil"), (3, "Water"), (4, "Glass"), (99, "Metal")], "zone_id long, category string")
    return K.with_material_props(own).withColumns({"normal": F.array(F.lit(0.0), F.lit(0.6), F.lit(0.8)), "temp_k": F.lit(293.15)})


def series(zone, minutes, seed):
    r = random.Random(seed)
    return [(zone, START + timedelta(minutes=m), 60.0, r.uniform(0, 900), [0.0, r.random(), -1.0], 300.0 + r.random(), 285.0, r.uniform(-1, 4)) for m in minutes]


def plain(zone, rows):
    """Reading after reading; of several at one time the least."""
    temp, last = zone.temp_k, None
    unit = lambda v: [x / sum(y * y for y in v) ** 0.5 for x in v]
    for _, ts, dt, irradiance, sun, ambient, sky, wind in sorted(rows, key=lambda r: r[1:]):
        if ts == last:
            continue
        last = ts
        facing = max(0.0, -sum(a * b for a, b in zip(unit(zone.normal), unit(sun))))
        net = zone.absorptivity * irradiance * facing - zone.emissivity * H.SIGMA * (temp**4 - sky**4) - (5.7 + 3.8 * max(wind, 0.0)) * (temp - ambient)
        temp = min(max(temp + min(max(net / (zone.density * zone.specific_heat * zone.thickness_m) * dt, -50.0), 50.0), 220.0), 420.0)
    return temp


def test_fold_equals_one_reading_after_another(spark, zones):
    rows = series(1, range(500), 1) + series(2, range(0, 90, 3), 2) + series(1, range(10, 20), 3) + series(7, range(5), 4) + series(2, [6], 2) + [(None, START, 1.0, 0.0, None, 0.0, 0.0, 0.0), (1, None, 1.0, 0.0, None, 0.0, 0.0, 0.0)]
    random.Random(5).shuffle(rows)
    readings = spark.createDataFrame(rows, READING)
    own = {z.zone_id: z for z in zones.collect()}
    want = {k: plain(z, [r for r in rows if r[0] == k and r[1]]) for k, z in own.items()}
    for size in ("10000", "7"):  # also where a zone is cut over many batches
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        got = {r.zone_id: (r.category, r.temp_k) for r in H.zone_temperatures(zones, readings).collect()}
        assert {k: c for k, (c, _) in got.items()} == {k: z.category for k, z in own.items()}
        assert all(abs(got[k][1] - want[k]) < 1e-9 for k in want)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert H.zone_temperatures(zones.limit(0), readings).count() == 0
    assert {r.temp_k for r in H.zone_temperatures(zones, readings.limit(0)).collect()} == {293.15}


def test_one_zone_of_many_readings_is_held_as_one_number():
    """A zone of 200,000 readings in 20 batches: only finished zones are put out, and what is carried has no array of readings."""
    n = 10_000
    names = ["zone_id", "reading", "ts", "dt_s", *H.READING, "category", "temp_k", "normal", *H.CONSTANTS]

    def batches():
        for k in range(20):
            first = k == 0
            state = [pa.array(["Soil" if first and i == 0 else None for i in range(n)]), pa.array([300.0 if first and i == 0 else None for i in range(n)]), pa.array([[0.0, 0.0, 1.0] if first and i == 0 else None for i in range(n)], pa.list_(pa.float64()))]
            state += [pa.array([v if first and i == 0 else None for i in range(n)], pa.float64()) for v in (0.9, 0.7, 1500.0, 1400.0, 0.2)]
            ts = pa.array(np.arange(k * n, (k + 1) * n) * 1_000_000, pa.timestamp("us"))
            reading = pa.array(np.r_[not first, np.ones(n - 1, bool)])
            sun = pa.array([[0.0, 0.0, -1.0]] * n, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, 5)), reading, ts, pa.array(np.ones(n)), pa.array(np.full(n, 500.0)), sun, *(pa.array(np.full(n, v)) for v in (300.0, 290.0, 1.0)), *state], names)

    found = [b for b in H._folded(batches()) if b.num_rows]
    assert len(found) == 1 and found[0].column(0).to_pylist() == [5] and 300.0 < found[0].column(2).to_pylist()[0] < 420.0


def test_stream_equals_batch_with_late_and_repeated_readings(spark, zones, tmp_path):
    first, late = series(1, range(0, 60, 2), 1) + series(2, range(60), 2), series(1, range(1, 60, 2), 3)
    told_again = series(2, range(60), 2)[10:30] + series(1, range(10, 20), 9)
    last = series(3, range(70, 100), 4) + series(99, [5000], 5)  # the last one moves the watermark beyond all others
    for k, rows in enumerate((first, late + told_again, last)):
        spark.createDataFrame(rows, READING).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    schema = spark.read.parquet(str(tmp_path / "in" / "0")).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    found = zone_temperatures_stream(zones, source, "2 hours")
    query = found.writeStream.outputMode("append").format("memory").queryName("zone_stream").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None and len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    last_rows = {r.zone_id: r.r for r in spark.table("zone_stream").groupBy("zone_id").agg(F.max_by(F.struct("temp_k", "readings"), "ts").alias("r")).collect()}
    own = {z.zone_id: z for z in zones.collect()}
    every = first + late + told_again + last
    assert set(last_rows) == {1, 2, 3}
    for k in last_rows:
        mine = [r for r in every if r[0] == k]
        assert last_rows[k].readings == len({r[1] for r in mine}) and abs(last_rows[k].temp_k - plain(own[k], mine)) < 1e-9
    batch = {r.zone_id: r.temp_k for r in H.zone_temperatures(zones, spark.createDataFrame(every, READING)).collect()}
    assert all(abs(batch[k] - last_rows[k].temp_k) < 1e-9 for k in last_rows)
