"""Surface temperatures: environment, zones, fluxes, and series of readings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from citygeo.functions.numbers import clamp
from citygeo.operators.materials import CATEGORIES, resolve_materials, with_material_props
from citygeo.operators.spatial import gathered, spread

SIGMA, DEFAULT_K, PEAK, SWING_K = 5.670374419e-8, 293.15, 1000.0, 15.0
STEP_K, MIN_K, MAX_K = 50.0, 220.0, 420.0
# Temperatures by category, in the order of CATEGORIES.
PRESETS = {"afternoon": [308.0, 308.5, 308.2, 308.1, 309.0, 307.8, 308.0, 308.5, 308.0, 319.5, 305.0, 301.5, 298.0, 296.0, 308.4, 318.0]}
# Emissivity, absorptivity, density, specific heat, thickness where a zone has no material.
PROFILES = {
    "Asphalt": (0.93, 0.90, 2400.0, 920.0, 0.2),
    "Concrete": (0.92, 0.60, 2300.0, 880.0, 0.2),
    "Soil": (0.92, 0.75, 1500.0, 1400.0, 0.2),
    "Grass": (0.95, 0.70, 300.0, 2500.0, 0.05),
    "Vegetation": (0.95, 0.70, 300.0, 2500.0, 0.05),
    "Water": (0.96, 0.85, 1000.0, 4184.0, 1.0),
}
OTHER_PROFILE = (0.90, 0.65, 2000.0, 800.0, 0.2)
PROFILE_NAMES = ["emissivity", "absorptivity", "density", "specific_heat", "thickness_m"]


def environment(df: DataFrame, hour: Column, base_c: Column | float = 25.0) -> DataFrame:
    """Adds irradiance (W/m²), sun (array of 3, pointing down by day), ambient_k for an hour of day; night outside 6 to 18."""
    base = (base_c if isinstance(base_c, Column) else F.lit(base_c)) + 273.15
    h = F.pmod(hour, F.lit(24.0))
    angle, phase = (h - 6) / 12 * math.pi, clamp((h - 8) / 12 * math.pi, 0.0, math.pi)
    night = (h < 6) | (h > 18)
    return df.withColumns({
        "irradiance": F.when(night, 0.0).otherwise(F.sin(angle) * PEAK),
        "sun": F.when(night, F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(0.0), F.cos(angle), -F.sin(angle))),
        "ambient_k": F.when(night, base).otherwise(base + F.sin(phase) * SWING_K),
    })


def thermal_zones(nodes: DataFrame) -> DataFrame:
    """node_id, section, category, area_m2, normal, base_temp_k and constants: wall and roof of a building, one for the rest."""
    own = resolve_materials(nodes.filter("node_type <> 'Junction'"))
    zone = lambda section, category, area, normal: F.struct(F.lit(section).alias("section"), category.alias("category"), area.alias("area_m2"), F.array(*[F.lit(float(v)) for v in normal]).alias("normal"))
    zones = F.when(F.col("node_type") == "Building", F.array(zone(0, F.col("wall"), F.lit(0.0), (1, 0, 0)), zone(1, F.col("roof"), F.lit(0.0), (0, 0, 1)))).otherwise(F.array(zone(0, F.col("surface"), F.col("metrics.area_m2"), (0, 0, 1))))
    out = own.select("region_key", "node_id", F.explode(zones).alias("z")).select("region_key", "node_id", "z.*")
    return with_material_props(out).withColumn("temp_k", F.col("base_temp_k"))


def with_profiles(zones: DataFrame) -> DataFrame:
    """Constants for zones that have only a category."""
    pick = lambda i: F.coalesce(*[F.when(F.col("category") == k, F.lit(v[i])) for k, v in PROFILES.items()], F.lit(OTHER_PROFILE[i]))
    return zones.withColumns({name: pick(i) for i, name in enumerate(PROFILE_NAMES)})


def _unit(v: Column) -> Column:
    length = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return F.transform(v, lambda x: F.when(length > 1e-8, F.try_divide(x, length)).otherwise(0.0))


def net_flux(temp: Column, emissivity: Column, absorptivity: Column, normal: Column, reading: Column) -> Column:
    """struct(solar, radiative, convective, net) in W/m². reading has irradiance, sun, ambient_k, sky_k, wind."""
    n, s = _unit(normal), _unit(reading["sun"])
    facing = F.greatest(-(n[0] * s[0] + n[1] * s[1] + n[2] * s[2]), F.lit(0.0))
    solar = absorptivity * reading["irradiance"] * facing
    radiative = emissivity * SIGMA * (temp * temp * temp * temp - F.pow(reading["sky_k"], 4))
    convective = (5.7 + 3.8 * F.greatest(reading["wind"], F.lit(0.0))) * (temp - reading["ambient_k"])
    return F.struct(solar.alias("solar"), radiative.alias("radiative"), convective.alias("convective"), (solar - radiative - convective).alias("net"))


READING = ["irradiance", "sun", "ambient_k", "sky_k", "wind"]


def zone_flux(zones: DataFrame) -> DataFrame:
    """Adds flux to zones that carry the columns of a reading."""
    reading = F.struct(*READING)
    return zones.withColumn("flux", net_flux(F.col("temp_k"), F.col("emissivity"), F.col("absorptivity"), F.col("normal"), reading))


def step_k(temp: Column, net: Column, capacity: Column, seconds: Column) -> Column:
    """Temperature after a time step: the change capped at ±50 K, the result kept in 220 to 420 K."""
    return clamp(temp + clamp(net / capacity * seconds, -STEP_K, STEP_K), MIN_K, MAX_K)


CONSTANTS = ["emissivity", "absorptivity", "density", "specific_heat", "thickness_m"]


def step_all(temp: np.ndarray, constants: dict[str, np.ndarray], facing: np.ndarray, r: dict[str, np.ndarray]) -> np.ndarray:
    """One step of many zones at once: ``net_flux`` and ``step_k`` over arrays, with the share of the sun that each zone faces."""
    net = constants["absorptivity"] * r["irradiance"] * facing - constants["emissivity"] * SIGMA * (temp**4 - r["sky_k"] ** 4) - (5.7 + 3.8 * np.maximum(r["wind"], 0.0)) * (temp - r["ambient_k"])
    change = net / (constants["density"] * constants["specific_heat"] * constants["thickness_m"]) * r["dt_s"]
    return np.clip(temp + np.clip(change, -STEP_K, STEP_K), MIN_K, MAX_K)


def facing_share(normal: np.ndarray, sun: np.ndarray) -> np.ndarray:
    """Share of the sun's light that falls on surfaces; both arguments have a row of three numbers for each."""

    def unit(v: np.ndarray) -> np.ndarray:
        length = np.sqrt((v * v).sum(axis=1, keepdims=True))
        return np.where(length > 1e-8, v / np.where(length > 1e-8, length, 1.0), 0.0)

    return np.maximum(-(unit(normal) * unit(sun)).sum(axis=1), 0.0)


def _vectors(column: pa.Array) -> np.ndarray:
    """Arrays of three numbers as rows; null and shorter ones are zero."""
    column = column.cast(pa.large_list(pa.float64()))
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    out = np.zeros((len(column), 3))
    owner = np.repeat(np.arange(len(column)), size)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
    flat = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False))
    out[owner[at < 3], at[at < 3]] = flat[at < 3]
    return out


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by zone, then the zone itself before its readings, these by time. Steps of a batch go over all its zones at once; the
    last zone of a batch is carried on as its temperature and constants alone."""
    carried: dict | None = None  # of the last zone: temp, constants, normal, time of the last reading, and its id and category as arrays

    def finished(zone: pa.Array, category: pa.Array, temp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([zone, category, pa.array(temp)], ["zone_id", "category", "temp_k"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        col = {name: batch.column(name) for name in batch.schema.names}
        zone, reading = col["zone_id"], col["reading"].to_numpy(zero_copy_only=False)
        new = np.r_[True, pc.not_equal(zone.slice(1), zone.slice(0, n - 1)).to_numpy(zero_copy_only=False)] if n > 1 else np.ones(1, bool)
        goes_on = carried is not None and zone[0] == carried["zone"][0]
        if carried is not None and not goes_on:
            yield finished(carried["zone"], carried["category"], np.array([carried["temp"]]))
        first = np.flatnonzero(new)
        seg = np.cumsum(new) - 1
        known = ~reading[first]
        number = lambda name: col[name].to_numpy(zero_copy_only=False)
        temp, normal = number("temp_k")[first], _vectors(col["normal"].take(pa.array(first)))
        constants = {name: number(name)[first] for name in CONSTANTS}
        names = col["category"].take(pa.array(first))
        if goes_on:
            known[0], temp[0], normal[0] = True, carried["temp"], carried["normal"]
            for name in CONSTANTS:
                constants[name][0] = carried["constants"][name]
        ts = col["ts"].cast(pa.int64()).fill_null(-1).to_numpy()
        fresh = np.r_[not goes_on or carried["ts"] is None or ts[0] != carried["ts"], new[1:] | (ts[1:] != ts[:-1]) | ~reading[:-1]]
        rows = np.flatnonzero(reading & fresh & known[seg])
        own = seg[rows]
        r = {name: number(name)[rows] for name in ("dt_s", "irradiance", "ambient_k", "sky_k", "wind")}
        facing = facing_share(normal[own], _vectors(col["sun"].take(pa.array(rows))))
        begins = np.flatnonzero(np.r_[True, np.diff(own) != 0]) if len(own) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[begins, len(own)])
        for k in range(int(counts.max()) if len(counts) else 0):
            if k:
                begins, counts = begins[counts > k], counts[counts > k]
            at = begins + k
            z = own[at]
            temp[z] = step_all(temp[z], {name: v[z] for name, v in constants.items()}, facing[at], {name: v[at] for name, v in r.items()})
        done = np.flatnonzero(known[:-1])
        if len(done):
            category = names.take(pa.array(done))
            if goes_on and done[0] == 0:
                category = pa.concat_arrays([carried["category"], category.slice(1)])
            yield finished(zone.take(pa.array(first[done])), category, temp[done])
        if known[-1]:
            only = goes_on and len(first) == 1
            seen = rows[own == len(first) - 1]
            carried = {
                "zone": zone.slice(first[-1], 1), "category": carried["category"] if only else names.slice(len(first) - 1, 1), "temp": float(temp[-1]), "normal": normal[-1],
                "constants": {name: float(v[-1]) for name, v in constants.items()}, "ts": int(ts[seen[-1]]) if len(seen) else carried["ts"] if only else None,
            }
        else:
            carried = None
    if carried is not None:
        yield finished(carried["zone"], carried["category"], np.array([carried["temp"]]))


def zone_temperatures(zones: DataFrame, readings: DataFrame) -> DataFrame:
    """zone_id, category, temp_k after all readings of the zone in time order. zones: one row a zone with category, temp_k, normal and
    the constants; readings: (zone_id, ts, dt_s, irradiance, sun, ambient_k, sky_k, wind).

    A reading counts once: of several of a zone at one time, the least by their columns. A zone without readings keeps its temperature;
    readings of no zone, and rows without zone_id or ts, are left out. Zones and readings are dealt by zone in one exchange and
    sorted in it, so what a task holds of a zone is its temperature, however many readings there are.
    """
    taken = ["dt_s", *READING]
    nothing = lambda df, names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    state = ["category", "temp_k", "normal", *CONSTANTS]
    own = zones.select("zone_id", F.lit(False).alias("reading"), *nothing(readings, ["ts", *taken]), *state)
    met = readings.filter("ts is not null").select("zone_id", F.lit(True).alias("reading"), "ts", *taken, *nothing(zones, state))
    rows = own.unionByName(met).filter("zone_id is not null").repartition("zone_id").sortWithinPartitions("zone_id", "reading", "ts", *taken)
    schema = StructType([StructField("zone_id", zones.schema["zone_id"].dataType), zones.schema["category"], StructField("temp_k", DoubleType())])
    return rows.mapInArrow(_folded, schema)


def zones_near(zones: DataFrame, sensors: DataFrame, range_m: float) -> DataFrame:
    """Pairs (zone_id, sensor_id) within a 3-D distance, border included; x, y, z in metres. Zones of one place are taken together, and
    so are sensors; places meet in an equi-join on cells of the range, and the pairs of ids are made in shares over all tasks."""
    size = max(range_m, 1e-6)
    near = F.sequence(F.lit(-1), F.lit(1))
    own = gathered(zones.select("zone_id", *"xyz"), [*"xyz"], "zone_id").withColumnRenamed("ids", "zones")
    own = own.withColumns({f"_{k}": F.floor(F.col(k) / size).cast("long") for k in "xyz"})
    far = gathered(sensors.select("sensor_id", *[F.col(k).alias(f"s{k}") for k in "xyz"]), ["sx", "sy", "sz"], "sensor_id").withColumnRenamed("ids", "sensors")
    about = lambda k: F.transform(near, lambda d: F.floor(F.col(f"s{k}") / size).cast("long") + d)
    for k in "xyz":
        far = far.withColumn(f"_{k}", F.explode(about(k)))
    d2 = sum(((F.col(k) - F.col(f"s{k}")) * (F.col(k) - F.col(f"s{k}")) for k in "xyz"), F.lit(0.0))
    met = spread(own.join(far, ["_x", "_y", "_z"]).filter(d2 <= range_m * range_m).select("zones", "sensors"), "zones", "sensors")
    return met.select("sensors", F.explode("zones").alias("zone_id")).select("zone_id", F.explode("sensors").alias("sensor_id"))


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(CATEGORIES)), "code int, category string")


def category_temps(zones: DataFrame, default_k: float = DEFAULT_K) -> DataFrame:
    """Mean temperature of each of the 16 categories; the default for those without zones."""
    own = zones.groupBy("category").agg(F.avg("temp_k").alias("mean_k"), F.count("*").alias("zones"))
    return categories(zones.sparkSession).join(own, "category", "left").select("code", "category", F.coalesce("mean_k", F.lit(default_k)).alias("temp_k"), F.coalesce("zones", F.lit(0)).alias("zones"))


def preset_temps(spark: SparkSession, name: str = "afternoon") -> DataFrame:
    return spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(zip(CATEGORIES, PRESETS[name]))], "code int, category string, temp_k double")


def zone_temp(zones: DataFrame, wanted: DataFrame) -> DataFrame:
    """Temperature by (node_id, section), 293.15 K if there is no such zone; the least section's zone counts once."""
    own = zones.groupBy("node_id", "section").agg(F.first("temp_k").alias("temp_k"))
    return wanted.join(own, ["node_id", "section"], "left").withColumn("temp_k", F.coalesce("temp_k", F.lit(DEFAULT_K)))
