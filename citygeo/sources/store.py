"""Graphs by region, mesh dumps, and the reuse of fetched files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of a mesh in a dump file.
DUMP = "kind string, label string, loc array<double>, v array<double>, t array<int>"
# Fields of a manifest file, and what they are called here.
MANIFEST = {
    "version": "version int", "demType": "dem_type string", "demPaddingDegrees": "padding_deg double", "osmFileSize": "osm_bytes long", "demFileSize": "dem_bytes long",
    "fetchedAtUtc": "fetched_at_utc string", "minLat": "min_lat double", "minLon": "min_lon double", "maxLat": "max_lat double", "maxLon": "max_lon double",
}
VERSION, PADDING_TOLERANCE = 1, 1e-9


def write_graph(graph: dict[str, DataFrame], path: str) -> None:
    """Each table of a graph as Parquet by region; regions written before are replaced, others stay."""
    for name, df in graph.items():
        df.write.partitionBy("region_key").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, names: list[str], region_key: str | None = None) -> dict[str, DataFrame]:
    """Tables of a graph; a region key prunes partitions."""
    out = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    return out if region_key is None else {n: df.filter(F.col("region_key") == region_key) for n, df in out.items()}


def write_mesh_dump(meshes: DataFrame, path: str) -> None:
    """meshes: kind, label, loc, v, t. A JSON object a line."""
    meshes.select("kind", "label", "loc", "v", "t").write.mode("overwrite").json(path)


def read_mesh_dump(spark: SparkSession, path: str) -> DataFrame:
    """Meshes of a dump; lines that are broken or no mesh (a header) are left out."""
    return spark.read.schema(DUMP).option("mode", "DROPMALFORMED").json(path).filter("kind is not null and v is not null")


def cache_key() -> Column:
    return F.md5(F.format_string("%.7f,%.7f,%.7f,%.7f", "min_lat", "min_lon", "max_lat", "max_lon"))


def cache_reusable(requests: DataFrame, manifests: DataFrame, files: DataFrame) -> DataFrame:
    """requests (request_id, box, dem_type, padding_deg) → request_id, reusable: the box's manifest has this version, raster type and
    padding, and files (cache_key, osm_length, dem_length) have the sizes recorded, over 0."""
    r = requests.withColumn("cache_key", cache_key())
    m = manifests.withColumn("cache_key", cache_key()).select("cache_key", "version", F.col("dem_type").alias("_type"), F.col("padding_deg").alias("_pad"), "osm_bytes", "dem_bytes").dropDuplicates(["cache_key"])
    own = r.join(m, "cache_key", "left").join(files, "cache_key", "left")
    same = (F.col("version") == VERSION) & (F.col("_type") == F.col("dem_type")) & (F.abs(F.col("_pad") - F.col("padding_deg")) <= PADDING_TOLERANCE)
    whole = (F.col("osm_bytes") > 0) & (F.col("osm_bytes") == F.col("osm_length")) & (F.col("dem_bytes") > 0) & (F.col("dem_bytes") == F.col("dem_length"))
    return own.select("request_id", F.coalesce(same & whole, F.lit(False)).alias("reusable"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """A row for each manifest file. Its numbers may be written as decimals; fields that it lacks are null."""
    numbers = {name: "string" if kind.endswith("string") else "double" for name, kind in MANIFEST.items()}
    rows = spark.read.schema(", ".join(f"{name} {kind}" for name, kind in numbers.items())).option("multiLine", True).json(path)
    return rows.select(*[F.col(name).cast(own.split()[1]).alias(own.split()[0]) for name, own in MANIFEST.items()])
