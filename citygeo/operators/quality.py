"""Gates: issues (scope, severity, code, message, element_id) about parsed data, rasters and both together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citygeo.functions.geo import M_PER_DEGREE
from citygeo.functions.numbers import finite
from citygeo.operators.components import components
from citygeo.operators.cut import cut
from citygeo.operators.region import BOX, box_relations, dem_coverage, region_extent, regions_from_bbox, tile_bounds
from citygeo.sources.dem import read_files

ISSUE = "scope string, severity string, code string, message string, element_id long"
SEVERITIES = ["Fatal", "Warning", "Info"]
OVERSIZED, LEAST_COVERAGE = 3.0, 0.9
MIN_ELEVATION, MAX_ELEVATION, MOST_VOID = -500.0, 9000.0, 0.5
GROUP_DEG = 0.02  # nodes in cells of this size that touch lie together


def issue(when: Column, scope: Column | str, severity: str, code: str, message: Column | str, element: Column | None = None) -> Column:
    """An issue struct where the condition holds, else null."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    element = F.lit(None).cast("long") if element is None else element.cast("long")
    return F.when(when, F.struct(lit(scope).alias("scope"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), lit(message).alias("message"), element.alias("element_id")))


def issues_of(df: DataFrame, *issues: Column) -> DataFrame:
    return df.select(F.explode(F.array_compact(F.array(*issues))).alias("i")).select("i.*")


def union_issues(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _by(df: DataFrame, by: str | None) -> DataFrame:
    """df with its source as column source; without one all rows are of the source ``all``."""
    return df.withColumn("source", F.lit("all") if by is None else F.coalesce(F.col(by).cast("string"), F.lit("")))


def parsed_counts_issues(nodes: DataFrame, ways: DataFrame, by: str | None = None, relations: DataFrame | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Empty gates of each source: no nodes; or else nodes, but no ways or relations. by: the column of nodes, ways and relations that
    names their source. sources (source): those that may have no row in any of them."""
    count = lambda df, name: _by(df, by).groupBy("source").agg(F.count("*").alias(name))
    counts = count(nodes, "nodes").join(count(ways, "ways"), "source", "full")
    shapes = F.coalesce("ways", F.lit(0))
    if relations is not None:
        counts, shapes = counts.join(count(relations, "relations"), "source", "full"), shapes + F.coalesce("relations", F.lit(0))
    if by is None or sources is not None:
        counts = (nodes.sparkSession.createDataFrame([("all",)], "source string") if by is None else sources.select("source").distinct()).join(counts, "source", "left" if by is None else "full")
    none = F.coalesce("nodes", F.lit(0)) == 0
    return issues_of(counts, issue(none, F.col("source"), "Fatal", "osm.nodes.none", "no nodes"), issue(~none & (shapes == 0), F.col("source"), "Fatal", "osm.ways.none", "nodes, but no ways or relations"))


def region_issues(regions: DataFrame, code: str = "osm.region.invalid") -> DataFrame:
    """Boxes that are no region."""
    return issues_of(regions_from_bbox(regions), issue(F.col("error").isNotNull(), F.col("region_key"), "Fatal", code, F.coalesce("error", F.lit(""))))


def bad_coordinate() -> Column:
    return ~(finite(F.col("lat")) & finite(F.col("lon"))) | (F.abs("lat") > 90) | (F.abs("lon") > 180)


def coord_issues(nodes: DataFrame, by: str | None = None) -> DataFrame:
    """One issue for each source with coordinates that are not finite or out of range, with the least bad id."""
    bad = _by(nodes, by).filter(bad_coordinate()).groupBy("source").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return issues_of(bad, issue(F.col("n") > 0, F.col("source"), "Fatal", "osm.coords.invalid", F.concat(F.col("n").cast("string"), F.lit(" nodes have bad coordinates")), F.col("first")))


def data_groups(nodes: DataFrame, way_nodes: DataFrame | None = None, by: str | None = None, cell: float = GROUP_DEG) -> DataFrame:
    """source, group_id, n_nodes and bounds of groups of nodes: places that lie together, by occupied cells that touch each other or share a
    way. Two cities in one file are two groups. Nodes without good coordinates are in none."""
    own = _by(nodes.filter(~bad_coordinate()), by)
    own = own.withColumns({"_row": F.floor(F.col("lat") / cell).cast("long"), "_col": F.floor(F.col("lon") / cell).cast("long")})
    own = own.withColumn("cell", F.xxhash64("source", "_row", "_col"))
    cells = own.groupBy("cell", "source", "_row", "_col").agg(F.count("*").alias("n"), *[f(k).alias(f"{n}_{k}") for n, f in (("min", F.min), ("max", F.max)) for k in ("lat", "lon")])
    cells = cut(cells)
    beside = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))])
    touch = cells.select("cell", "source", "_row", "_col", F.explode(beside).alias("d")).select(F.col("cell").alias("a"), F.xxhash64("source", F.col("_row") + F.col("d.r"), F.col("_col") + F.col("d.c")).alias("b"))
    edges = touch.join(cells.select(F.col("cell").alias("b")), "b", "left_semi").select("a", "b")
    if way_nodes is not None:
        met = _by(way_nodes, by).select("source", "way_id", F.col("node_id").alias("id")).join(own.select("source", "id", "cell"), ["source", "id"])
        spans = met.groupBy("source", "way_id").agg(F.min("cell").alias("a"), F.max("cell").alias("z")).filter("a <> z").select("source", "way_id", "a")
        edges = edges.unionByName(met.join(spans, ["source", "way_id"]).select("a", F.col("cell").alias("b")).distinct())
    groups = cells.join(components(cells.select(F.col("cell").alias("node")), edges).toDF("cell", "group_id"), "cell").groupBy("source", "group_id")
    return groups.agg(F.sum("n").alias("n_nodes"), *[f(c).alias(c) for f, c in ((F.min, "min_lat"), (F.min, "min_lon"), (F.max, "max_lat"), (F.max, "max_lon"))])


def region_data(groups: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What data belongs to which region: bounds by region_key, and pairs (region_key, source).

    A group belongs to the regions that its bounds touch. What touches none belongs to all regions that its source has other groups in, as a
    road that leaves the region belongs to it.
    """
    boxed = groups.withColumn("region_key", F.col("group_id"))
    met = box_relations(boxed, regions).select(F.col("a_key").alias("group_id"), F.col("b_key").alias("region_key"))
    met = cut(groups.join(met, "group_id").select("region_key", "group_id", "source", *BOX))
    pairs = met.select("region_key", "source").distinct()
    box = [f(c).alias(c) for f, c in zip((F.min, F.min, F.max, F.max), BOX)]
    strays = groups.join(met.select("group_id").distinct(), "group_id", "left_anti").groupBy("source").agg(*box)
    every = met.select("region_key", *BOX).unionByName(strays.join(pairs, "source").select("region_key", *BOX))
    return every.groupBy("region_key").agg(*box), pairs


def bounds_issues(nodes: DataFrame, regions: DataFrame, way_nodes: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """Each region against the data that belongs to it (region_data): no region; degenerate, disjoint, or over three times its area."""
    groups = cut(data_groups(nodes, way_nodes, by))
    return region_issues(regions).unionByName(_bounds_issues(groups, region_data(groups, regions)[0], regions_from_bbox(regions).filter("error is null").drop("error")))


def _bounds_issues(groups: DataFrame, seen: DataFrame, regions: DataFrame) -> DataFrame:
    extent = groups.agg(F.count_if((F.col("max_lat") > F.col("min_lat")) & (F.col("max_lon") > F.col("min_lon"))).alias("_wide"))  # one row
    data = region_extent(regions_from_bbox(seen, limits=False)).select("region_key", *[F.col(c).alias(f"d_{c}") for c in ("area_km2", "error")], F.lit(True).alias("_met"))
    both = region_extent(regions).join(data, "region_key", "left").join(F.broadcast(extent))
    met, key = F.coalesce("_met", F.lit(False)), F.col("region_key")
    flat = (met & F.col("d_error").isNotNull()) | (~met & (F.col("_wide") == 0))
    return issues_of(
        both,
        issue(flat, key, "Fatal", "osm.bounds.degenerate", "data has no extent"),
        issue(~flat & ~met, key, "Fatal", "osm.bounds.disjoint", "data lies outside the region"),
        issue(~flat & met & (F.col("d_area_km2") > OVERSIZED * F.col("area_km2")), key, "Warning", "osm.bounds.oversized", "data is far larger than the region"),
    )


def dangling_refs(way_nodes: DataFrame, nodes: DataFrame, by: str | None = None) -> DataFrame:
    """ways_affected and refs_missing (of each source, if by names it): every occurrence of a reference without node counts."""
    keys = [by] if by else []
    lost = way_nodes.join(nodes.select(*keys, F.col("id").alias("node_id")), [*keys, "node_id"], "left_anti")
    return lost.groupBy(*keys, "way_id").count().groupBy(*keys).agg(F.count("*").alias("ways_affected"), F.coalesce(F.sum("count"), F.lit(0)).alias("refs_missing"))


def dangling_issues(way_nodes: DataFrame, nodes: DataFrame, by: str | None = None) -> DataFrame:
    message = F.format_string("%d ways miss %d nodes", "ways_affected", "refs_missing")
    scope = F.col(by).cast("string") if by else "all"
    return issues_of(dangling_refs(way_nodes, nodes, by), issue(F.col("refs_missing") > 0, scope, "Warning", "osm.refs.dangling", message))


def dem_stats(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """Per tile: n_pixels, min_elev, max_elev, void_share (within 0.5 of NoData, NaN or infinite), m_per_pixel, complete."""
    own = pixels.join(tiles.select("tile_id", "nodata", "has_nodata", "width", "height", "gt"), "tile_id")
    value = F.col("elev").cast("double")
    void = ~finite(value) | (F.col("has_nodata") & (F.abs(value - F.col("nodata")) < 0.5))
    stats = own.groupBy("tile_id").agg(
        F.count("*").alias("n_pixels"), F.min(F.when(~void, value)).alias("min_elev"), F.max(F.when(~void, value)).alias("max_elev"),
        F.count_if(void).alias("n_void"), F.first("width").alias("width"), F.first("height").alias("height"), F.first("gt").alias("gt"),
    )
    middle = F.col("gt")[3] + F.col("height") / 2 * F.col("gt")[5]
    metres = (F.abs(F.col("gt")[1]) * M_PER_DEGREE * F.cos(F.radians(middle))).alias("m_per_pixel")
    return stats.select("tile_id", "n_pixels", "min_elev", "max_elev", "n_void", (F.col("n_void") / F.col("n_pixels")).alias("void_share"), metres, (F.col("n_pixels") == F.col("width") * F.col("height")).alias("complete"))


def dem_issues(pixels: DataFrame, tiles: DataFrame) -> DataFrame:
    """Rasters by their pixels; a raster without any is incomplete. After a fatal issue a raster has no other."""
    boxes = regions_from_bbox(tile_bounds(tiles), limits=False).select("tile_id", F.col("error").isNotNull().alias("flat"))
    s = boxes.join(dem_stats(pixels, tiles), "tile_id", "left")
    key, whole, flat = F.col("tile_id"), F.coalesce("complete", F.lit(False)), F.col("flat")
    some = F.coalesce(F.col("n_void") < F.col("n_pixels"), F.lit(False))
    good = whole & ~flat & some
    return issues_of(
        s,
        issue(~whole, key, "Fatal", "tif.raster.incomplete", "pixels are missing"),
        issue(whole & flat, key, "Fatal", "tif.bounds.degenerate", "raster has no extent on earth"),
        issue(whole & ~flat & ~some, key, "Fatal", "tif.elevation.allnodata", "no pixel has a height"),
        issue(good & ((F.col("min_elev") < MIN_ELEVATION) | (F.col("max_elev") > MAX_ELEVATION)), key, "Warning", "tif.elevation.implausible", "heights are not of this earth"),
        issue(good & (F.col("void_share") > MOST_VOID), key, "Warning", "tif.nodata.excessive", "over half the pixels have no height"),
    )


def dem_header_issues(headers: DataFrame) -> DataFrame:
    """headers: tile_id, bits, sample_format, bands, compression, tiles, strips, has_geotags, pixel_scale, pixel_scale_y, origin_lat, origin_lon."""
    c, key = F.col, F.col("tile_id")
    fatal = lambda when, code, message: issue(when, key, "Fatal", code, message)
    plausible = F.abs("pixel_scale").between(1e-6, 0.01) & F.abs("pixel_scale_y").between(1e-6, 0.01)
    return issues_of(
        headers,
        fatal(~c("bits").isin(16, 32), "tif.bitdepth.unsupported", "samples are not 16 or 32 bits"),
        fatal(~c("sample_format").isin(1, 2, 3), "tif.sampleformat.unsupported", "samples are not numbers"),
        fatal((c("sample_format") == 3) & (c("bits") != 32), "tif.sampleformat.mismatch", "floats are not of 32 bits"),
        issue(c("bands") > 1, key, "Warning", "tif.bands.multiple", "only the first band is read"),
        fatal(~c("compression").isin(1, 8, 32946), "tif.compression.unsupported", "compression is not supported"),
        fatal(c("tiles") > 1, "tif.layout.multitile", "more than one tile"),
        fatal((c("tiles") == 0) & (c("strips") == 0), "tif.layout.nooffsets", "neither strips nor tiles"),
        fatal(~c("has_geotags"), "tif.geotags.missing", "no georeference"),
        fatal(c("has_geotags") & ~plausible, "tif.pixelscale.implausible", "pixels are not in degrees"),
        fatal(c("has_geotags") & ((F.abs("origin_lat") > 90) | (F.abs("origin_lon") > 180)), "tif.origin.outofrange", "origin is not on earth"),
    )


def raster_cover(tiles: DataFrame, regions: DataFrame) -> DataFrame:
    """Share of each region that rasters cover together: region_key, covered (0 where none does). Overlaps count once: the region is cut
    into strips at the rasters' borders, and in each strip their longitudes are joined. Work in a row grows with the rasters of a region."""
    own = tile_bounds(tiles).withColumn("region_key", F.col("tile_id"))
    pairs = box_relations(own, regions).filter("intersects").select(F.col("a_key").alias("tile_id"), F.col("b_key").alias("region_key"))
    boxes = pairs.join(own.select("tile_id", *[F.col(k).alias(f"t_{k}") for k in BOX]), "tile_id").join(regions.select("region_key", *BOX), "region_key")
    part = F.struct(F.greatest("t_min_lon", "min_lon").alias("west"), F.least("t_max_lon", "max_lon").alias("east"), F.greatest("t_min_lat", "min_lat").alias("south"), F.least("t_max_lat", "max_lat").alias("north"))
    found = boxes.select("region_key", part.alias("b")).groupBy("region_key").agg(F.sort_array(F.collect_list("b")).alias("boxes"))
    edges = F.array_sort(F.array_distinct(F.concat(F.transform("boxes", lambda b: b["south"]), F.transform("boxes", lambda b: b["north"]))))

    def strip(i: Column) -> Column:
        low, high = F.col("edges")[i], F.col("edges")[i + 1]
        nothing = F.struct(F.lit(-1000.0).alias("end"), F.lit(0.0).alias("wide"))
        joined = F.aggregate(F.filter("boxes", lambda b: (b["south"] <= low) & (b["north"] >= high)), nothing, lambda at, b: F.struct(F.greatest(at["end"], b["east"]).alias("end"), (at["wide"] + F.greatest(b["east"] - F.greatest(at["end"], b["west"]), F.lit(0.0))).alias("wide")))
        return (high - low) * joined["wide"]

    area = F.aggregate(F.transform(F.sequence(F.lit(0), F.size("edges") - 2), strip), F.lit(0.0), lambda a, v: a + v)
    found = found.withColumn("edges", edges).select("region_key", area.alias("area"))
    share = F.coalesce(F.try_divide(F.col("area"), (F.col("max_lat") - F.col("min_lat")) * (F.col("max_lon") - F.col("min_lon"))), F.lit(0.0))
    return regions.join(found, "region_key", "left").select("region_key", F.least(share, F.lit(1.0)).alias("covered"))


def cross_file_issues(seen: DataFrame, regions: DataFrame, tiles: DataFrame) -> DataFrame:
    """Rasters against regions and their data (region_data): data and rasters apart, or under 90 % of the region covered, is fatal; partial cover
    warns. Rasters without extent are told and left out."""
    checked = regions_from_bbox(tile_bounds(tiles), limits=False)
    good = tiles.join(checked.filter("error is null").select("tile_id"), "tile_id", "left_semi")
    flat = issues_of(checked, issue(F.col("error").isNotNull(), F.col("tile_id"), "Fatal", "cross.dem.bounds.invalid", "raster has no extent on earth"))
    boxes = tile_bounds(good).withColumn("region_key", F.col("tile_id"))
    met = box_relations(boxes, seen).filter("intersects").select(F.col("b_key").alias("region_key")).distinct().withColumn("_met", F.lit(True))
    known = seen.select("region_key").withColumn("_known", F.lit(True))
    both = raster_cover(good, regions).join(known, "region_key", "left").join(met, "region_key", "left")
    apart, share, key = F.col("_known").isNotNull() & F.col("_met").isNull(), F.col("covered"), F.col("region_key")
    return flat.unionByName(
        issues_of(
            both,
            issue(apart, key, "Fatal", "cross.files.disjoint", "raster and map do not meet"),
            issue(~apart & (share < LEAST_COVERAGE), key, "Fatal", "cross.dem.coverage.insufficient", "raster covers too little"),
            issue(~apart & (share >= LEAST_COVERAGE) & (share < 1 - 1e-9), key, "Warning", "cross.dem.coverage.partial", "raster does not cover all"),
        )
    )


def issue_summary(issues: DataFrame) -> DataFrame:
    """Per scope: counts by severity, the first code of each, accepted (nothing fatal)."""
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in SEVERITIES]
    firsts = [F.min(F.when(F.col("severity") == s, F.col("code"))).alias(f"first_{s.lower()}") for s in SEVERITIES[:2]]
    return issues.groupBy("scope").agg(*counts, *firsts).withColumn("accepted", F.col("n_fatal") == 0)


def has_code(issues: DataFrame, code: str) -> DataFrame:
    return issues.groupBy("scope").agg(F.bool_or(F.col("code") == code).alias("has_code"))


def fatal_first(issues: DataFrame) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return issues.orderBy(order, "scope", "code", "element_id")


STAGES = ["region", "counts", "coordinates", "bounds", "references", "raster", "both", "features"]


def import_report(nodes: DataFrame, way_nodes: DataFrame, features: DataFrame, regions: DataFrame, tiles: DataFrame | None = None, pixels: DataFrame | None = None, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Issues of all gates (with stage, a place in STAGES), and features of each region by type. features have region_key.

    What a fatal issue stops follows from what depends on what: a region depends on itself, on the sources (``by``) that have data in it, and
    on the rasters that cover a part of it; all depend on the source ``all``. A region's issues end with the first stage at which
    something that it depends on is fatal. A source or a raster ends with its own first fatal stage, and is only looked at as long as
    a region that depends on it goes on; one that no region depends on is looked at for itself.
    """
    stage = {name: k for k, name in enumerate(STAGES)}
    groups = cut(data_groups(nodes, way_nodes, by))
    good = cut(regions_from_bbox(regions).filter("error is null").drop("error"))
    seen, pairs = region_data(groups, good)
    seen, ways = cut(seen), (way_nodes.select(by, "way_id") if by else way_nodes.select("way_id")).distinct()
    on = lambda df, kind, key: df.select("region_key", F.lit(kind).alias("kind"), F.col(key).cast("string").alias("scope"))
    keys = regions.select("region_key").distinct()
    depends = on(pairs, "source", "source").unionByName(on(keys, "region", "region_key")).unionByName(on(keys.withColumn("source", F.lit("all")), "source", "source"))
    staged = [
        ("region", "region", region_issues(regions, "import.region.invalid")), ("counts", "source", parsed_counts_issues(nodes, ways, by)), ("coordinates", "source", coord_issues(nodes, by)),
        ("bounds", "region", _bounds_issues(groups, seen, good)), ("references", "source", dangling_issues(way_nodes, nodes, by)),
    ]
    if tiles is not None and pixels is not None:
        both = cross_file_issues(seen, good, tiles)
        staged += [("raster", "raster", dem_issues(pixels, tiles)), ("both", "raster", both.filter("code = 'cross.dem.bounds.invalid'")), ("both", "region", both.filter("code <> 'cross.dem.bounds.invalid'"))]
        depends = depends.unionByName(on(dem_coverage(tiles, good).filter("covered > 0"), "raster", "tile_id"))
    else:
        staged.append(("raster", "region", issues_of(regions, issue(F.lit(True), F.col("region_key"), "Warning", "import.dem.absent", "no elevation raster"))))
    counts = cut(features.groupBy("region_key", "feature_type").agg(F.count("*").alias("features")))  # all that is read of features
    empty = regions.join(counts.select("region_key").distinct(), "region_key", "left_anti")
    staged.append(("features", "region", issues_of(empty, issue(F.lit(True), F.col("region_key"), "Fatal", "import.features.none", "no features in the region"))))
    issues = cut(reduce(DataFrame.unionByName, [f.withColumns({"stage": F.lit(stage[name]), "kind": F.lit(kind)}) for name, kind, f in staged]))

    last, what = F.lit(len(STAGES)), ["kind", "scope"]
    stops = issues.filter("severity = 'Fatal'").groupBy(*what).agg(F.min("stage").alias("stop"))
    depends = cut(depends.distinct())
    until = cut(depends.join(stops, what, "left").groupBy("region_key").agg(F.min(F.coalesce("stop", last)).alias("until")))
    served = depends.join(until, "region_key").groupBy(*what).agg(F.max("until").alias("until"))  # of a region, this is its own
    ends = issues.join(served, what, "left").join(stops, what, "left").withColumn("end", F.least(F.coalesce("until", last), F.coalesce("stop", last)))
    kept = ends.filter("stage <= end").select(*[c for c in issues.columns if c != "kind"])
    return kept, counts


def osm_file_issues(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Structure of map files, one issue at most for each: missing, empty, truncated, UTF-16, no root. Of each file its first 4,096
    and last 512 bytes are read."""
    found = read_files(spark, paths, "ends")
    text = lambda c: F.decode(c, "ISO-8859-1")  # noqa: E731  what is looked for is ASCII
    first64 = F.hex(F.substring("head", 1, 64))
    bom = F.hex(F.substring("head", 1, 2)).isin("FFFE", "FEFF")
    zeros = F.size(F.filter(F.regexp_extract_all(first64, F.lit("(..)"), 1), lambda b: b == "00")) >= 16
    size = F.col("length")
    codes = [
        (size.isNull(), "osm.file.missing"), (size == 0, "osm.file.empty"), (size < 64, "osm.file.truncated"), (bom | zeros, "osm.encoding.utf16"),
        (F.instr(text("head"), "<osm") == 0, "osm.root.missing"), (F.instr(text("tail"), "</osm>") == 0, "osm.file.truncated"),
    ]
    code = F.coalesce(*[F.when(c, F.lit(k)) for c, k in codes])
    rows = found.select(F.col("path").alias("scope"), code.alias("code")).filter("code is not null")
    return rows.select("scope", F.lit("Fatal").alias("severity"), "code", F.lit("file cannot be read as a map").alias("message"), F.lit(None).cast("long").alias("element_id"))
