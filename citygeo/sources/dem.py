"""Elevation rasters: HGT and TIFF files to tables of headers and pixels.

Files are read by byte range: a header takes the bytes of its directory, and a large raster is many partitions, each of which seeks the
strips or rows of its share. Conditions on tile_id and row reach the reader, so other files and rows are not read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from citygeo.sources.ranges import SEEKABLE, Ranges, listing, scheme

HEADER = "tile_id string, width int, height int, gt array<double>, nodata double, has_nodata boolean, bits int, sample_format int, bands int, compression int, tiles int, strips int, has_geotags boolean, pixel_scale double, pixel_scale_y double, origin_lat double, origin_lon double, error string"
PIXELS = "tile_id string, row int, col int, elev float"
ENDS = "path string, length long, head binary, tail binary"
FORMAT = "citygeo_files"
PART_BYTES, CHUNK_BYTES, PACKED_BYTES, FILES = 8 << 20, 1 << 20, 1 << 18, 16  # of a file for each partition; of pixels and of packed bytes at a time; headers for each partition
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 12: ("d", 8), 16: ("Q", 8)}
_KINDS = {(16, 1): "u2", (16, 2): "i2", (32, 1): "u4", (32, 2): "i4", (32, 3): "f4"}
_DEFLATED = (8, 32946)
_HGT = re.compile(r"([NS])(\d{2})([EW])(\d{3})\.hgt$", re.I)


def _tags(read: Ranges) -> tuple[str, dict]:
    """Byte order and the tags of the first directory; an error raises ValueError or struct.error."""
    order = {b"II": "<", b"MM": ">"}.get(read(0, 2))
    if order is None or struct.unpack(order + "H", read(2, 2))[0] != 42:
        raise ValueError("tif.header.invalid")
    at = struct.unpack(order + "I", read(4, 4))[0]
    out = {}
    for i in range(struct.unpack(order + "H", read(at, 2))[0]):
        entry = read(at + 2 + 12 * i, 12)
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if kind not in _TYPES:
            continue
        code, size = _TYPES[kind]
        start = struct.unpack(order + "I", entry[8:12])[0] if n * size > 4 else None
        raw = entry[8 : 8 + n * size] if start is None else read(start, n * size)
        out[tag] = raw if code == "s" else struct.unpack(f"{order}{n}{code}", raw)
    return order, out


@dataclass
class Layout:
    """Where the rows of a raster's first band stand: strips of so many rows, each row of so many samples and bands."""

    order: str
    kind: str
    offsets: tuple
    counts: tuple
    rows: int
    width: int
    bands: int
    deflated: bool


def _tiff_header(name: str, read: Ranges) -> tuple[dict, Layout | None]:
    order, t = _tags(read)
    one = lambda tag, default: t.get(tag, (default,))[0]
    scale, tie = t.get(33550), t.get(33922)
    geo = scale is not None and tie is not None
    nodata = t.get(42113, b"").split(b"\0")[0].strip()
    try:
        void = float(nodata) if nodata else None
    except ValueError:
        void = None
    lon0, lat0 = (tie[3] - tie[0] * scale[0], tie[4] + tie[1] * scale[1]) if geo else (0.0, 0.0)
    h = {
        "tile_id": name, "width": one(256, 0), "height": one(257, 0), "gt": [lon0, scale[0] if geo else 0.0, 0.0, lat0, 0.0, -scale[1] if geo else 0.0],
        "nodata": -9999.0 if void is None else void, "has_nodata": void is not None, "bits": one(258, 1), "sample_format": one(339, 1), "bands": one(277, 1),
        "compression": one(259, 1), "tiles": len(t.get(324, ())), "strips": len(t.get(273, ())), "has_geotags": geo,
        "pixel_scale": scale[0] if geo else 0.0, "pixel_scale_y": scale[1] if geo else 0.0, "origin_lat": lat0, "origin_lon": lon0, "error": None,
    }
    kind = _KINDS.get((h["bits"], h["sample_format"]))
    if kind is None or h["tiles"] > 1 or h["compression"] not in (1, *_DEFLATED) or h["width"] <= 0 or h["height"] <= 0:
        return h, None
    bands = h["bands"] if one(284, 1) == 1 else 1  # bands of their own come one after the other
    if h["tiles"]:
        return h, Layout(order, kind, t[324], t.get(325, (0,)), one(323, h["height"]), one(322, h["width"]), bands, h["compression"] != 1)
    rows = min(one(278, h["height"]), h["height"])
    return h, Layout(order, kind, t.get(273, ()), t.get(279, ()), rows, h["width"], bands, h["compression"] != 1)


def _hgt_header(name: str, size: int, match: re.Match) -> tuple[dict, Layout]:
    side = {1201 * 1201 * 2: 1201, 3601 * 3601 * 2: 3601}.get(size)
    if side is None:
        raise ValueError("hgt.size.unsupported")
    lat = int(match[2]) * (1 if match[1].upper() == "N" else -1)
    lon = int(match[4]) * (1 if match[3].upper() == "E" else -1)
    step = 1 / (side - 1)
    gt = [lon - step / 2, step, 0.0, lat + 1 + step / 2, 0.0, -step]  # pixels stand on the whole degrees
    h = {"tile_id": name, "width": side, "height": side, "gt": gt, "nodata": -32768.0, "has_nodata": True, "bits": 16, "sample_format": 2, "bands": 1, "compression": 1, "tiles": 0, "strips": 1, "has_geotags": True, "pixel_scale": step, "pixel_scale_y": step, "origin_lat": gt[3], "origin_lon": gt[0], "error": None}
    return h, Layout(">", "i2", (0,), (size,), side, side, 1, False)


def header(path: str, read: Ranges) -> tuple[dict, Layout | None]:
    """Header of a raster, with an error if it has none, and its layout if its pixels can be read."""
    name = path.rsplit("/", 1)[-1]
    try:
        match = _HGT.search(name)
        return _hgt_header(name, read.size, match) if match else _tiff_header(name, read)
    except (ValueError, KeyError, struct.error, IndexError, OSError) as e:
        code = "tif.file.empty" if read.size <= 8 else str(e) if str(e).startswith(("tif.", "hgt.")) else "tif.header.invalid"
        empty = {"width": 0, "height": 0, "gt": [0.0] * 6, "nodata": 0.0, "has_nodata": False, "bits": 0, "sample_format": 0, "bands": 0, "compression": 0, "tiles": 0, "strips": 0, "has_geotags": False, "pixel_scale": 0.0, "pixel_scale_y": 0.0, "origin_lat": 0.0, "origin_lon": 0.0}
        return {"tile_id": name, "error": code} | empty, None


def _strip_rows(read: Ranges, at: Layout, k: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, samples of some rows) of rows first to last - 1 of strip k; what the file lacks is left out."""
    kind = np.dtype(at.order + at.kind)
    line = at.width * at.bands * kind.itemsize
    many = max(1, CHUNK_BYTES // line)
    grid = lambda raw, n: np.frombuffer(raw, kind, n * at.width * at.bands).reshape(n, at.width, at.bands)[:, :, 0].astype(np.float32)
    base = k * at.rows
    if not at.deflated:
        for row in range(first, last, many):
            n = min(many, last - row)
            raw = read(at.offsets[k] + (row - base) * line, n * line)
            if n := len(raw) // line:
                yield row, grid(raw, n)
        return
    packed, held, row, pos = zlib.decompressobj(), b"", base, 0
    while pos < at.counts[k] and row < last:
        held += packed.decompress(read(at.offsets[k] + pos, min(PACKED_BYTES, at.counts[k] - pos)))
        pos += PACKED_BYTES
        if n := min(len(held) // line, last - row):
            skip = max(0, min(n, first - row))
            if n > skip:
                yield row + skip, grid(held[skip * line :], n - skip)
            held, row = held[n * line :], row + n


def pixel_batches(path: str, read: Ranges, part: int = 0, parts: int = 1, first: int = 0, last: int | None = None) -> Iterator[pa.RecordBatch]:
    """Pixels of a share of a raster, rows first to last - 1 only. Shares are rows, or whole strips where they are packed."""
    h, at = header(path, read)
    if h["error"] or at is None:
        return
    height, strips = h["height"], min(len(at.offsets), -(-h["height"] // at.rows))
    for k in range(strips):
        low, high = k * at.rows, min((k + 1) * at.rows, height)
        if at.deflated:
            if k * parts // strips != part:
                continue
        else:
            low, high = max(low, height * part // parts), min(high, height * (part + 1) // parts)
        low, high = max(low, first), high if last is None else min(high, last)
        if low >= high:
            continue
        try:
            for row, samples in _strip_rows(read, at, k, low, high):
                samples = samples[:, : h["width"]]
                r, c = np.indices(samples.shape, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([h["tile_id"]] * samples.size), pa.array(r.ravel() + np.int32(row), pa.int32()), pa.array(c.ravel()), pa.array(samples.ravel())], ["tile_id", "row", "col", "elev"])
        except (ValueError, IndexError, zlib.error):
            continue  # dem_issues tells that pixels are missing


def _header_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split(" ") for f in HEADER.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[name] for r in rows], kinds[kind]) for name, kind in fields], [name for name, _ in fields])


def _end_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "length", "head", "tail"])


def _ends(path: str, size: int | None, read: Ranges | None) -> tuple:
    return (path, size, read(0, 4096), read(max(0, size - 512), 512)) if size else (path, size, None, None)


class _Part(InputPartition):
    def __init__(self, files: list, part: int = 0, parts: int = 1):
        self.files, self.part, self.parts = files, part, parts


class _Reader(DataSourceReader):
    def __init__(self, view: str, files: list):
        self.view, self.files = view, files
        self.names, self.first, self.last = None, 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if self.view == "pixels" and f.attribute == ("tile_id",) and isinstance(f, (EqualTo, In)):
                names = set(f.value if isinstance(f, In) else [f.value])
                self.names = names if self.names is None else self.names & names
            if self.view == "pixels" and f.attribute == ("row",):
                low = {EqualTo: 0, GreaterThanOrEqual: 0, GreaterThan: 1}.get(type(f))
                high = {EqualTo: 1, LessThanOrEqual: 1, LessThan: 0}.get(type(f))
                self.first = self.first if low is None else max(self.first, f.value + low)
                self.last = self.last if high is None else min(f.value + high, f.value + high if self.last is None else self.last)
            yield f  # and they are applied again

    def partitions(self) -> list[_Part]:
        if self.view != "pixels":
            return [_Part(self.files[k : k + FILES]) for k in range(0, len(self.files), FILES)] or [_Part([])]
        own = [(p, n) for p, n in self.files if n and (self.names is None or p.rsplit("/", 1)[-1] in self.names)]
        return [_Part([(p, n)], k, parts) for p, n in own for parts in [-(-n // PART_BYTES)] for k in range(parts)] or [_Part([])]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        rows = []
        for path, size in part.files:
            read = Ranges(path, size) if size else None
            if self.view == "pixels":
                yield from pixel_batches(path, read, part.part, part.parts, self.first, self.last)
            elif self.view == "headers":
                rows.append(header(path, read or Ranges(path, 0, b""))[0])
            else:
                rows.append(_ends(path, size, read))
            if read:
                read.close()
        if rows:
            yield (_header_batch if self.view == "headers" else _end_batch)(rows)


class FileSource(DataSource):
    """Rasters and map files by byte range. Options: view (pixels, headers or ends) and files (a listing as JSON)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return {"pixels": PIXELS, "headers": HEADER, "ends": ENDS}[self.options["view"]]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["view"], [tuple(f) for f in json.loads(self.options["files"])])


def _whole(view: str):
    """The same rows of files that only Spark can open, from their whole content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                read = Ranges(path, len(data), data)
                if view == "pixels":
                    yield from pixel_batches(path, read)
                else:
                    yield _header_batch([header(path, read)[0]]) if view == "headers" else _end_batch([_ends(path, len(data), read)])

    return run


def read_files(spark: SparkSession, paths: str | list[str], view: str) -> DataFrame:
    """One view of the files: by byte range where pyarrow can seek in their store, else whole, as Spark's binary source gives them."""
    files = listing(spark, paths)
    there = [f for f in files if f[1]]
    schema = {"pixels": PIXELS, "headers": HEADER, "ends": ENDS}[view]
    if all(scheme(p) in SEEKABLE for p, _ in there):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(FileSource)
        return spark.read.format(FORMAT).options(view=view, files=json.dumps(files)).load()
    found = spark.read.format("binaryFile").load([p for p, _ in there]).select("path", "content").mapInArrow(_whole(view), schema)
    gone = [(p, n, None, None) for p, n in files if not n] if view == "ends" else []
    return found.unionByName(spark.createDataFrame(gone, ENDS)) if gone else found


def read_dem(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """dem_tiles (header of each file, with error) and dem_pixels(tile_id, row, col, elev). HGT of 1201 or 3601 a side; TIFF of 16 or 32
    bits, plain or deflated, in strips or one tile; of several bands the first. A file that cannot be read has a header with an error."""
    return read_files(spark, paths, "headers"), read_files(spark, paths, "pixels")


def header_errors(headers: DataFrame) -> DataFrame:
    return headers.filter("error is not null").select(F.col("tile_id").alias("scope"), F.lit("Fatal").alias("severity"), F.col("error").alias("code"), F.lit("file cannot be read as a raster").alias("message"), F.lit(None).cast("long").alias("element_id"))


def tiff_bytes(grid: np.ndarray, gt: list[float], nodata: float | None = None, deflate: bool = False, strip_rows: int = 16) -> bytes:
    """A raster of floats as a TIFF file, in strips."""
    strips = [grid[k : k + strip_rows].astype("<f4").tobytes() for k in range(0, len(grid), strip_rows)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    tags = [(256, 4, [grid.shape[1]]), (257, 4, [grid.shape[0]]), (258, 3, [32]), (259, 3, [8 if deflate else 1]), (273, 4, [0] * len(strips)), (277, 3, [1]), (278, 4, [strip_rows]), (279, 4, [len(s) for s in strips]), (339, 3, [3]), (33550, 12, [gt[1], -gt[5], 0.0]), (33922, 12, [0.0, 0.0, 0.0, gt[0], gt[3], 0.0])]
    body = {tag: struct.pack(f"<{len(v)}{_TYPES[kind][0]}", *v) for tag, kind, v in tags}
    if nodata is not None:
        body[42113] = f"{nodata:g}\0".encode()
        tags.append((42113, 2, list(body[42113])))
    start = 8 + 2 + 12 * len(tags) + 4
    first = start + sum(len(b) for b in body.values() if len(b) > 4)
    body[273] = struct.pack(f"<{len(strips)}I", *(first + sum(map(len, strips[:k])) for k in range(len(strips))))
    entries, extra = b"", b""
    for tag, kind, v in tags:
        own = body[tag]
        entries += struct.pack("<HHI", tag, kind, len(v)) + (own.ljust(4, b"\0") if len(own) <= 4 else struct.pack("<I", start + len(extra)))
        extra += own if len(own) > 4 else b""
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + entries + struct.pack("<I", 0) + extra + b"".join(strips)
