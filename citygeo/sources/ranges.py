"""Files by byte range: listings, and reads that fetch what is asked for and no more."""

from __future__ import annotations

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession

BLOCK_BYTES = 1 << 16
SEEKABLE = {"file", "s3", "s3a", "s3n", "gs"}  # stores that pyarrow reads by range


def scheme(path: str) -> str:
    return path.split(":", 1)[0] if ":" in path.split("/", 1)[0] else ""


def listing(spark: SparkSession, paths: str | list[str]) -> list[tuple[str, int | None]]:
    """(path, bytes) of the files that paths, folders and patterns name, with their scheme; None for what is not there."""
    hadoop, conf, out = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), []
    for p in [paths] if isinstance(paths, str) else paths:
        path = hadoop.Path(p)
        fs = path.getFileSystem(conf)
        found = fs.globStatus(path)
        if not found:
            out.append((p, None))
        for status in found or []:
            files = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
            named = [(f.getPath().toString(), f.getLen()) for f in files if f.isFile()]
            out += [(name, size) for name, size in named if not name.rsplit("/", 1)[-1].startswith(("_", "."))]
    return sorted(out, key=lambda f: f[0])


class Ranges:
    """Bytes of one file: r(at, n) gives n bytes from at on, fewer at the end of the file. data: the whole file, where it is at hand."""

    def __init__(self, path: str, size: int, data: bytes | None = None):
        self.size, self.data, self.at, self.block, self.file = size, data, 0, b"", None
        if data is None:
            kind = scheme(path)
            plain = f"s3://{path.split('://', 1)[1]}" if kind in ("s3a", "s3n") else path
            store, inner = (arrow_fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if kind == "file" else arrow_fs.FileSystem.from_uri(plain)
            self.file = store.open_input_file(inner)

    def __call__(self, at: int, n: int) -> bytes:
        if self.data is not None:
            return self.data[at : at + n]
        if not (self.at <= at and at + n <= self.at + len(self.block)):
            self.at, self.block = at, bytes(self.file.read_at(max(0, min(max(n, BLOCK_BYTES), self.size - at)), at))
        return self.block[at - self.at : at - self.at + n]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
