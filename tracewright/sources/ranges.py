"""Files read by ranges of bytes, many tasks a file, through pyarrow's file systems by URI."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT_BYTES = 64 << 20
CHUNK_BYTES = 1 << 20

# Names that Spark's file systems have and pyarrow's have not, and which of pyarrow's reads the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def opened(uri: str):
    """The file system of a URI and the path in it; stores that pyarrow doesn't know are opened by fsspec, where that is installed."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    uri = re.sub(r"^file:/+", "file:///", uri)
    try:
        return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + ":" + rest if re.match(r"[a-z0-9]+:/", uri) and scheme != "file" else uri)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        import fsspec

        store, path = fsspec.core.url_to_fs(uri)
        return fs.PyFileSystem(fs.FSSpecHandler(store)), path


class Window:
    """A file, or bytes, read in chunks: at most a chunk, or what is asked for, is held."""

    def __init__(self, file, size: int, chunk: int = CHUNK_BYTES):
        self.file, self.size, self.chunk = file, size, chunk
        self.begin, self.held = 0, b""

    def read(self, at: int, n: int) -> bytes:
        """n bytes from a place on, fewer at the end."""
        n = max(0, min(n, self.size - at))
        if not self.begin <= at <= at + n <= self.begin + len(self.held):
            self.file.seek(at)
            self.begin, self.held = at, self.file.read(min(max(n, self.chunk), self.size - at))
        return self.held[at - self.begin : at - self.begin + n]


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes of files; their content is not read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))


def ranges(found: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, bytes, start, end of ranges of files (path, bytes), dealt over tasks."""
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long")))
    split = found.withColumn("start", at).withColumn("end", F.least(F.col("start") + split_bytes, F.col("bytes")))
    return split.repartition(4 * found.sparkSession.sparkContext.defaultParallelism, "path", "start")


def read_pieces(spark: SparkSession, path: str, piece_bytes: int = CHUNK_BYTES, overlap: int = 64, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """image_id (the file), chunk_off, bytes: pieces of files of any size that share `overlap` bytes with the next, a piece in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start", "end"))):
                store, place = opened(name)
                with store.open_input_file(place) as file:
                    for at in range(start, end, piece_bytes):
                        file.seek(at)
                        part = file.read(min(min(piece_bytes, end - at) + overlap, size - at))
                        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at]), pa.array([part], pa.binary())], names=["image_id", "chunk_off", "bytes"])

    return ranges(files(spark, path).filter("bytes > 0"), split_bytes).mapInArrow(run, "image_id string, chunk_off long, bytes binary")
