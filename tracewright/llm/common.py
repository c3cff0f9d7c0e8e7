"""Helpers that the operators share: staged tables, whole texts as bytes in numpy, word hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import small_batches

#: Bytes of text that one numpy step holds at once; a longer text is cut into such steps at its words' limits.
STEP_BYTES = 1 << 18

_own_folder: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_folder[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def staged(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write df into the shared folder and read it back, which cuts its lineage. small: keys and counts only, so four files a core are enough."""
    small_batches(df.sparkSession)
    path = new_folder(df.sparkSession, name)
    if small:
        df = df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, mod 4; 2 means held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(col.cast("string").cast("binary")) % 4


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    all_bytes = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return all_bytes[at[0] : at[-1]], at - at[0]


def steps(batches: Iterable[pa.RecordBatch], text: str, words: bool = True) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, bool]]:
    """Slices of the batches of about STEP_BYTES of text each, with the text's bytes and row offsets, and whether the row goes on.

    A row with a longer text comes alone, in several steps; a step ends behind a blank (words) or between code points.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = as_bytes(batch.column(text))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(at, at[row] + STEP_BYTES, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            own, begin = data[at[row] : at[end]], 0
            while end == row + 1 and len(own) - begin > STEP_BYTES:
                cut = _limit(own, begin + STEP_BYTES, words)
                if cut < len(own):
                    yield batch.slice(row, 1), own[begin:cut], np.array([0, cut - begin]), True
                    begin = cut
                else:
                    break
            yield batch.slice(row, end - row), own[begin:], np.maximum(at[row : end + 1] - at[row] - begin, 0), False
            row = end
        released()


def _limit(data: np.ndarray, at: int, words: bool) -> int:
    """The first place from `at` on that stands behind a blank, or between code points."""
    while at < len(data):
        window = data[at - 1 : at - 1 + STEP_BYTES]
        found = np.flatnonzero(_SPACE[window[:-1]] if words else (window[1:] & 0xC0) != 0x80)
        if len(found):
            return at + int(found[0])
        at += max(1, len(window) - 1)
    return len(data)


def released() -> None:
    """Gives memory that a task has freed back to the machine, as Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KEY = np.uint64(0x9E3779B97F4A7C15)
#: Words up to this many bytes are hashed by numpy, longer ones one by one.
_SHORT = 64


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same in every run, for features of models; where equal hashes must mean equal spans, take keyed_hashes."""
    n = (end - start).astype(np.int64)
    out = np.zeros(len(n), np.uint64)
    if not len(n):
        return out
    eights = _eights(data)
    short = n < 8
    k = np.flatnonzero(short)
    size = n[k].astype(np.uint64)
    out[k] = mix((eights[start[k]] & ((np.uint64(1) << (np.uint64(8) * size)) - np.uint64(1))) | (size << np.uint64(56)))
    k = np.flatnonzero(~short & (n <= _SHORT))
    h, at, left = mix(n[k].astype(np.uint64) + _KEY), start[k], n[k]
    live = np.arange(len(k))
    while len(live):
        size = np.minimum(left[live], 8).astype(np.uint64)
        part = eights[at[live]] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * size))
        h[live] = mix(h[live] ^ part) * (_KEY | np.uint64(1)) + _KEY
        at[live] += 8
        left[live] -= 8
        live = live[left[live] > 0]
    out[k] = mix(h)
    for k in np.flatnonzero(n > _SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes(), seed=int(n[k]))
    return out


def hash_keys(seed: int) -> np.ndarray:
    """Keys of keyed_hashes. Draw the seed anew (secrets.randbits) where texts may be made to collide, and give all tasks the same."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, 4 * (_SHORT // 8 + 1) + 2, np.uint64)


def keyed_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, in which nobody who doesn't know the keys can make spans meet.

    Spans of up to seven bytes have different hashes. Longer ones are two sums of products of keyed halves of their
    eights (a universal family: two spans meet in both for one in 2 ** 64 keys), those beyond 64 bytes are left to xxh3 with the key.
    """
    n = (end - start).astype(np.int64)
    out = np.zeros(len(n), np.uint64)
    if not len(n):
        return out
    eights, low = _eights(data), np.uint64(0xFFFFFFFF)
    short = n < 8
    k = np.flatnonzero(short)
    size = n[k].astype(np.uint64)
    out[k] = mix(((eights[start[k]] & ((np.uint64(1) << (np.uint64(8) * size)) - np.uint64(1))) | (size << np.uint64(56))) ^ keys[-1]) * (keys[-2] | np.uint64(1))
    k = np.flatnonzero(~short & (n <= _SHORT))
    at, left, live, i = start[k], n[k].copy(), np.arange(len(k)), 4
    sums = [(n[k].astype(np.uint64) + keys[j] & low) * (keys[j + 1] & low) for j in (0, 2)]
    while len(live):
        size = np.minimum(left[live], 8).astype(np.uint64)
        part = eights[at[live]] & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * size))
        for total, j in zip(sums, (i, i + 2)):
            total[live] += ((part & low) + keys[j] & low) * ((part >> np.uint64(32)) + keys[j + 1] & low)
        at[live] += 8
        left[live] -= 8
        live = live[left[live] > 0]
        i += 4
    out[k] = mix(sums[0] ^ mix(sums[1] ^ keys[-1]))
    for k in np.flatnonzero(n > _SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes(), seed=int(keys[-1]))
    return out


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, zeros behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def same_bytes(x: np.ndarray, x_start: np.ndarray, y: np.ndarray, y_start: np.ndarray, x_size: np.ndarray, y_size: np.ndarray) -> np.ndarray:
    """Whether each span of x holds the bytes of that of y."""
    same = x_size == y_size
    live = np.flatnonzero(same & (x_size > 0))
    if not len(live):
        return same
    xs, ys, done = _eights(x), _eights(y), 0
    while len(live):
        size = np.minimum(x_size[live] - done, 8).astype(np.uint64)
        differ = ((xs[x_start[live] + done] ^ ys[y_start[live] + done]) & (~np.uint64(0) >> (np.uint64(64) - np.uint64(8) * size))) != 0
        same[live[differ]] = False
        done += 8
        live = live[~differ & (x_size[live] > done)]
    return same


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word [^\\x20\\x09-\\x0D]+, and at[row] <= word < at[row + 1] as first word of each row."""
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    before = np.empty(len(data) + 1, bool)  # the byte before is no part of a word of this row
    before[0] = True
    before[1:] = ~inside
    before |= cut
    start = np.flatnonzero(inside & before[:-1])
    after = np.empty(len(data), bool)
    after[:-1] = ~inside[1:]
    if len(data):
        after[-1] = True
    after |= cut[1:]
    end = np.flatnonzero(inside & after) + 1
    return start, end, np.searchsorted(start, at)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def within(keys: DataFrame, df: DataFrame, on: str | list[str], how: str = "left_semi", most: int = 1 << 20) -> DataFrame:
    """df joined with keys, which are staged rows of a few longs: broadcast when a count shows that they are at most `most`, so a key that many rows of df have does not gather them; else both sides are shuffled."""
    few = keys.limit(most + 1).count() <= most
    return df.join(F.broadcast(keys) if few else keys.hint("shuffle_merge"), on, how)
