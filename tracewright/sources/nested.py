"""Records of JSON files that are one long array, or an object around one, read by many tasks a file.

Whether a byte stands in a string, and how deep, depends on all before it. A block's effect on that is a function of four start
states (in a string or not, behind a backslash or not): each task finds its block's, they are composed file by file, and each block
then knows where it starts. A task gives the records that begin in its block, also where they end beyond.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as SqlWindow
from pyspark.sql import functions as F

from ..staging import staged
from .ranges import Window, files, opened, ranges

BLOCK_BYTES = 4 << 20
#: Bytes before a bracket in which its key is looked for.
KEY_BYTES = 1 << 10

EFFECTS = "path string, bytes long, start long, end long, head string, " + ", ".join(f"{c}{i} {t}" for i in range(4) for c, t in (("inside", "boolean"), ("escaped", "boolean"), ("rise", "long")))
STATES = "path string, bytes long, start long, end long, head string, inside boolean, escaped boolean, depth long"
RECORDS = "path string, at long, raw string"
_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def _outside(data: np.ndarray, inside: bool, escaped: bool) -> tuple[np.ndarray, bool, bool]:
    """Which bytes stand outside of strings, and the state behind the last."""
    n = len(data)
    place = np.arange(n)
    solid = np.maximum.accumulate(np.where(data == 0x5C, -1, place))  # the last byte up to here that is no backslash
    before = np.concatenate([[-1], solid])[: n + 1]
    run = np.arange(n + 1) - 1 - before + np.where(before < 0, int(escaped), 0)  # backslashes just before each place
    odd = run % 2 == 1
    quote = (data == 0x22) & ~odd[:n]
    many = np.cumsum(quote)
    within = ((many - quote) % 2 == 1) ^ inside
    return ~within & ~quote, bool(inside ^ (n and many[-1] % 2 == 1)), bool(odd[n])


def _steps(data: np.ndarray, outside: np.ndarray) -> np.ndarray:
    step = np.zeros(len(data), np.int64)
    step[outside & ((data == 0x5B) | (data == 0x7B))] = 1
    step[outside & ((data == 0x5D) | (data == 0x7D))] = -1
    return step


def _blocks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    """The columns of each row (path, bytes, start, end, ...), and its file as a window that holds a block and what may stand around it; blocks of one file that come together share it."""
    path, file = None, None
    try:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names)):
                if row[0] != path:
                    if file is not None:
                        file.close()
                    store, place = opened(row[0])
                    path, file = row[0], store.open_input_file(place)
                yield *row, Window(file, row[1], row[3] - row[2])
    finally:
        if file is not None:
            file.close()


def _gathered(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: Callable[[tuple], int] = lambda row: 64) -> Iterator[pa.RecordBatch]:
    """Batches of rows, of some 256 KB each."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += size(row)
        if n >= 1 << 18:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _bytes(window: Window, start: int, end: int) -> np.ndarray:
    return np.frombuffer(window.read(start, end - start), np.uint8)


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in EFFECTS.split(", ")]

    def rows() -> Iterator[tuple]:
        for path, size, start, end, window in _blocks(batches, ("path", "bytes", "start", "end")):
            head = window.read(0, KEY_BYTES).removeprefix(b"\xef\xbb\xbf").lstrip()[:1].decode("latin-1") if start == 0 else None
            data = _bytes(window, start, end)
            row = [path, size, start, end, head]
            for state in range(4):
                outside, inside, escaped = _outside(data, bool(state & 1), bool(state & 2))
                row += [inside, escaped, int(_steps(data, outside).sum())]
            yield tuple(row)

    yield from _gathered(rows(), names, [_TYPES[c.split()[1]] for c in EFFECTS.split(", ")])


def _composed(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of a file starts."""
    blocks = blocks.sort_values("start")
    state, depth, rows = 0, 0, []
    for row in blocks.itertuples(index=False):
        rows.append((row.path, row.bytes, row.start, row.end, blocks["head"].iloc[0], bool(state & 1), bool(state & 2), depth))
        depth += int(getattr(row, f"rise{state}"))
        state = int(getattr(row, f"inside{state}")) + 2 * int(getattr(row, f"escaped{state}"))
    return pd.DataFrame(rows, columns=["path", "bytes", "start", "end", "head", "inside", "escaped", "depth"])


def _arrays(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """path, start, wanted, of blocks in which arrays begin at depth one: whether the last is the value of one of the keys; and whether any is."""
    named = re.compile(rb'"(?:' + b"|".join(re.escape(k).encode() for k in keys) + rb')"\s*:\s*$')

    def rows() -> Iterator[tuple]:
        for path, size, start, end, inside, escaped, depth, window in _blocks(batches, ("path", "bytes", "start", "end", "inside", "escaped", "depth")):
            data = _bytes(window, start, end)
            outside, _, _ = _outside(data, inside, escaped)
            step = _steps(data, outside)
            at = np.flatnonzero((data == 0x5B) & (step == 1) & (depth + np.cumsum(step) - step == 1))
            wanted = [bool(named.search(window.read(max(0, start + k - KEY_BYTES), min(KEY_BYTES, start + k)))) for k in at.tolist()]
            if wanted:
                yield path, start, wanted[-1], any(wanted), (at[wanted] + start).tolist(), (at + start).tolist()

    longs = pa.list_(pa.int64())
    yield from _gathered(rows(), ["path", "start", "last", "some", "wanted", "arrays"], [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), longs, longs], lambda row: 64 + 16 * len(row[5]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _gathered(_records(batches), ["path", "at", "raw"], [pa.string(), pa.int64(), pa.string()], lambda row: 64 + len(row[2]))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    names = ("path", "bytes", "start", "end", "inside", "escaped", "depth", "level", "open", "wanted", "arrays")
    for path, size, start, end, inside, escaped, depth, level, open_, wanted, arrays, window in _blocks(batches, names):
        data = _bytes(window, start, end)
        outside, in_end, escaped_end = _outside(data, inside, escaped)
        step = _steps(data, outside)
        after = depth + np.cumsum(step)
        begins = np.flatnonzero((step == 1) & (after == level + 1))
        if level == 2:  # only in the array of a wanted key, which the last array that began before tells
            edges = np.array(arrays or [], np.int64)
            last = np.searchsorted(edges, begins + start, side="left") - 1
            good = np.isin(edges, wanted or [])
            begins = begins[np.where(last >= 0, good[last] if len(edges) else False, bool(open_))]
        ends = np.flatnonzero((step == -1) & (after == level))
        for b in begins.tolist():
            k = int(np.searchsorted(ends, b))
            if k < len(ends):
                yield path, start + b, data[b : ends[k] + 1].tobytes().decode("utf-8", "replace")
                continue
            parts, at, now, state, step_bytes = [data[b:].tobytes()], end, int(after[-1]), (in_end, escaped_end), end - start
            while at < size and now > level:  # a record that goes on beyond the block
                more = _bytes(window, at, min(size, at + step_bytes))
                out, *state = _outside(more, *state)
                deep = now + np.cumsum(_steps(more, out))
                stop = np.flatnonzero((deep == level) & (_steps(more, out) == -1))
                parts.append(more[: stop[0] + 1].tobytes() if len(stop) else more.tobytes())
                now, at, step_bytes = level if len(stop) else int(deep[-1]), at + len(more), max(step_bytes, min(2 * step_bytes, BLOCK_BYTES))
            yield path, start + b, b"".join(parts).decode("utf-8", "replace")


def read_records(spark: SparkSession, path: str, keys: tuple[str, ...], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, at, raw of the objects and lists in each file's array: the file itself, or the value of one of the keys of the object that it is; else its objects one after another.

    Plain values in the array are left out. What is cut off at the file's end is given as far as it goes.
    """
    blocks = ranges(files(spark, path).filter("bytes > 0"), block_bytes).sortWithinPartitions("path", "start")
    states = staged(blocks.mapInArrow(_effects, EFFECTS).groupBy("path").applyInPandas(_composed, STATES), "states")
    arrays = staged(states.mapInArrow(lambda b: _arrays(b, keys), "path string, start long, last boolean, some boolean, wanted array<long>, arrays array<long>"), "arrays")
    by_file = SqlWindow.partitionBy("path").orderBy("start").rowsBetween(SqlWindow.unboundedPreceding, -1)
    known = states.join(arrays, ["path", "start"], "left").withColumn("open", F.coalesce(F.last("last", ignorenulls=True).over(by_file), F.lit(False)))
    envelope = F.coalesce(F.bool_or("some").over(SqlWindow.partitionBy("path")), F.lit(False))
    level = F.when(F.col("head") == "[", 1).when(envelope, 2).otherwise(0)
    return known.withColumn("level", level).repartition(4 * spark.sparkContext.defaultParallelism, "path", "start").sortWithinPartitions("path", "start").mapInArrow(_cut, RECORDS)
