"""Files of bytes, written by tasks piece by piece."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..sources.ranges import opened
from ..staging import staged


def write_files(pieces: DataFrame, folder: str) -> DataFrame:
    """A file in folder for each name of pieces (name, at, bytes), its pieces in the order of at, one in memory at a time; gives path and bytes of each.

    An attempt writes under a name of its own and renames what is whole, so attempts that fail or come second leave no half files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(folder)
        attempt = TaskContext.get().taskAttemptId()
        name, out, size, done = None, None, 0, []

        def close() -> None:
            if out is not None:
                out.close()
                store.move(f"{top}/.{name}-{attempt}", f"{top}/{name}")
                done.append((f"{folder}/{name}", size))

        for batch in batches:
            for own, part in zip(batch.column("name").to_pylist(), batch.column("bytes")):
                if own != name:
                    close()
                    store.create_dir(top, recursive=True)
                    name, size = own, 0
                    out = store.open_output_stream(f"{top}/.{name}-{attempt}", compression=None)
                out.write(part.as_buffer())
                size += len(part.as_buffer())
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "bytes"])

    return staged(pieces.repartition("name").sortWithinPartitions("name", "at").select("name", "bytes").mapInArrow(run, "path string, bytes long"), "files")
