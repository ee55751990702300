"""Files at the paths that rows name."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_files(rows: DataFrame, root: str, path: str = "path", content: str = "content") -> int:
    """Write each row's content, text or bytes, to ``root/path`` (an absolute path stays as it is),
    folders made as needed; returns how many.  ``root`` is a folder or address that all executors
    see.  A file is written beside its place and then moved, so a task that runs again leaves it
    whole; two rows with one path are an error."""
    named = rows.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))
    twice = named.groupBy("path").agg(F.count("*").alias("n")).where("n > 1 or path is null").limit(1).collect()
    if twice:
        raise ValueError(f"rows without a path or several with one: {twice[0]['path']}")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for where, data in zip(batch["path"], batch["content"], strict=True):
                name = where.as_py()
                to = name if name.startswith("/") else f"{base.rstrip('/')}/{name}"
                store.create_dir(to.rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{to}.part") as out:
                    out.write(data.as_py() or b"")
                store.move(f"{to}.part", to)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return named.mapInArrow(put, "n long").agg(F.sum("n")).first()[0] or 0
