"""Many small files, such as one a video: tasks write and read them, and a table names them.

Neither a commit nor a listing in the driver grows with their number.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.storage import Workspace

#: Files that a task reads, and characters of a batch of their contents.
TASK_FILES, BATCH_CHARS = 1_000, 1 << 20


def _uri(path: str) -> str:
    return path if re.match(r"\w+:", path) else f"file://{path}"


def folder(*keys: str) -> Column:
    """The key=value/... folder of a row, as Spark's own writers name it."""
    own = lambda c: F.replace(F.url_encode(F.nullif(F.col(c).cast("string"), F.lit(""))), F.lit("+"), F.lit("%20"))
    return F.concat_ws("/", *(F.concat(F.lit(f"{c}="), F.coalesce(own(c), F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in keys))


def _write_batches(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        name, own, out, made = None, None, None, []

        def close() -> None:
            if out is not None:
                out.close()
                # a task that runs again writes the same bytes under the same name
                fs.move(own, f"{root}/{name}")
                made.append(name)

        for batch in batches:
            for file, line in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
                if file != name:
                    close()
                    name, (parent, stem) = file, file.rsplit("/", 1)
                    fs.create_dir(f"{root}/{parent}")
                    own = f"{root}/{parent}/.{stem}.{TaskContext.get().taskAttemptId()}"
                    out = fs.open_output_stream(own, compression=None)
                out.write(line.encode() + b"\n")
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["file"])
            made = []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["file"])

    return run


def write_files(rows: DataFrame, path: str, file: Column, order: list[str], value: Column) -> DataFrame:
    """Writes value, a line a row, to each row's file under a new folder, by order; (file), a row for each of them.

    Lines are written as they come: no file is gathered, but one task writes
    it. path is one that all executors reach, on a file system that pyarrow opens.
    """
    fs, root = pyarrow.fs.FileSystem.from_uri(_uri(path))
    if fs.get_file_info(root).type != pyarrow.fs.FileType.NotFound:
        raise FileExistsError(path)
    fs.create_dir(root)
    lines = rows.select(file.alias("_file"), F.coalesce(value, F.lit("")).alias("_value"), *order).repartition("_file").sortWithinPartitions("_file", *order)
    made = lines.select("_file", "_value").mapInArrow(_write_batches(_uri(path)), "file string")
    return Workspace(rows.sparkSession, "files").table(made, "names")


def _read_batches(path: str, by_line: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(path)
        names, values, size = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], ["file", "value"])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with io.BufferedReader(fs.open_input_stream(f"{root}/{name}", compression=None)) as stream:
                    parts = (line.removesuffix(b"\n") for line in stream) if by_line else [stream.read()]
                    for part in parts:
                        names.append(name)
                        values.append(part.decode())
                        size += len(part)
                        if size > BATCH_CHARS:
                            yield out()
                            names, values, size = [], [], 0
        yield out()

    return run


def read_files(files: DataFrame, path: str, by_line: bool = False) -> DataFrame:
    """(file, value): what the named files under a folder hold, each as one value or line by line."""
    spread = files.select("file").repartition(-(-files.count() // TASK_FILES) or 1)
    return spread.mapInArrow(_read_batches(_uri(path), by_line), "file string, value string")
