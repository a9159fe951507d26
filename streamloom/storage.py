"""Tables that an operator writes between its steps, and where they lie."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder of its own; on
    a cluster there is no safe default, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


class Workspace:
    """Parquet tables of one operator call, in a folder of its own.

    Writing a table cuts the lineage: a lost executor costs a reread, not the
    steps before it. Results that an operator returns read from its tables, so
    the folder stays until the driver ends; what no later step reads is dropped
    before.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._of = jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._of(self.path))
        self._fs.deleteOnExit(self._of(self.path))
        self._names: set[str] = set()

    def table(self, df: DataFrame, name: str) -> DataFrame:
        where = f"{self.path}/{name}"
        df.write.parquet(where)
        self._names.add(name)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        for name in names:
            self._fs.delete(self._of(f"{self.path}/{name}"), True)
            self._names.discard(name)

    def keep(self, *names: str) -> None:
        """Deletes all tables but these."""
        self.drop(*self._names.difference(names))


def spread(rows: DataFrame, n: int, keys: list[str], per_task: int) -> DataFrame:
    """rows, of which there are n, dealt out by keys to tasks of so many: for work that is long for the bytes it reads."""
    return rows.repartition(-(-n // per_task) or 1, *keys)
