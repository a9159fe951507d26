"""Running totals within groups of any size, without a task for a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes up to which a table of one row a source is broadcast.
BROADCAST_BYTES = 32 << 20
#: Rows that a bucket is meant to hold, and buckets whose sums are summed up together.
BUCKET_ROWS, RUN = 500, 1_000


def running(rows: DataFrame, group: list[str], bucket: str, order: list[str], value: Column, out: str) -> DataFrame:
    """rows with out: the sum of value over the rows of the group before each one.

    bucket must not fall along order. The sums of buckets combine before the
    shuffle and are summed up in runs of RUN buckets, then runs among
    themselves; rows are sorted within their bucket only.
    """
    # the names of buckets never clash with those of rows
    sums = rows.groupBy(*group, bucket).agg(F.sum(value).alias("_sum")).withColumn("_run", F.floor(F.col(bucket) / RUN))
    runs = sums.groupBy(*group, "_run").agg(F.sum("_sum").alias("_sum"))
    ahead = lambda parts, order: F.coalesce(F.sum("_sum").over(Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("_before_run", ahead(group, "_run")).drop("_sum")
    before = sums.join(runs, [*group, "_run"]).withColumn("_before", F.col("_before_run") + ahead([*group, "_run"], bucket)).select(*group, bucket, "_before")
    within = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(before, [*group, bucket])
    return joined.withColumn(out, (F.col("_before") + F.coalesce(F.sum(value).over(within), F.lit(0))).cast("long")).drop("_before")


def of_sources(table: DataFrame) -> DataFrame:
    """A table of one row a _source, broadcast if its measured size is small: rows of a hot source then stay where they are."""
    size = table.agg(F.coalesce(F.sum(F.octet_length("_source") + 64), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


def buckets(rows: Column) -> Column:
    """How many buckets hold so many rows."""
    return F.greatest(F.lit(1), F.ceil(rows / BUCKET_ROWS))


def unit(seed: str, *cols: str) -> Column:
    """A number in (0, 1) that the columns and the seed decide: 52 bits of an MD5 of the seed, the first column and the MD5 of each other one."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]
    text = F.concat_ws(":", F.lit(seed), *own[:1], *(F.md5(c) for c in own[1:]))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def group_key(column: str) -> Column:
    """A key that is never null and orders as the column by code point, nulls last."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("~"))
