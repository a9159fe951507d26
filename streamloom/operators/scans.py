"""Running aggregates and selection over groups of any size, and covers of intervals: no task holds a group.

A group's rows fall into blocks that follow their order. Blocks are summed up,
their sums are scanned, one row a block, and what comes before a block is
joined back to its rows, which are scanned within the block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the cells that values are counted in before the middle one's cell is refined.
CELL = 1 / 64
#: Aggregates of a scan by what joins two of them.
_JOINED: dict[Callable, Callable[[Column, Column], Column]] = {
    F.sum: lambda a, b: F.coalesce(a + b, a, b),
    F.max: F.greatest,
    F.min: F.least,
}
Scan = dict[str, tuple[Callable, Column]]


def running(rows: DataFrame, group: list[str], block: str, order: list[str | Column], before: Scan, after: Scan | None = None) -> DataFrame:
    """rows with an aggregate, for each name, of the group's rows before each one, and of those after it.

    before and after give (F.sum, F.max or F.min, value) by name; without rows
    or values a result is null. block must not fall along order. rows are read
    twice.
    """
    scans = [(name, f, value, ahead) for part, ahead in ((before, True), (after or {}, False)) for name, (f, value) in part.items()]
    sums = rows.groupBy(*group, block).agg(*(f(value).alias(f"_{name}") for name, f, value, _ in scans))

    def scanned(f: Callable, value: Column, parts: list[str], by: list, ahead: bool) -> Column:
        # rows after one are those before it in the reverse order, which a window takes in one pass
        by = by if ahead else [c.desc() if isinstance(c, Column) else F.desc(c) for c in by]
        return f(value).over(Window.partitionBy(*parts).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))

    carried = sums.select(*group, block, *(scanned(f, F.col(f"_{name}"), group, [block], ahead).alias(f"_{name}") for name, f, _, ahead in scans))
    joined = rows.join(carried, [*group, block])
    own = [scanned(f, value, [*group, block], order, ahead) for _, f, value, ahead in scans]
    out = joined.withColumns({f"_own_{name}": c for (name, *_), c in zip(scans, own, strict=True)})
    out = out.withColumns({name: _JOINED[f](F.col(f"_{name}"), F.col(f"_own_{name}")) for name, f, _, _ in scans})
    return out.drop(*(f"{p}{name}" for name, *_ in scans for p in ("_", "_own_")))


def with_numbers(rows: DataFrame, group: list[str], block: Column, order: list[str | Column], out: str) -> DataFrame:
    """rows with their number in the group, from 1; block must not fall along order."""
    scanned = running(rows.withColumn("_block", block), group, "_block", order, {"_ahead": (F.sum, F.lit(1))})
    return scanned.withColumn(out, (F.coalesce("_ahead", F.lit(0)) + 1).cast("int")).drop("_block", "_ahead")


def medians(rows: DataFrame, group: list[str], value: str, out: str, cell: float = CELL) -> DataFrame:
    """(group, out): the exact median of each group, the mean of the two middle values where there are two.

    Equal values are counted together before the shuffle, counts of cells tell
    which cell each middle value is in, and only the values of that cell are
    ranked. Nulls are left out.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_cell", F.floor(F.col("_v") / cell))
    ahead = lambda parts, by: F.coalesce(F.sum("_n").over(Window.partitionBy(*parts).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = counts.groupBy(*group, "_cell").agg(F.sum("_n").alias("_n"))
    # one row a cell: as many as the range has cells
    cells = cells.withColumns({"_before": ahead(group, "_cell"), "_all": F.sum("_n").over(Window.partitionBy(*group))})
    middle = F.array(F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2))
    holding = F.filter(middle, lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_n")))
    cells = cells.withColumn("_k", F.explode(holding)).select(*group, "_cell", (F.col("_k") - F.col("_before")).alias("_k"))
    cells = cells.groupBy(*group, "_cell").agg(F.collect_list("_k").alias("_ks"))  # two at most
    found = counts.join(cells, [*group, "_cell"]).withColumn("_before", ahead([*group, "_cell"], "_v"))
    found = found.withColumn("_k", F.explode(F.filter("_ks", lambda k: (k >= F.col("_before")) & (k < F.col("_before") + F.col("_n")))))
    return found.groupBy(*group).agg((F.lit(0.5) * F.min("_v") + F.lit(0.5) * F.max("_v")).alias(out))


#: Numbers that a block of meeting holds, and parts up to which a range stays as it is in cover.
SPAN, SHORT = 4096, 8


def meeting(queries: DataFrame, ranges: DataFrame, group: list[str], ids: list[str]) -> DataFrame:
    """(group, ids) of the queries whose range meets any of ranges; both have first and last, whole numbers and inclusive.

    A range that begins by a query's last number meets it unless it ends before
    its first one, so two running counts decide; a range is two rows, however
    long it is. Empty ranges must be left out.
    """
    none = [F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in ids]
    point = lambda at, starts, ends, query, own: [*group, F.col(at).cast("bigint").alias("at") if isinstance(at, str) else at.cast("bigint").alias("at"), F.lit(starts).alias("starts"), F.lit(ends).alias("ends"), F.lit(query).alias("query"), *own]
    points = ranges.select(*point("first", 1, 0, 0, none)).unionByName(ranges.select(*point(F.col("last") + 1, 0, 1, 0, none)))
    points = points.unionByName(queries.select(*point("last", 0, 0, 1, ids))).unionByName(queries.select(*point("first", 0, 0, 2, ids)))
    points = points.withColumn("block", F.floor(F.col("at") / SPAN))
    known = running(points, group, "block", ["at", "query"], {"begun": (F.sum, F.col("starts")), "ended": (F.sum, F.col("ends"))})
    count = F.when(F.col("query") == 1, F.coalesce("begun", F.lit(0))).otherwise(-F.coalesce("ended", F.lit(0)))
    return known.where("query > 0").groupBy(*group, *ids).agg(F.sum(count).alias("open")).where("open > 0").drop("open")


def cover(first: Column, last: Column) -> Column:
    """The (level, node) whose runs of 2**level numbers, from node * 2**level on, make up a range of numbers.

    Short ranges are numbers of level 0; of longer ones each level has two nodes at most.
    """
    end, level = last + 1, lambda x, k: F.call_function("shiftright", x, k)
    node = lambda k, n: F.struct(k.cast("int").alias("level"), n.cast("bigint").alias("node"))

    def nodes(k: Column) -> Column:
        low, high = level(first + F.call_function("shiftleft", F.lit(1).cast("bigint"), k) - 1, k), level(end, k)
        return F.array(F.when((low < high) & (low % 2 != 0), node(k, low)), F.when((low < high) & (high % 2 != 0), node(k, high - 1)))

    levels = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(end - first, F.lit(1)).cast("double"))).cast("int"))
    long = F.filter(F.flatten(F.transform(levels, nodes)), lambda x: x.isNotNull())
    short = F.transform(F.sequence(first, F.greatest(first, last)), lambda n: node(F.lit(0), n))
    return F.when(last - first < SHORT, short).otherwise(long)
