"""Native expressions over the words of a text: runs of characters other than space and 0x09-0x0D."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is evaluated once, however often body or its lambdas name it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none if it is null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def char_count(own: Column) -> Column:
    """Code points in an array of words."""
    return F.length(F.array_join(own, "")).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines that have a word and equal an earlier line of the text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    return let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(own: Column) -> Column:
    """Words of an array that lie in a run of three words found twice or more in it.

    Where all hashes of runs are distinct there are none. Else each run's hash
    and place share one long, hash first, so that one sort of longs brings equal
    runs together; neighbours of one hash count as equal if their words are. The
    places of repeated runs, in order, each add the words up to the next one,
    three at most.
    """
    zero = F.lit(0).cast("long")

    def by_bits(w: Column, bits: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        runs = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(mask)))

        def repeats(s: Column) -> Column:
            def alike(g: Column) -> Column:
                return F.filter(s, lambda _, i: (F.get(g, i) == F.get(g, i + 1)) | (F.get(g, i) == F.get(g, i - 1)))

            def same(x: Column, y: Column) -> Column:
                p, q = x.bitwiseAND(mask).cast("int"), y.bitwiseAND(mask).cast("int")
                return y.isNotNull() & (F.get(w, p) == F.get(w, q)) & (F.get(w, p + 1) == F.get(w, q + 1)) & (F.get(w, p + 2) == F.get(w, q + 2))

            near = let(F.transform(s, lambda x: x.bitwiseAND(F.bitwise_not(mask))), alike)
            found = let(near, lambda c: F.filter(c, lambda x, i: same(x, F.get(c, i + 1)) | same(x, F.get(c, i - 1))))
            return F.array_sort(F.transform(found, lambda x: x.bitwiseAND(mask)))

        def covered(p: Column) -> Column:
            # the state is the last place and the words so far
            step = lambda acc, x: F.struct(x.alias("last"), (acc["sum"] + F.least(F.lit(3).cast("long"), x - acc["last"])).alias("sum"))
            start = F.struct(F.lit(-3).cast("long").alias("last"), zero.alias("sum"))
            return F.aggregate(p, start, step, lambda acc: acc["sum"])

        def counted(h: Column) -> Column:
            placed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseOR(i.cast("long"))))
            return F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(let(placed, lambda s: let(repeats(s), covered)))

        return let(runs, counted)

    return let(own, lambda w: F.when(F.size(w) < 3, zero).otherwise(let(F.length(F.bin(F.size(w).cast("long"))), lambda bits: by_bits(w, bits))))
