"""A Merkle manifest of a dataset, its leaves placed by bitmap ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.llm.ranked import buckets, running
from streamloom.storage import Workspace

#: Nodes that one digest covers, and children of a node of the popcount directory as a power of two.
FAN, DIRECTORY_BITS = 16, 10
#: Sources up to which their table (a subroot and a path of a few KB each) is broadcast.
BROADCAST_SOURCES = 4096
#: The word that rows without an id share: below those of all 64-bit ids.
NO_WORD = -(1 << 57) - 1
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(*fields: Column) -> Column:
    """SHA-256 of a record: each field as its UTF-8 byte count, a colon and its value, `-` if null."""
    sized = lambda f: F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-"))
    return F.sha2(F.concat(*(sized(f.cast("string")) for f in fields)), 256)


def _leaves(documents: DataFrame, every: int) -> DataFrame:
    """(doc_id, _source, leaf, tampered, _n): records with their digests, equal ones counted."""
    rows = documents.select(*FIELDS)
    own = [F.col(c) for c in FIELDS]
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0
    changed = F.when(picked, digest_of(*own[:-1], F.translate("text", _UPPER, _LOWER)))
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # never null, and null sources come first
    keyed = rows.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("_source"), digest_of(*own).alias("leaf"), changed.alias("tampered"))
    return keyed.groupBy(*keyed.columns).agg(F.count("*").alias("_n"))


def id_bitmaps(rows: DataFrame) -> DataFrame:
    """(_source, _word, _bits, _rows, _more): the compressed bitmap of each source's ids.

    A word holds 64 neighbouring ids; words without any are left out. The words
    of all tasks merge by bitwise or. _rows counts rows, and _more has the ids
    (64 at most) of which there are several, as (bit, rows beyond the first).
    """
    ids = rows.groupBy("_source", "_word", "_bit").agg(F.sum("_n").alias("_n"))
    more = F.when(F.col("_n") > 1, F.struct(F.col("_bit").alias("bit"), (F.col("_n") - 1).alias("more")))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))
    return ids.groupBy("_source", "_word").agg(F.bit_or(bit).alias("_bits"), F.sum("_n").alias("_rows"), F.collect_list(more).alias("_more"))


def with_directory(words: DataFrame) -> DataFrame:
    """words with _before: the rows of all lower words of their source.

    The directory is a radix tree over word numbers: each level sums up runs of
    1024 nodes below it, until a source has one run at most, so no window holds
    more than 1024 rows, however ids are spread.
    """
    low, high = words.agg(F.min("_word"), F.max("_word")).first()
    levels = [words.select("_source", F.col("_word").alias("_node"), "_rows")]
    while low is not None and (high >> DIRECTORY_BITS * (len(levels) - 1)) - (low >> DIRECTORY_BITS * (len(levels) - 1)) >= 1 << DIRECTORY_BITS:
        above = F.shiftright("_node", DIRECTORY_BITS).alias("_node")
        levels.append(levels[-1].groupBy("_source", above).agg(F.sum("_rows").alias("_rows")))

    def ahead(*parts: str) -> Column:
        return F.coalesce(F.sum("_rows").over(Window.partitionBy(*parts).orderBy("_node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    before = levels.pop().withColumn("_before", ahead("_source")).drop("_rows")
    while levels:
        above = before.select("_source", F.col("_node").alias("_above"), F.col("_before").alias("_base"))
        here = levels.pop().withColumn("_above", F.shiftright("_node", DIRECTORY_BITS)).join(above, ["_source", "_above"])
        before = here.select("_source", "_node", (F.col("_base") + ahead("_source", "_above")).alias("_before"))
    return words.join(before.withColumnRenamed("_node", "_word"), ["_source", "_word"])


def placed(leaves: DataFrame, ws: Workspace) -> DataFrame:
    """leaves, each row as often as it counts, with at: its place in the order of its source, from 0.

    The place is a rank query: rows of lower words, then those of the word's
    lower ids. Rows that share an id follow their digest, ranked by its first
    bits within buckets; equal rows take any of their places.
    """
    word = F.coalesce(F.shiftright("doc_id", 6), F.lit(NO_WORD)).alias("_word")
    bit = F.coalesce(F.col("doc_id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("_bit")
    rows = leaves.select("*", word, bit)
    words = with_directory(ws.table(id_bitmaps(rows), "bitmaps"))
    below = F.col("_bits").bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("_bit"))))
    lower = F.aggregate(F.filter("_more", lambda x: x["bit"] < F.col("_bit")), F.lit(0).cast("long"), lambda s, x: s + x["more"])
    # how many rows share the id, beyond the first
    shared = F.coalesce(F.get(F.filter("_more", lambda x: x["bit"] == F.col("_bit")), F.lit(0))["more"], F.lit(0))
    ranked = rows.join(words, ["_source", "_word"]).select(*rows.columns, shared.alias("_shared"), (F.col("_before") + F.bit_count(below) + lower).alias("at"))
    ranked = ws.table(ranked, "ranked")

    kept = ["_source", "at", "doc_id", "leaf", "tampered"]
    alone, several = ranked.where("_shared = 0").select(kept), ranked.where("_shared > 0")
    if several.isEmpty():
        return alone
    part = (F.conv(F.substring("leaf", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    several = several.withColumn("_bucket", F.floor(part * buckets(F.col("_shared"))))
    several = running(several, ["_source", "_word", "_bit"], "_bucket", ["leaf"], F.col("_n"), "_within").withColumn("at", F.col("at") + F.col("_within"))
    # the copies of a row in two steps, so that no array grows with their number
    several = several.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(_n - 1) div 4096")))).withColumn("at", F.col("at") + 4096 * F.col("_k"))
    several = several.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(4095).cast("long"), F.col("_n") - 1 - 4096 * F.col("_k"))))).withColumn("at", F.col("at") + F.col("_k"))
    return ws.table(alone.unionByName(several.select(kept)), "placed")


def reduced(nodes: DataFrame, most: int, ws: Workspace, name: str, extra: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The slot arrays of each level over nodes(group, total, at, digest), and the (group, top) that remain.

    A level puts every FAN consecutive nodes of a group into an array keyed by
    group and run, and digests it; a group of one node is done. most is the
    largest total.
    """
    runs, tops = [], []
    while most > 1:
        tops.append(nodes.where("total = 1"))
        slots = F.sort_array(F.collect_list(F.struct("at", "digest", *extra)))
        level = nodes.where("total > 1").groupBy("group", "total", F.expr(f"at div {FAN}").alias("node")).agg(slots.alias("slots"))
        level = ws.table(level, f"{name}{len(runs)}")
        runs.append(level)
        nodes = level.select("group", F.expr(f"(total + {FAN - 1}) div {FAN}").alias("total"), F.col("node").alias("at"), F.sha2(F.array_join("slots.digest", ""), 256).alias("digest"))
        extra, most = (), -(-most // FAN)
    out = nodes.select("group", F.col("digest").alias("top"))
    for t in tops:
        out = out.unionByName(t.select("group", F.col("digest").alias("top")))
    return runs, out


def with_paths(runs: list[DataFrame]) -> DataFrame:
    """(group, slot, path) for each node of the lowest level: the digests before and after it in its run, and so on up to the top."""
    above, out = None, None
    for level in reversed(runs):
        path = F.array().cast("array<struct<before:string,after:string>>")
        if above is not None:
            level = level.join(above, ["group", "node"], "left")
            path = F.coalesce("up", path)
        digests = F.col("slots.digest")
        here = F.struct(F.array_join(F.slice(digests, 1, F.col("k")), "").alias("before"), F.array_join(F.slice(digests, F.col("k") + 2, FAN), "").alias("after"))
        cols = ["group", "slots", F.posexplode("slots").alias("k", "slot")] + ["up"] * (above is not None)
        out = level.select(*cols).select("group", "slot", F.concat(F.array(here), path).alias("path"))
        above = out.select("group", F.col("slot.at").alias("node"), F.col("path").alias("up"))
    return out


def source_ranks(subroots: DataFrame, ws: Workspace) -> DataFrame:
    """subroots(group, top) with at: the place of the group by its bytes; sources are sorted within ranges of them."""
    parts = subroots.repartitionByRange(subroots.sparkSession.sparkContext.defaultParallelism, "group").withColumn("_part", F.spark_partition_id())
    parts = ws.table(parts, "source_parts")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row a range, as many as the default parallelism
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("group")) - 1
    return parts.join(before, "_part").select("group", "top", (F.col("_before") + within).alias("at"))


def merkle_manifest(documents: DataFrame, every: int = 5) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of documents.

    Leaves are digests of doc_id, source, lang, n_chars and text. They are
    placed in their source by rank queries on bitmaps of its ids, not sorted;
    runs of 16 meet in arrays keyed by source and run, level by level, up to a
    subroot of each source; subroots by source go on in the same way up to the
    root. A proof is the digests beside a leaf's path. Where every divides the
    CRC-32 of the id, the root is folded from the leaf of the lower-cased text.

    Texts are read once; then rows of two digests move. A null source is one of
    its own, first in order; null ids come first in their source, are digested
    as `-` and never tampered with. Rows that share an id follow their leaf;
    equal rows are leaves of their own beside each other, and which of them has
    which proof is open. Null and empty texts differ. A very long text counts
    whole. An empty table gives no rows; other columns are not read.
    """
    ws = Workspace(documents.sparkSession, "manifest")
    leaves = ws.table(_leaves(documents, every), "leaves")
    totals = leaves.groupBy(F.col("_source").alias("group")).agg(F.sum("_n").alias("total"))
    size = totals.agg(F.count("*").alias("sources"), F.coalesce(F.max("total"), F.lit(1)).alias("most")).first()
    small = F.broadcast if size.sources <= BROADCAST_SOURCES else lambda table: table
    nodes = placed(leaves, ws).withColumnRenamed("_source", "group").withColumnRenamed("leaf", "digest").join(small(totals), "group")
    runs, subroots = reduced(nodes, size.most, ws, "level", ("doc_id", "tampered"))

    ranks = ws.table(source_ranks(subroots, ws), "sources")
    upper = ranks.select(F.lit("").alias("group"), F.lit(size.sources).alias("total"), "at", F.col("top").alias("digest"), F.col("group").alias("source"))
    tops, root = reduced(upper, size.sources, ws, "upper", ("source",))
    none = F.array().cast("array<struct<before:string,after:string>>")
    if tops:
        sources = with_paths(tops).select(F.col("slot.source").alias("group"), F.col("slot.digest").alias("subroot"), F.col("path").alias("upper"))
    else:
        sources = ranks.select("group", F.col("top").alias("subroot"), none.alias("upper"))
    top = root.first()
    sources = ws.table(sources.withColumn("root", F.lit(top.top if top else None).cast("string")), "proofs")

    single = nodes.where("total = 1").select("group", "doc_id", F.col("digest").alias("leaf"), "tampered", none.alias("path"))
    rows = single
    if runs:
        rows = rows.unionByName(with_paths(runs).select("group", "slot.doc_id", F.col("slot.digest").alias("leaf"), "slot.tampered", "path"))
    rows = rows.join(small(sources), "group").withColumn("path", F.concat("path", "upper"))
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("tampered", "leaf"), lambda acc, x: F.sha2(F.concat(x["before"], acc, x["after"]), 256))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
