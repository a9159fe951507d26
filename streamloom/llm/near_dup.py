"""MinHash near-duplicate groups with HyperMinHash signatures.

A document's signature has one register for each of REGISTERS buckets: the
shingle keys of a bucket leave their smallest mixed value, stored as its count
of leading zeros and the MANTISSA bits after the first one bit. Equal sets
collapse to one class first. Bands of compressed registers bring classes
together, the collision-corrected estimate of their likeness drops those far
below the threshold, and the full shingle sets decide.

No step lists all pairs of a bucket. The members of a bucket are first held
against its smallest one; members that are then in one component need no
further pair. What is left, members outside their bucket's largest component,
is held against the whole bucket in blocks of BLOCK classes, fewer where sets
are large, so that every pair that shares a band is either in one component
already, or out of reach, or decided: a shingle of one member that no other such member has is in no
intersection, so sizes and counts of shared shingles bound a pair's likeness.
A block is one row with all its members, and two blocks meet as one row: no
member is joined or copied by itself for each block that it meets.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamloom.llm.components import components
from streamloom.storage import Workspace
from streamloom.llm.textkeys import mix, shingles

REGISTERS, ROWS, MANTISSA = 96, 4, 25
#: Classes of a bucket that one task compares with as many others at a time, and shingles that these are meant to have.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Rows of two longs below which a table of ids is broadcast: 32 MB.
BROADCAST_ROWS = 2_000_000

_U = np.uint64
MEMBER = ("rep", "label", "n_shingles", "shared", "signature", "shingles")
SIGNED = "doc_id long, row long, n_shingles long, key1 long, key2 long, signature binary, bands array<long>"


def registers(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of compressed registers for each document; 0 marks an empty bucket."""
    docs = len(bounds) - 1
    spread = mix(keys + _U(0xA24BAED4963EE407))
    bucket = ((keys >> _U(32)) * _U(REGISTERS)) >> _U(32)
    least = np.full(docs * REGISTERS, ~_U(0), _U)
    np.minimum.at(least, np.repeat(np.arange(docs), np.diff(bounds)) * REGISTERS + bucket.astype(np.int64), spread)
    zeros, top = np.zeros(len(least), _U), least.copy()
    for shift in (32, 16, 8, 4, 2, 1):
        small = top < (_U(1) << _U(64 - shift))
        zeros[small] += _U(shift)
        top[small] <<= _U(shift)
    mantissa = (top << _U(1)) >> _U(64 - MANTISSA)
    out = ((zeros + _U(1)) << _U(MANTISSA)) | mantissa
    out[least == ~_U(0)] = 0
    return out.astype(np.uint32).reshape(docs, REGISTERS)


def band_keys(table: np.ndarray, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each row's bands, and which of them have a register in use."""
    parts = table.reshape(len(table), -1, rows).astype(_U)
    keys = np.broadcast_to(np.arange(parts.shape[1], dtype=_U) + _U(1), parts.shape[:2]).copy()
    for k in range(rows):
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys, parts.any(axis=2)


def set_keys(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two keys of each document's shingle set."""
    out = np.zeros((3, len(bounds) - 1), _U)
    for d in range(len(bounds) - 1):
        own = np.unique(keys[bounds[d] : bounds[d + 1]])
        out[:, d] = len(own), own.sum(), mix(own).sum()
    return out[0], mix(out[1] + out[0]), mix(out[2])


def signed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, text) to rows of SIGNED."""
    for batch in batches:
        for first, last, keys, bounds in shingles(batch.column(2)):
            table = registers(keys, bounds)
            bands, used = band_keys(table)
            n, key1, key2 = set_keys(keys, bounds)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(used.sum(axis=1))]), pa.int32()), pa.array(bands[used].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).slice(first, last - first) for k in (0, 1)),
                    pa.array(n.astype(np.int64)),
                    pa.array(key1.view(np.int64)),
                    pa.array(key2.view(np.int64)),
                    pa.array([x.tobytes() for x in table], pa.binary()),
                    lists,
                ],
                [c.split()[0] for c in SIGNED.split(", ")],
            )


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of rows of registers, corrected for registers that meet by chance."""
    used = ((a != 0) | (b != 0)).sum(axis=-1)
    same = ((a == b) & (a != 0)).sum(axis=-1)
    # two unlike values share their leading zeros with odds of 1/3 and then each mantissa bit with 1/2
    chance = used / 3 * 2.0**-MANTISSA
    return (same - chance) / np.maximum(used - chance, 1e-9)


def least_estimate(threshold: float, used: np.ndarray) -> np.ndarray:
    """The estimate below which a pair of that likeness falls with odds under 1e-9 (Hoeffding)."""
    return threshold - np.sqrt(np.log(1e9) / 2 / np.maximum(used, 1))


def likely(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    return estimate(a, b) >= least_estimate(threshold, ((a != 0) | (b != 0)).sum(axis=-1))


def _rows(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _likely_batches(threshold: float, kind: type) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = likely(_rows(batch.column(2), kind), _rows(batch.column(3), kind), threshold)
                yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _block_batches(percent: int, band_rows: int, kind: type) -> Callable:
    """(key, hub, main, members, others) to links across labels, one at most for each two labels of a row.

    members are a block's, arrays of MEMBER; they meet each other or, where
    there are others, those of another block of the bucket.
    """
    threshold = percent / 100

    def pairs(key: int, hub: int, main: int, sides: list[pa.StructArray]) -> list[tuple[int, int]]:
        side = np.repeat(np.arange(len(sides)), [len(x) for x in sides])
        label, rep, n, shared = (np.concatenate([x.field(c).to_numpy() for x in sides]) for c in ("label", "rep", "n_shingles", "shared"))
        table = np.concatenate([_rows(x.field("signature"), kind) for x in sides])
        sets = [v for x in sides for v in x.field("shingles").to_pylist()]
        joined: dict[int, int] = {}

        def top(x: int) -> int:
            while x in joined:
                x = joined[x]
            return x

        out = []
        # a pair with the bucket's smallest member has been decided before
        for x in np.flatnonzero((label != main) & (rep != hub)):
            # a pair of minor members comes up twice
            other = (label != label[x]) & (rep != hub) & ((label == main) | (rep > rep[x]))
            other = np.flatnonzero(other & (side != side[x]) if len(sides) > 1 else other)
            most = np.minimum(shared[other], shared[x])
            other = other[most >= (threshold - 1e-9) * (n[other] + n[x] - most)]
            other = other[likely(table[other], table[x], threshold)]
            if not len(other):
                continue
            # a pair counts in its first common band
            bands, used = (v[0] for v in band_keys(table[x][None], band_rows))
            common = (table[other] == table[x]).reshape(len(other), -1, band_rows).all(axis=2) & used
            own = np.frombuffer(sets[x], _U)
            for y in other[bands[common.argmax(axis=1)].view(np.int64) == key]:
                a, b = top(int(label[x])), top(int(label[y]))
                if a != b and alike(own, np.frombuffer(sets[y], _U), percent):
                    out.append((int(rep[x]), int(rep[y])))
                    joined[max(a, b)] = min(a, b)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for *bucket, members, others in zip(*batch.columns, strict=True):
                found += pairs(*(x.as_py() for x in bucket), [x.values for x in (members, others) if x.is_valid])
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], ["a", "b"])

    return run


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach percent of their union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _confirm_batches(percent: int) -> Callable:
    """Rows (a, b, text_a, text_b) to the pairs whose full sets reach percent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[int, np.ndarray] = OrderedDict()  # a few sets: the rows of a partition come in the order of b

        def own(node: int, text: str | None) -> np.ndarray:
            if node not in kept:
                kept[node] = next((np.unique(k) for _, _, k, _ in shingles(pa.array([text], pa.large_string()))), np.zeros(0, _U))
                if len(kept) > 8:
                    kept.popitem(last=False)
            return kept[node]

        for batch in batches:
            keep = [alike(own(a, x), own(b, y), percent) for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _few(df: DataFrame) -> DataFrame:
    """df, broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _shingle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, text) to a row for each member of each set."""
    for batch in batches:
        for first, last, keys, bounds in shingles(batch.column(1)):
            sets = [np.unique(keys[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            reps = np.repeat(batch.column(0).slice(first, last - first).to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(np.concatenate(sets).view(np.int64))], ["rep", "shingle"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, text) to (rep, its sorted shingle keys)."""
    for batch in batches:
        for first, last, keys, bounds in shingles(batch.column(1)):
            sets = [np.unique(keys[bounds[d] : bounds[d + 1]]).tobytes() for d in range(last - first)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(sets, pa.binary())], ["rep", "shingles"])


def _lone_shingles(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, lone): how many shingles of each of the ids' documents no other of them has."""
    texts = docs.join(_few(ids), "doc_id", "left_semi")
    # rows that repeat an id: their shingles count, but the id's number stays open
    several = texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("rep"))
    rows = texts.select(F.col("doc_id").alias("rep"), "text").mapInArrow(_shingle_batches, "rep long, shingle long")
    return rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).where("n = 1").groupBy("rep").agg(F.count("*").alias("lone")).join(several, "rep", "left_anti")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs of class representatives whose full sets are alike; only their texts move."""
    ids = _few(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = docs.join(ids, "doc_id", "left_semi")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_confirm_batches(percent), "a long, b long").distinct()


def _mixed(placed: DataFrame) -> DataFrame:
    """The rows of buckets with several labels, with the bucket's size and its main label; few such buckets move no row of a large one."""
    parts = placed.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.sum("n").alias("size"))
    return placed.select("key", "hub", "rep", "label").join(_few(mixed.where("labels > 1").drop("labels")), "key")


def _packed(members: DataFrame) -> DataFrame:
    """One row for each block of a bucket, with its members and whether any is minor."""
    minor, rows = F.bool_or(F.col("label") != F.col("main")), F.collect_list(F.struct(*MEMBER))
    return members.groupBy("key", "block").agg(F.min("hub").alias("hub"), F.min("main").alias("main"), minor.alias("minor"), rows.alias("members"))


def linked(reps: DataFrame, docs: DataFrame, percent: int, ws: Workspace, band_rows: int = ROWS, kind: type = np.uint32) -> DataFrame:
    """(node, label): the component of each linked one of reps(rep, n_shingles, signature, bands).

    docs(doc_id, text) has the text of each rep, which is its doc_id there. A
    signature is a row of registers of that kind, a whole number of bands of
    band_rows registers each.
    """
    threshold = percent / 100
    bands = reps.select("rep", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("size")).where("size > 1")
    members = ws.table(bands.join(buckets, "key"), "members")
    sides = reps.select("rep", "signature")
    star = members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    signs = star.join(sides.toDF("b", "sign_b"), "b").join(sides.toDF("a", "sign_a"), "a").select("a", "b", "sign_a", "sign_b")
    pairs = ws.table(signs.mapInArrow(_likely_batches(threshold, kind), "a long, b long"), "star")
    links = ws.table(confirmed(pairs, docs, percent), "star-links")
    labels = components(links, ws, "star-cc")

    # buckets whose members are not all in one component
    placed = members.where("size > 2").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "hub", "rep", F.coalesce("label", "rep").alias("label"))
    placed = ws.table(placed, "placed")
    mixed = ws.table(_mixed(placed), "mixed")
    ids = ws.table(mixed.select(F.col("rep").alias("doc_id")).distinct(), "mixed-ids")
    # a member most of whose shingles no other one has is linked with none
    shared = F.col("n_shingles") - F.coalesce("lone", F.lit(0))
    sized = reps.join(_lone_shingles(ids, docs), "rep", "left").select("rep", "n_shingles", shared.alias("shared"), "signature").where(f"100 * shared >= {percent} * n_shingles")
    sized = ws.table(sized.join(ids.withColumnRenamed("doc_id", "rep"), "rep", "left_semi"), "sized")
    near = _mixed(placed.join(sized.select("rep"), "rep", "left_semi")).join(sized.select("rep", "n_shingles"), "rep")
    near = ws.table(near, "near")
    held = near.groupBy("key").agg(F.sum("n_shingles").alias("held"))
    texts = docs.join(_few(ws.table(near.select(F.col("rep").alias("doc_id")).distinct(), "near-ids")), "doc_id", "left_semi")
    sets = texts.select(F.col("doc_id").alias("rep"), "text").mapInArrow(_set_batches, "rep long, shingles binary").dropDuplicates()

    # a block has BLOCK members and BLOCK_SHINGLES shingles on average, at most
    near = near.join(_few(held), "key")
    near = near.withColumn("blocks", F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("held") / BLOCK_SHINGLES)).cast("int"))
    near = near.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    each = near.join(sized.select("rep", "shared", "signature").join(sets, "rep"), "rep")
    rows = _packed(each).where("minor")
    # blocks of a bucket meet if one of them has minor members; most buckets have a single one
    parts = near.where("blocks > 1").groupBy("key", "block").agg(F.bool_or(F.col("label") != F.col("main")).alias("minor"))
    meet = parts.toDF("key", "i", "minor_i").join(parts.toDF("key", "j", "minor_j"), "key").where("i < j AND (minor_i OR minor_j)").select("key", "i", "j")
    meet = ws.table(meet, "meet")
    if meet.isEmpty():
        rows = rows.withColumn("others", F.lit(None).cast(rows.schema["members"].dataType))
    else:
        wide = _packed(each.where("blocks > 1"))
        first = _few(meet).join(wide.withColumnRenamed("block", "i"), ["key", "i"])
        rows = rows.unionByName(first.join(wide.select("key", F.col("block").alias("j"), F.col("members").alias("others")), ["key", "j"]), allowMissingColumns=True)
    rows = rows.select("key", "hub", "main", "members", "others")
    links = ws.table(links.unionByName(rows.mapInArrow(_block_batches(percent, band_rows, kind), "a long, b long").distinct()), "links")
    ws.drop("members", "placed", "star", "mixed")
    return components(links, ws)


def row_key(doc_id: Column, text: Column) -> Column:
    """A key of a row's id and text; those of two unlike rows are equal with odds of 2**-64."""
    return F.xxhash64(doc_id.cast("long"), text)


def _judged(documents: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, row, n_shingles, first) for each row of documents.

    row is its row_key, first the (unnamed, doc_id, row) of the component's
    smallest row, with ids before none; it is null without shingles.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    ws = Workspace(docs.sparkSession, "near-dup")

    signed = ws.table(docs.mapInArrow(signed_batches, SIGNED), "signed")
    # a row of each class stands for it
    here = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    classes = ws.table(signed.where("n_shingles > 0").groupBy("key1", "key2").agg(F.min(here).alias("first")).withColumn("rep", F.col("first.row")), "classes")
    own = signed.withColumnRenamed("row", "rep").join(classes.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])
    reps = ws.table(own.select("rep", "n_shingles", "signature", "bands"), "reps")

    labels = linked(reps, docs.select(F.col("row").alias("doc_id"), "text"), percent, ws).withColumnRenamed("node", "rep")
    # only linked classes get another first row than their own
    firsts = labels.join(classes.select("rep", "first"), "rep").groupBy("label").agg(F.min("first").alias("least"))
    found = classes.join(labels.join(firsts, "label").select("rep", "least"), "rep", "left")
    found = found.select("key1", "key2", F.coalesce("least", "first").alias("first"))
    out = signed.select("doc_id", "row", "n_shingles", "key1", "key2").join(found, ["key1", "key2"], "left")
    out = ws.table(out.select("doc_id", "row", "n_shingles", "first"), "judged")
    ws.keep("judged")
    return out


def near_duplicates(documents: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of documents.

    Documents are linked if 100 * |intersection| >= percent * |union| of their
    sets of distinct five-word shingles; component_id is the smallest doc_id
    that links reach. A pair of likeness 0.85 shares no band with odds of about
    2e-8; no cap holds.

    A null or empty text, or one without words, has no shingles and is linked
    with nothing, not even its like; it is kept. Each row is judged by its own
    text, also where it repeats a doc_id or has none; a component without any
    id has a null component_id, and only the rows of one text of it are kept.
    Very long texts count whole, shingle by shingle. Ties, several documents of
    equal sets, go to the smallest id. An empty table gives no rows; other
    columns are not read.
    """
    out = _judged(documents, percent, id_col, text_col)
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    kept = (F.col("n_shingles") == 0) | F.coalesce(F.col("doc_id") == component, F.col("row") == F.col("first.row"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def kept_documents(documents: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of documents that stay when each group leaves one: that of its smallest doc_id.

    Each row is judged by its own text, also where it repeats a doc_id or has
    none; an id goes before none. Of rows equal in id and text a single one
    stays, but each row without an id and without words is a document of its
    own. Very long texts are read whole. An empty table gives no rows; all
    columns of documents come back.

    While the rows that go or repeat are few enough to broadcast, texts stay
    where they are; only repeated rows are dealt by their key.
    """
    judged = _judged(documents, percent, "doc_id", "text")
    alone = (F.col("n_shingles") == 0) & F.col("doc_id").isNull()
    goes = (F.col("n_shingles") > 0) & (F.col("row") != F.col("first.row"))
    rows = judged.groupBy(F.col("row").alias("_row")).agg(F.bool_or(goes).alias("_goes"), F.bool_and(alone).alias("_alone"), F.count("*").alias("_n"))
    rows = Workspace(documents.sparkSession, "kept").table(rows.where("_goes OR _n > 1 AND NOT _alone").select("_row", "_goes"), "decided")
    placed = documents.withColumn("_row", row_key(F.col("doc_id"), F.col("text"))).join(_few(rows), "_row", "left")
    return placed.where("_goes IS NULL").unionByName(placed.where("NOT _goes").dropDuplicates(["_row"])).select(documents.columns)
