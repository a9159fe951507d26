"""MinHash fingerprints of documents, in vectorised numpy."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.llm.near_dup import band_keys, linked, row_key, set_keys
from streamloom.storage import Workspace
from streamloom.llm.textkeys import mix, shingles

#: Universal hash functions x -> a * x + b modulo 2**64; the value kept of each minimum has 16 bits.
PERMUTATIONS = 128
#: Shingles that are permuted at a time.
STEP = 2048
#: Bounds of doc_id, and buckets between two of them at most.
BOUNDS, PARTS, BUCKET_ROWS = 256, 400, 2000

_U = np.uint64
_A = mix(np.arange(1, PERMUTATIONS + 1, dtype=_U)) | _U(1)
_B = mix(np.arange(1, PERMUTATIONS + 1, dtype=_U) + _U(1 << 32))


def signatures(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, fingerprints, keys, bounds) for runs of a column's documents.

    A fingerprint is a row of PERMUTATIONS 16-bit numbers; that of a text
    without words is all zeros, and no number of another is zero.
    """
    for first, last, keys, bounds in shingles(column):
        out = np.zeros((last - first, PERMUTATIONS), np.uint16)
        for d in range(last - first):
            least = None
            for k in range(bounds[d], bounds[d + 1], STEP):
                own = keys[k : min(k + STEP, bounds[d + 1])]
                now = (own[None, :] * _A[:, None] + _B[:, None]).min(axis=1)
                least = now if least is None else np.minimum(least, now)
            if least is not None:
                out[d] = mix(least) % _U(65535) + _U(1)
        yield first, last, out, keys, bounds


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal numbers in each two fingerprints."""
    return (a == b).mean(axis=-1)


def _all_signatures(texts: list[str]) -> np.ndarray:
    parts = [x for _, _, x, _, _ in signatures(pa.array(texts, pa.large_string()))]
    return np.concatenate(parts) if parts else np.zeros((0, PERMUTATIONS), np.uint16)


def edited(text: str, following: str) -> str:
    """text with the last half of its code points replaced by the first as many of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def id_cells(cuts: list[int], low: int, high: int, parts: int) -> list[tuple[int, int, int, bool]]:
    """(first id, parts, first bucket, whether it holds this id alone) of the ranges between quantiles of ids.

    An id that is several quantiles has a range of its own, with as many times
    the parts.
    """
    held = Counter(cuts)
    alone = {x: n for x, n in held.items() if n > 1}
    bounds = {low, high, *cuts, *(x + 1 for x in alone if x < high)}
    out, bucket = [], 0
    for first in sorted(bounds):
        n = parts * alone.get(first, 1)
        out.append((first, n, bucket, first in alone))
        bucket += n
    return out


def bucket_of(cells: list[tuple[int, int, int, bool]], o: Column, row: Column) -> Column:
    """The bucket of a row, rising with (o, row): its range's, and even parts of that, in exact arithmetic.

    Ranges are parted by o, those of one id by row.
    """
    firsts = F.array([F.lit(c[0]) for c in cells])
    ends = F.array([F.lit(str(c[0] + 1 if k + 1 == len(cells) else cells[k + 1][0])).cast("decimal(20,0)") for k, c in enumerate(cells)])
    exact = lambda c: c.cast("decimal(20,0)")

    def of(cell: Column) -> Column:
        at = lambda j: F.get(F.array([F.lit(c[j]) for c in cells]), cell)
        low, n = exact(F.get(firsts, cell)), at(1)
        by_id = F.floor((exact(o) - low) * exact(n) / (F.get(ends, cell) - low))
        by_row = F.floor((exact(row) + F.lit(str(1 << 63)).cast("decimal(20,0)")) * exact(n) / F.lit(str(1 << 64)).cast("decimal(20,0)"))
        part = F.when(at(3), by_row).otherwise(by_id).cast("long")
        return at(2) + F.least(part, n - 1)

    return F.transform(F.array(F.size(F.filter(firsts, lambda b: b <= o)) - 1), of)[0].cast("long")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, component_id long"


def _edited_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tail, doc_id, row, text, component), each followed by the next document in order, to rows of EDITED.

    A tail only follows. A row with a component comes before the documents of
    its row key and has no text of its own.
    """
    tails: list[int] = []
    ids: list[int | None] = []
    texts: list[str] = []
    of: list[int | None] = []
    signs = np.zeros((0, PERMUTATIONS), np.uint16)
    noted: tuple[int | None, int | None] = (None, None)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            new = []
            for tail, doc, row, text, component, note in zip(*(c.to_pylist() for c in batch.slice(at, 1000).columns), strict=True):
                if note:
                    noted = (row, component)
                    continue
                tails.append(tail)
                ids.append(doc)
                new.append(text or "")
                of.append(noted[1] if row == noted[0] else doc)
            texts += new
            signs = np.concatenate([signs, _all_signatures(new)])
            own = [k for k in range(len(texts) - 1) if not tails[k]]
            if own:
                changed = [edited(texts[k], texts[k + 1]) for k in own]
                marks = _all_signatures(changed)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[k] for k in own], pa.int64()),
                        pa.array([len(texts[k]) for k in own], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed], pa.string()),
                        pa.array([signs[k].tobytes().hex() for k in own], pa.string()),
                        pa.array([x.tobytes().hex() for x in marks], pa.string()),
                        pa.array(likeness(signs[own], marks)),
                        pa.array(likeness(signs[own], signs[np.array(own) + 1])),
                        pa.array([of[k] for k in own], pa.int64()),
                    ],
                    [c.split()[0] for c in EDITED.split(", ")],
                )
            tails, ids, texts, of, signs = tails[-1:], ids[-1:], texts[-1:], of[-1:], signs[-1:]


def fingerprint_edits(documents: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of EDITED: each text's fingerprint, its edited text's, the likeness to it and to the next document, and the component.

    component_id is that of fingerprint_classes: the smallest doc_id that
    verified links reach, the own one where there are none.

    The next document is that of the next doc_id, nulls first; rows that share
    one are ordered by a hash of their text, and after the last comes the first.
    Documents move once: they are dealt by ranges of doc_id that follow the ids'
    quantiles, sorted within a task and read as a stream, and each range also
    gets the first row of the next. Components go the same way, ahead of their
    documents. Rows of an id that holds many quantiles are parted further by
    the hash of their text.

    A null text is empty. Texts without words have equal fingerprints, unlike
    all others. Very long texts are read whole, and equal rows follow each
    other in any order, in one task. Ids are any longs. An empty table gives no rows; other columns are not read.
    """
    text = F.col(text_col).alias("text")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), text).withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    linked_rows = _classed(docs, percent).where("NOT component_id <=> doc_id")
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    docs = docs.withColumn("o", order)
    cuts = F.array([F.lit(k / BOUNDS) for k in range(BOUNDS + 1)])
    found = docs.agg(F.percentile_approx("o", cuts, 10_000).alias("cuts"), F.count("*").alias("n"), F.min("o").alias("low"), F.max("o").alias("high")).first()
    cells = id_cells(found.cuts or [], found.low or 0, found.high or 0, min(PARTS, -(-found.n // (BOUNDS * BUCKET_ROWS)) or 1))

    def placed(rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", bucket_of(cells, F.col("o"), F.col("row")))

    # one row a bucket, twice BOUNDS * PARTS at most
    heads = placed(docs).groupBy("bucket").agg(F.min(F.struct("o", "row")).alias("first"))
    over = Window.orderBy("bucket")
    heads = heads.select("first.o", "first.row", F.coalesce(F.lag("bucket").over(over), F.max("bucket").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    here, tail = F.struct("bucket", F.lit(0).alias("tail")), F.struct(F.col("before").alias("bucket"), F.lit(1).alias("tail"))
    both = placed(docs).join(F.broadcast(heads), ["o", "row"], "left").select("o", "doc_id", "row", "text", F.explode(F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, tail))).alias("at"))
    rows = both.select("at.bucket", "at.tail", "o", "doc_id", "row", "text", F.lit(None).cast("long").alias("component_id"), F.lit(False).alias("note"))
    notes = placed(linked_rows.withColumn("o", order)).select("bucket", F.lit(0).alias("tail"), "o", "doc_id", "row", F.lit(None).cast("string").alias("text"), "component_id", F.lit(True).alias("note"))
    rows = rows.unionByName(notes).repartition("bucket").sortWithinPartitions("bucket", "tail", "o", "row", F.desc("note"))
    return rows.select("tail", "doc_id", "row", "text", "component_id", "note").mapInArrow(_edited_batches, EDITED)


#: Bands of this many permutations: likeness 0.8 shares none of 25 with odds of 4e-5.
BAND_ROWS = 5

MARKED = "doc_id long, row long, n_shingles long, key1 long, key2 long, signature binary, bands array<long>"


def _marked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, signs, keys, bounds in signatures(batch.column(2)):
            table = np.ascontiguousarray(signs[:, : PERMUTATIONS // BAND_ROWS * BAND_ROWS])
            bands, used = band_keys(table, BAND_ROWS)
            n, key1, key2 = set_keys(keys, bounds)
            rows = [b[u].view(np.int64) for b, u in zip(bands, used, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).slice(first, last - first) for k in (0, 1)),
                    pa.array(n.astype(np.int64)),
                    pa.array(key1.view(np.int64)),
                    pa.array(key2.view(np.int64)),
                    pa.array([x.tobytes() for x in table], pa.binary()),
                    pa.array(rows, pa.list_(pa.int64())),
                ],
                [c.split()[0] for c in MARKED.split(", ")],
            )


def _classed(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, row, component_id), once for each row key of docs(doc_id, row, text) with a shingle, from a table of its own.

    Equal sets form one class, a row of which stands for it; signatures and
    bands are kept for these alone.
    """
    ws = Workspace(docs.sparkSession, "fingerprints")
    docs = docs.select("doc_id", "row", "text")
    here = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    marked = ws.table(docs.mapInArrow(_marked_batches, MARKED).where("n_shingles > 0"), "marked")
    classes = ws.table(marked.groupBy("key1", "key2").agg(F.min(here).alias("first")).withColumn("rep", F.col("first.row")), "classes")
    own = marked.withColumnRenamed("row", "rep").join(classes.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])
    reps = ws.table(own.select("rep", "n_shingles", "signature", "bands"), "reps")
    rows = ws.table(marked.select("doc_id", "row", "key1", "key2").distinct(), "rows")
    ws.drop("marked")
    labels = linked(reps, docs.select(F.col("row").alias("doc_id"), "text"), percent, ws, BAND_ROWS, np.uint16)
    # only linked classes get another first row than their own
    placed = labels.withColumnRenamed("node", "rep")
    least = placed.join(classes.select("rep", "first"), "rep").groupBy("label").agg(F.min("first").alias("least"))
    found = classes.join(placed.join(least, "label").select("rep", "least"), "rep", "left")
    found = found.select("key1", "key2", F.coalesce("least.doc_id", "first.doc_id").alias("component_id"))
    out = ws.table(rows.join(found, ["key1", "key2"]).select("doc_id", "row", "component_id"), "found")
    ws.keep("found")
    return out


def fingerprint_classes(documents: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): documents that fingerprint bands bring together and whose full sets reach percent.

    Equal sets form one class, a row of which stands for it. The bands' buckets
    are decided as those of near_duplicates: each member against one of them,
    then those outside the bucket's largest component against all of it.
    component_id is the smallest doc_id that links reach. Rows that repeat a
    doc_id are judged each by its own text; equal rows come once. Null ids and
    texts without words are left out, very long texts are read whole. Empty
    input gives no rows.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    return _classed(docs.withColumn("row", row_key(F.col("doc_id"), F.col("text"))), percent).select("doc_id", "component_id")
