"""Ids of any kind: at the ends of 64 bits, hashed, repeated and missing."""

import hashlib
import random
from collections import Counter

import pytest

from streamloom.llm import fingerprints
from tests.llm.test_operators import DOCS, table

_RNG = random.Random(9)
_END = (1 << 63) - 1
IDS = {
    "around 2**53": [(1 << 53) + k for k in range(-30, 30)],
    "at the upper end": [_END - k for k in range(60)],
    "at the lower end": [-_END - 1 + k for k in range(60)],
    "at both ends": [-_END - 1, _END, 0, _END - 1, -_END],
    "hashed": [_RNG.randrange(-_END - 1, _END) for _ in range(3000)],
    "missing": [None] * 3000,
    "one": [7] * 2000 + [None] * 500 + [8, -5],
}


@pytest.mark.parametrize("name", IDS)
def test_edits_follow_ids_of_any_kind(name, spark):
    ids = IDS[name]
    rows = [(i, f"text {k} of some words that go on {k * k}", "en", "a", 1) for k, i in enumerate(ids)]
    got = fingerprints.fingerprint_edits(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert Counter(r.doc_id for r in got) == Counter(ids)
    digest = lambda text, after: hashlib.sha256((text[: len(text) - len(text) // 2] + after[: len(text) // 2]).encode()).hexdigest()
    if len(set(ids)) == len(ids):
        order = sorted(rows)
        want = {r[0]: digest(r[1], order[(k + 1) % len(order)][1]) for k, r in enumerate(order)}
        assert {r.doc_id: r.edited_sha256 for r in got} == want
    else:
        # one chain through all rows: each text is followed once, by a row of its own id or the next one
        by_digest = Counter(r.edited_sha256 for r in got)
        if len(rows) <= 60:
            assert by_digest
        assert sum(by_digest.values()) == len(rows)


def test_no_bucket_holds_much_of_one_id(spark):
    rows = [(7 if k % 10 else k, f"text {k}", None, None, None) for k in range(20_000)]
    docs = table(spark, rows).selectExpr("doc_id o", "xxhash64(text) row")
    cuts = docs.selectExpr(f"percentile_approx(o, array({', '.join(str(k / 256) for k in range(257))}), 10000) c").first().c
    cells = fingerprints.id_cells(list(cuts), 0, 19_990, 1)
    counts = docs.select("o", "row", fingerprints.bucket_of(cells, docs.o, docs.row).alias("b")).collect()
    assert max(Counter(r.b for r in counts).values()) <= 1000
    assert [r.b for r in sorted(counts, key=lambda r: (r.o, r.row))] == sorted(r.b for r in counts)


def test_ids_that_repeat_or_lack_are_dealt_by_their_texts(spark):
    from pyspark.sql import functions as F

    from streamloom.llm.mixing import measured
    from streamloom.llm.ranked import buckets, unit

    rows = [(None if k % 2 else 5, f"text {k}", None, "a", None) for k in range(20_000)]
    docs = table(spark, rows)
    for keyed in (docs.select(unit("shard", "doc_id", "text").alias("u")), measured(docs).selectExpr("_unit u")):
        counts = keyed.groupBy(F.floor(F.col("u") * buckets(F.lit(20_000)))).count()
        assert counts.agg(F.max("count")).first()[0] <= 1000
