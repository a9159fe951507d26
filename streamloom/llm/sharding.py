"""Proportional stratified interleaving of sources into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.llm.ranked import buckets, group_key, of_sources, running, unit

SHARDS = 40
ADDED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard", "_source", "_key", "_id", "_bucket", "_rank", "_n", "_at", "_place", "_sum", "_before", "_run", "_before_run"]


def shard_documents(documents: DataFrame, shards: int = SHARDS, seed: str = "shard", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """documents with size, text_crc32, law, shard, slot and grown_shard.

    Law `rows`: counts of shards differ by one at most. Rows of each source are
    shuffled by a seeded hash of their id and text and ranked; row r of n lies at
    (r - u) / n, where u in (0, 1) is the source's own, so that many small
    sources do not meet at one place. All rows in that order are cut into equal
    runs, so a stretch of any shard holds the mixture of the whole. Equal texts
    go where their ids put them.

    size is the text's UTF-8 bytes plus 16, text_crc32 that of its UTF-8; a null
    text is empty for both. A null source is one of its own, a null id an empty
    one. Rows equal in id, size and text_crc32 may change places. An empty table
    gives no rows; columns of documents that are named like added ones are
    replaced.
    """
    documents = documents.drop(*ADDED)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = documents.withColumns(
        {
            "size": (F.octet_length(text) + 16).cast("long"),
            "text_crc32": F.crc32(text.cast("binary")),
            "_source": group_key(source_col),
            "_key": unit(seed, id_col, text_col),
            "_id": F.col(id_col),
        }
    )
    counts = rows.groupBy("_source").agg(F.count("*").alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()

    rows = rows.join(of_sources(counts), "_source")
    rows = rows.withColumn("_bucket", F.floor(F.col("_key") * buckets(F.col("_n"))))
    order = ["_key", "_id", "text_crc32", "size"]
    ranked = running(rows, ["_source"], "_bucket", order, F.lit(1), "_rank")
    at = (F.col("_rank") + 1 - unit(seed, "_source")) / F.col("_n")
    placed = ranked.withColumn("_at", at).withColumn("_bucket", F.floor(F.col("_at") * buckets(F.lit(total.n))))
    placed = running(placed, [], "_bucket", ["_at", "_source", *order], F.lit(1), "_place")

    # exact in longs: the first place of a shard is the least p with p * shards >= shard * n
    shard = F.floor(F.expr(f"(_place * {shards}L) div {max(total.n, 1)}L")).cast("int")
    first = F.expr(f"(shard * {max(total.n, 1)}L + {shards - 1}L) div {shards}L")
    out = placed.withColumns({"law": F.lit("rows"), "shard": shard}).withColumn("slot", F.col("_place") - first)
    return out.withColumn("grown_shard", F.lit(None).cast("int")).drop("_source", "_key", "_id", "_bucket", "_rank", "_n", "_at", "_place")
