"""A timeline kept with postings of its trigrams, so that a search reads few of its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from streamloom.operators import search

#: Segments that a block has on average, which has a folder of its own, and folders that the postings are dealt to.
BLOCK_ROWS, FOLDERS = 10_000, 64
#: Blocks that a search reads by name; more of them are joined.
BY_NAME = 1_000
#: Each searched text by its name.
FIELDS = {"character": "ocr.character", "dialogue": "ocr.dialogue", "speech": "asr.text", "chapter": "ocr.chapter"}
_END = "\u0001"


def _trigrams(text: Column) -> Column:
    """The different runs of three characters of a text between two end marks on each side, so that shorter words lie in one, too."""
    whole = F.concat(F.lit(_END * 2), text, F.lit(_END * 2))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(whole) - 2), lambda k: F.substring(whole, k, F.lit(3))))


def _folder(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(FOLDERS)).cast("int")


def write_index(timeline: DataFrame, path: str) -> None:
    """Writes the timeline by blocks of neighbouring segments, and which blocks hold which trigram of which field.

    Up to BLOCK_ROWS neighbouring segments of a video stay together. There are
    as many blocks as the segments fill, so short videos share one and their
    number grows with the segments, not the videos. Of each trigram a block has
    one posting, so its frequent trigrams are one row each. The timeline is read
    twice: write it first.
    """
    blocks = -(-timeline.count() // BLOCK_ROWS) or 1
    part = F.pmod(F.xxhash64("video_id", F.floor(F.col("seg_ord") / BLOCK_ROWS)), F.lit(blocks))
    rows = timeline.withColumn("block", F.concat(F.lit("b"), part.cast("string")))
    rows.repartition(blocks, "block").sortWithinPartitions("block", "video_id", "seg_ord").write.partitionBy("block").parquet(f"{path}/timeline")
    # a schema's add() would change the one that timeline holds, and with it timeline's columns
    rows = timeline.sparkSession.read.schema(StructType([*timeline.schema.fields, StructField("block", StringType())])).parquet(f"{path}/timeline")
    grams = F.array(*(F.struct(F.lit(name).alias("field"), _trigrams(F.col(c)).alias("grams")) for name, c in FIELDS.items()))
    postings = rows.select("block", F.inline(F.filter(grams, lambda x: x["grams"].isNotNull()))).select("block", "field", F.explode("grams").alias("trigram")).distinct()
    postings.withColumn("folder", _folder(F.col("trigram"))).repartition("folder").sortWithinPartitions("folder", "field", "trigram").write.partitionBy("folder").parquet(f"{path}/postings")


class TimelineIndex:
    """Searches of a timeline that write_index wrote; each gives the rows that the scan of all of it does."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark = spark
        self.timeline = spark.read.schema(f"{schema}, block string").parquet(f"{path}/timeline")
        self.postings = spark.read.schema("block string, field string, trigram string, folder int").parquet(f"{path}/postings")

    def blocks(self, fields: list[str], word: str) -> DataFrame:
        """(block) that may hold a word in one of the fields: those with all of its trigrams, or with one that a short word lies in."""
        own = self.postings.where(F.col("field").isin(fields))
        if len(word) < 3:
            return own.where(F.contains("trigram", F.lit(word))).select("block").distinct()
        grams = sorted({word[k : k + 3] for k in range(len(word) - 2)})
        folders = [r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "g string").select(_folder(F.col("g"))).distinct().collect()]
        hits = own.where(F.col("folder").isin(folders) & F.col("trigram").isin(grams))
        return hits.groupBy("block", "field").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("block").distinct()

    def candidates(self, fields: list[str], word: str) -> DataFrame:
        """The segments of these blocks."""
        found = self.blocks(fields, word)
        names = [r.block for r in found.limit(BY_NAME + 1).collect()]
        rows = self.timeline.where(F.col("block").isin(names)) if len(names) <= BY_NAME else self.timeline.join(found, "block", "left_semi")
        return rows.drop("block")

    def by_character(self, name: str) -> DataFrame:
        """R1"""
        return search.by_character(self.candidates(["character"], name), name)

    def by_keyword(self, word: str) -> DataFrame:
        """R2"""
        return search.by_keyword(self.candidates(["dialogue", "speech"], word), word)

    def by_chapter(self, name: str) -> DataFrame:
        """R5"""
        return search.by_chapter(self.candidates(["chapter"], name), name)
