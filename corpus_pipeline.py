"""A training corpus from raw documents, in stages that each call one operator.

A stage takes the rows that the one before it kept and returns the columns of
documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.langid import NONE, identify_languages
from streamloom.llm.mixing import mix_documents
from streamloom.llm.near_dup import kept_documents
from streamloom.llm.packing import pack_documents
from streamloom.llm.quality import judge
from streamloom.session import prepared
from streamloom.storage import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents of whose words the likeliest languages have lower odds, on average, go.
LEAST_CERTAINTY = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or a quality rule rejects go.

    Null, empty and short texts fail the base; equal rows get equal verdicts.
    """
    prepared(spark)
    return judge(docs.select(COLUMNS)).where("kept").select(COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are in no language of sufficient odds go.

    Code-switched texts stay: each word counts by its own likeliest language. A
    text that is null or without letters goes; where there is nothing to learn
    from, no document can be told and all with letters stay.
    """
    prepared(spark)
    found = identify_languages(docs, carry=tuple(COLUMNS[1:]))
    unknown = (F.col("lang_pred") == NONE) & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return found.where(unknown | (F.col("lang_pred") != NONE) & (F.col("certainty") >= LEAST_CERTAINTY)).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    Rows without an id are documents of their own, those equal in id and text
    one; a text without words is like no other.
    """
    prepared(spark)
    return kept_documents(docs.select(COLUMNS)).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its source's target takes it, not at all if never.

    A null source is one of its own; texts without words add nothing to it.
    """
    prepared(spark)
    mixed = mix_documents(docs.select(COLUMNS)).where("times > 0")
    return mixed.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; each row, repeated or not, is packed by itself."""
    prepared(spark)
    return pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("language id", language_id), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]
#: Near-duplicate groups, language models and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's rows are written and read again by the next.

    An empty table passes through all of them; columns of documents other than
    COLUMNS are not read.
    """
    docs, ws = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = ws.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            ws.drop(f"stage{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
