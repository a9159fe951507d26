"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.llm.ranked import buckets, group_key, of_sources, running, unit
from streamloom.storage import Workspace
from streamloom.llm.words import char_count, words

#: Weights of the sources in order, repeating, and the times that a source is taken at most.
WEIGHTS, MOST_EPOCHS = (1, 2, 3), 3
ADDED = ["size", "source_size", "target", "taken", "times", "_source", "_unit", "_quality", "_id", "_key", "_bucket", "_prior", "_epochs", "_sum", "_before", "_run", "_before_run", "_n"]


def measured(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """documents with what the mix needs of each: size in words, source, a number in (0, 1) and a quality.

    The quality is 0.5 to 1: more for a larger share of letters in the words.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    letters = F.length(F.regexp_replace(body, r"\P{L}+", ""))
    rows = documents.withColumn("_words", words(F.col(text_col)))
    share = letters / F.nullif(char_count(F.col("_words")), F.lit(0))
    added = {"size": F.size("_words").cast("long"), "_quality": 0.5 + 0.5 * F.coalesce(share, F.lit(0.0)), "_source": group_key(source_col), "_unit": unit(seed, id_col, text_col), "_id": F.col(id_col)}
    return rows.withColumns(added).drop("_words")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """sizes with target, for rows of (_source, source_size) and whatever else, one a source.

    All sizes are shared by weight. A target stops at most times its source's
    size; what is over goes to the others by weight, until none is above: the
    sources that stop are the first ones by size per weight, so that running
    sums over that order give the share of the others. One row a source goes
    through one task.
    """
    weight = F.get(F.array(*(F.lit(w) for w in weights)), (F.row_number().over(Window.orderBy("_source")) - 1) % len(weights))
    rows = sizes.withColumn("_weight", weight.cast("long"))
    every = Window.partitionBy()
    ordered = Window.orderBy(F.col("source_size") / F.col("_weight"), "_source").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "_left": F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(ordered), F.lit(0)),
            "_open": F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(ordered), F.lit(0)),
        }
    )
    # the first source that its share does not fill ends the run of those that stop
    share = (F.col("_left") * F.col("_weight")).cast("double") / F.col("_open")
    stops = F.col("_left") * F.col("_weight") > most * F.col("source_size") * F.col("_open")
    rows = rows.withColumn("_first", F.min_by(F.when(~stops, F.struct("_left", "_open")), F.when(~stops, F.struct(F.col("source_size") / F.col("_weight"), "_source"))).over(every))
    ended = F.col("_first").isNotNull() & (F.struct("_open", "_left") <= F.struct("_first._open", "_first._left"))
    fair = (F.col("_first._left") * F.col("_weight")).cast("double") / F.col("_first._open")
    return rows.select(*sizes.columns, F.when(ended, fair).otherwise((most * F.col("source_size")).cast("double")).alias("target"))


def place(key: Column, parts: Column) -> Column:
    """The part of 0 to parts - 1 that a key falls into, rising with it.

    exp(-key / 2) is u ** (1 / 2q) for u uniform in (0, 1) and a quality q of
    0.5 to 1: its density is 2 at most, so no part is meant to hold more than
    twice its share of a source, whatever the qualities.
    """
    return F.least(parts - 1, F.floor((1 - F.exp(-key / 2)) * parts))


def mix_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = True) -> DataFrame:
    """documents with size, source_size, target, taken and times.

    Each source is taken whole as often as its target holds its size. For the
    rest its documents stand in the order of -ln(u) / quality, u in (0, 1) by a
    seeded hash of id and text, and those stay whose sizes sum up to the rest; the
    document that the rest ends in stays if that comes nearer to it. times is
    how often a document is taken, taken = times * size.

    Texts are measured once, into a table of the workspace; without carry it
    holds the id and source columns alone, and the result has these.

    Sizes are words. A null text has none, a null source is one of its own,
    last in order, a null id counts as an empty one. A very long text counts
    whole, so a source may miss its target by half of its longest. Rows equal in
    key, id and size may change places. An empty table gives no rows; columns of
    documents that are named like added ones are replaced.
    """
    documents = documents.drop(*ADDED)
    rows = measured(documents, id_col, text_col, source_col, seed)
    if not carry:
        rows = rows.select(id_col, source_col, "size", "_quality", "_source", "_unit", "_id")
    rows = Workspace(documents.sparkSession, "mix").table(rows, "measured")
    sizes = rows.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    rows = rows.join(of_sources(source_targets(sizes, weights, most)), "_source").withColumn("_key", -F.ln("_unit") / F.col("_quality"))
    rows = rows.withColumn("_bucket", place(F.col("_key"), buckets(F.col("_n"))))
    placed = running(rows, ["_source"], "_bucket", ["_key", "_id", "size"], F.col("size"), "_prior")
    epochs = F.least(F.lit(most), F.floor(F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0)))).cast("long")
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    placed = placed.withColumn("_epochs", epochs)
    extra = (2 * F.col("_prior") + F.col("size") <= 2 * rest) & (F.col("_epochs") < most)
    out = placed.withColumn("times", F.col("_epochs") + F.when(extra, 1).otherwise(0)).withColumn("taken", F.col("times") * F.col("size"))
    return out.drop("_source", "_unit", "_quality", "_id", "_key", "_bucket", "_prior", "_epochs", "_n")
