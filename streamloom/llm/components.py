"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.storage import Workspace


def components(links: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """(node, label) for each node of links(a, b): the smallest node reachable.

    Each round points every node to the smallest one beside it, follows these
    pointers to their ends by doubling, then contracts the links to the ends; a
    round leaves at most half of the nodes, and only columns of two ids move.
    No round gathers a node's neighbours: minimum and distinct combine before
    the shuffle. A loop or a null counts as no link, and without links the
    result is empty.
    """
    edges = links.where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct()
    edges = ws.table(edges, f"{name}-edges0")
    steps, k = [], 0
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        step = ws.table(both.groupBy("node").agg(F.least("node", F.min("other")).alias("to")), f"{name}-step{k}-0")
        step = _followed(step, ws, f"{name}-step{k}")
        steps.append(step)
        a = step.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        b = step.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(a, "a").join(b, "b").where("to_a <> to_b")
        k += 1
        edges = ws.table(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), f"{name}-edges{k}")
        ws.drop(f"{name}-edges{k - 1}")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = steps.pop().select("node", F.col("to").alias("label"))
    while steps:
        later = out.select(F.col("node").alias("to"), F.col("label"))
        out = steps.pop().join(later, "to", "left").select("node", F.coalesce("label", "to").alias("label"))
    return ws.table(out, f"{name}-labels")


def _followed(step: DataFrame, ws: Workspace, name: str) -> DataFrame:
    """step(node, to) with each pointer moved to the end of its path."""
    k = 0
    while True:
        ahead = step.select(F.col("node").alias("to"), F.col("to").alias("end"))
        k += 1
        jumped = ws.table(step.join(ahead, "to").select("node", F.col("end").alias("to"), (F.col("end") < F.col("to")).alias("moved")), f"{name}-{k}")
        step = jumped.select("node", "to")
        if jumped.where("moved").isEmpty():
            return step
        ws.drop(f"{name}-{k - 1}")
