"""Iterated joins: subtree sums by pointer doubling and connected components by label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InternalError
from ..functions.storage import discard, settled


def subtree_sizes(edges: DataFrame, limit: int) -> DataFrame:
    """(grid_id, node, total) of a forest (grid_id, node, next; next null at roots): the nodes above each, itself included.

    Pointer doubling: after k rounds a total counts the nodes above at less than 2^k steps, so the depth's logarithm is
    the number of rounds. limit: nodes of the largest grid; pointers that outlive its logarithm are a cycle.
    """
    state = table = settled(edges.select("grid_id", "node", "next", F.lit(1).cast("long").alias("total")))
    for _ in range(max(1, limit.bit_length()) + 1):
        if state.where(F.col("next").isNotNull()).isEmpty():
            return state.select("grid_id", "node", "total")
        came = state.where(F.col("next").isNotNull()).groupBy("grid_id", F.col("next").alias("node")).agg(F.sum("total").alias("came"))
        hop = state.select("grid_id", F.col("node").alias("next"), F.col("next").alias("after"))
        state = state.join(came, ["grid_id", "node"], "left").join(hop, ["grid_id", "next"], "left")
        last, state = table, settled(state.select("grid_id", "node", F.col("after").alias("next"), (F.col("total") + F.coalesce("came", F.lit(0))).alias("total")))
        discard(last)
        table = state
    if state.where(F.col("next").isNotNull()).isEmpty():
        return state.select("grid_id", "node", "total")
    raise InternalError("flow accumulation: cycle_detected")


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (grid_id, node) with label, the smallest node of their component; edges (grid_id, a, b) in both directions.

    Each round takes the smallest label among the neighbours, then that label's own label, so a round at least doubles
    how far labels travel along a path of pointers; labels settle in the shared folder between rounds. Joins are merged:
    files of labels are far smaller than their rows, which a broadcast would send through the driver.
    """
    state = table = settled(nodes.select("grid_id", "node", F.col("node").alias("label")))
    edges = settled(edges.select("grid_id", "a", "b"))
    while True:
        seen = edges.join(state.select("grid_id", F.col("node").alias("b"), F.col("label").alias("l")).hint("merge"), ["grid_id", "b"]).groupBy("grid_id", F.col("a").alias("node")).agg(F.min("l").alias("seen"))
        least = state.join(seen.hint("merge"), ["grid_id", "node"], "left").select("grid_id", "node", "label", F.least("label", F.coalesce("seen", "label")).alias("low"))
        offers = least.where("low < label").groupBy("grid_id", F.col("label").alias("node")).agg(F.min("low").alias("offer"))
        least = settled(least.join(offers.hint("merge"), ["grid_id", "node"], "left").select("grid_id", "node", F.col("label").alias("was"), F.least("low", F.coalesce("offer", "low")).alias("low")))
        hop = least.select("grid_id", F.col("node").alias("low"), F.col("low").alias("hop"))
        after = settled(least.join(hop.hint("merge"), ["grid_id", "low"], "left").select("grid_id", "node", "was", F.least("low", F.coalesce("hop", "low")).alias("label")))
        state = after.select("grid_id", "node", "label")
        discard(table, least)
        table = after
        if after.where("label <> was").isEmpty():
            discard(edges)
            return state
