"""Breadth-first listings below many roots at once, without an order: one job takes all of them several levels further."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograph.functions import saturated_depth
from taxograph.operators.graph import CategoryGraph
from taxograph.operators.hierarchy import level_search
from taxograph.workspace import Workspace


def file_depths(ws: Workspace, graph: CategoryGraph, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files below each start ``(root, bound)`` and what its search has seen, without an order.

    ``starts`` has ``(root, bound)``; ``bound`` < 0 is no bound. Files: ``(root, bound, id, depth)``, where they are first met. Seen:
    ``(root, bound, id, depth2)``, with depth 0 for every entered category and at most 254. A root that is no category has neither.
    """
    known = graph.categories.filter(F.col("cat") < graph.limit).select(F.col("cat").alias("root"))
    bounds = ws.write(starts.select("root", F.when(F.col("bound") < 0, -1).otherwise(F.col("bound")).cast("int").alias("bound")).distinct().join(known, "root", "left_semi"), "depth-bounds")
    steps = ws.write(graph.steps().filter("enters").select("parent", "child").distinct(), "depth-steps")
    reach = ws.write(bounds.groupBy("root").agg(F.when(F.min("bound") < 0, -1).otherwise(F.max("bound")).alias("reach")), "reach-of")
    met = level_search(ws, steps, reach.select(F.col("root").alias("node"), "root", "reach"), label="met")
    found = ws.write(met.join(graph.contents(), F.col("node") == F.col("parent")).groupBy("root", "file").agg(F.min("depth").alias("depth")).select("root", F.col("file").alias("id"), "depth"), "found")
    inside = (F.col("bound") < 0) | (F.col("depth") <= F.col("bound"))
    rows = found.join(bounds, "root").filter(inside).select("root", "bound", "id", "depth")
    entered = met.select("root", F.col("node").alias("id"), "depth").join(bounds, "root").filter(inside).select("root", "bound", "id", F.lit(0).alias("depth2"))
    seen = entered.unionByName(rows.select("root", "bound", "id", saturated_depth(F.col("depth")).alias("depth2")))
    return rows, seen.groupBy("root", "bound", "id").agg(F.min("depth2").alias("depth2"))
