"""What a request can ask for: list, and, not, fqv and path, with page windows and size estimates.

Requests are answered together: equal searches run once, and equal combinations of them once; the pages are cut last.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograph.operators import scan
from taxograph.operators.graph import CategoryGraph
from taxograph.workspace import Workspace

REQUEST = "req_id bigint, a string, c1 int, c2 int, d1 int, d2 int, o int, s int"
#: Requests of a task, as long as there are few tasks.
REQUESTS = 500


@dataclass
class Answers:
    """``rows(req_id, n, id, depth, tag, kind)`` by page position n, ``totals(req_id, outof)`` (null: no estimate) and
    ``rejected(req_id, reason)``. A path that was not found has a total row with ``found`` false."""

    rows: DataFrame
    totals: DataFrame
    rejected: DataFrame
    graph: CategoryGraph  # whose arrays the rows and totals are read from


def defaults(requests: DataFrame) -> DataFrame:
    """Requests with the defaults of parameters that were not given: c2 = c1, no depth bound, page 0 of 100, ``and``."""
    r = requests
    bound = lambda c: F.when(F.col(c).isNull() | (F.col(c) < 0), -1).otherwise(F.col(c)).cast("int").alias(c)
    return r.select(F.col("req_id").cast("bigint").alias("req_id"), F.coalesce(F.lower(F.trim("a")), F.lit("and")).alias("a"), F.col("c1").cast("int").alias("c1"), F.coalesce("c2", "c1").cast("int").alias("c2"), bound("d1"), bound("d2"), F.coalesce("o", F.lit(0)).cast("int").alias("o"), F.coalesce("s", F.lit(100)).cast("int").alias("s"))


def validated(graph: CategoryGraph, requests: DataFrame) -> DataFrame:
    """Requests (with defaults) and the ``reason`` of their rejection, null for those that are answered."""
    cats = graph.categories.filter(F.col("cat") < graph.limit).select("cat")
    marked = requests.join(cats.select(F.col("cat").alias("c1"), F.lit(True).alias("is1")), "c1", "left").join(cats.select(F.col("cat").alias("c2"), F.lit(True).alias("is2")), "c2", "left")
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < graph.limit)
    reason = (
        F.when(F.col("c1").isNull(), "no c1")
        .when(~F.col("a").isin("and", "not", "list", "fqv", "path"), "unknown action")
        .when((F.col("a") == "path") & (F.col("c1") == F.col("c2")), "path to itself")
        .when(~inside("c1") | ~inside("c2"), "id out of range")
        .when(F.col("is1").isNull() | (F.col("is2").isNull() & (F.col("a") != "path")), "no category")
    )
    return marked.select("req_id", "a", "c1", "c2", "d1", "d2", "o", "s", reason.alias("reason"))


def good_tags(ws: Workspace, graph: CategoryGraph, seeds: DataFrame) -> DataFrame:
    """``(id, tag, good_depth)`` of all that lies below the seeds ``(prio, cat_id, depth, tag)``; the smallest prio wins.

    Seeds that are no category have nothing below them.
    """
    bound = F.when(F.col("depth") < 0, -1).otherwise(F.col("depth"))
    of = seeds.select(F.col("prio").cast("int").alias("prio"), F.col("cat_id").cast("int").alias("cat"), bound.cast("int").alias("bound"), F.col("tag").cast("int").alias("tag"))
    of = of.join(graph.categories.filter(F.col("cat") < graph.limit).select("cat"), "cat", "left_semi").select("prio", "cat", "bound", "tag")
    seen = of.repartition(_tasks(ws, of, 1), "prio", "cat").mapInArrow(scan.seen_rows(graph.arrays()), scan.SEEN)
    best = F.min(F.struct("prio", "tag", "depth2")).alias("x")
    return ws.write(seen.groupBy("id").agg(best).select("id", "x.tag", F.col("x.depth2").alias("good_depth")), "tags")


def _tasks(ws: Workspace, rows: DataFrame, each: int) -> int:
    """Tasks for so many rows each, but at most four times the shuffle partitions."""
    return min(1 + rows.count() // each, 4 * int(ws.spark.conf.get("spark.sql.shuffle.partitions")))


def answer(graph: CategoryGraph, requests: DataFrame, tags: DataFrame, frontier_rows: bool = True, workspace: Workspace | None = None, progress: Callable[[int, int], None] | None = None) -> Answers:
    """Answer all requests ``(req_id, a, c1, c2, d1, d2, o, s)``; ``tags`` as of ``good_tags``. Nulls take the defaults.

    A page has the rows from o + 1 to o + s. For and, not and fqv a page of size 0 still ends only after a row, and the
    total is the number of rows after the offset if the scan came to its end, else an estimate from how far it came.
    ``progress``, for a single request, is called with the sizes of both listings as soon as they are known.
    """
    ws = workspace or Workspace(graph.spark, "answers")
    checked = ws.write(validated(graph, defaults(requests)), "requests")
    ws.write(tags.select("id", F.col("tag").cast("int").alias("tag"), F.col("good_depth").cast("int").alias("good_depth")), "tag-array")
    accepted = checked.filter("reason is null").select("req_id", "a", "c1", "c2", "d1", "d2", "o", "s")
    same = ["c1", "c2", "a", "d1", "d2"]  # what comes together shares searches, scans and hits; a popular combination may be split
    spread = accepted.repartitionByRange(_tasks(ws, accepted, REQUESTS), *same, "req_id").sortWithinPartitions(*same)
    given = (graph.arrays(), f"{ws.path}/tag-array", frontier_rows)
    rows = spread.mapInArrow(scan.page_rows(*given), scan.ROWS)
    rows = rows.select("req_id", "n", "id", "depth", "tag", F.when(F.col("category"), "category").otherwise("file").alias("kind"))
    totals = spread.mapInArrow(scan.page_sizes(*given), scan.TOTALS)
    if progress:
        totals = ws.write(totals, "totals")
        for r in totals.join(accepted.filter("a <> 'path'"), "req_id", "left_semi").limit(1).collect():
            progress(r["first"], r["second"])
    return Answers(rows, totals.select("req_id", "outof", "found"), checked.filter("reason is not null").select("req_id", "reason"), graph)
