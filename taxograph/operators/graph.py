"""The category graph: edge tables built from delivered link rows."""

from __future__ import annotations

import weakref
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taxograph.functions import kind_letter
from taxograph.operators.ranking import ranked
from taxograph.workspace import Workspace


@dataclass
class CategoryGraph:
    """``subcats(parent, pos, child)``, ``files(parent, file)`` and ``categories(cat, has_block)``, all as delivered.

    ``limit`` is one more than the last category id: queries drop every id from there on, inspection counts all edges.
    Repeated edges are kept. A category without a block is only known as a subcategory.
    """

    subcats: DataFrame
    files: DataFrame
    categories: DataFrame
    limit: int
    _arrays: str | None = field(default=None, repr=False, compare=False)

    @property
    def spark(self) -> SparkSession:
        return self.subcats.sparkSession

    def steps(self) -> DataFrame:
        """The subcategory edges that a query may follow: ``(parent, pos, child, enters)``; only blocks are entered."""
        blocks = self.categories.filter("has_block").select(F.col("cat").alias("child"), F.lit(True).alias("enters"))
        return self.subcats.filter(F.col("child") < self.limit).join(blocks, "child", "left").select("parent", "pos", "child", F.coalesce("enters", F.lit(False)).alias("enters"))

    def contents(self) -> DataFrame:
        """The file edges that a query may return."""
        return self.files.filter(F.col("file") < self.limit)

    def arrays(self) -> str:
        """The folder of what a query may follow and return, sorted for ``scan``; written once, deleted with the graph."""
        if self._arrays is None:
            ws = Workspace(self.spark, "arrays")
            ws.write(self.steps().repartitionByRange("parent", "pos").sortWithinPartitions("parent", "pos").select("parent", "child", "enters"), "sub-array")
            downwards = F.shiftleft(F.col("parent").cast("bigint"), 32).bitwiseOR(F.lit((1 << 32) - 1) - F.col("file"))
            ws.write(self.contents().select(downwards.alias("key")).repartitionByRange("key").sortWithinPartitions("key"), "file-array")
            ws.write(self.categories.select("cat").repartitionByRange("cat").sortWithinPartitions("cat"), "cat-array")
            ws.write(self.categories.select("cat").join(self.contents().select(F.col("file").alias("cat")), "cat", "left_semi"), "clash-array")
            self._arrays = ws.path
            weakref.finalize(self, ws.delete)
        return self._arrays


def grouped_blocks(links: DataFrame) -> DataFrame:
    """The rows of each parent's last group of adjacent rows, by ``seq``: how a dump in parent order is read strictly.

    Ordering all rows is inherent here, so rows are range-partitioned by ``seq``; only each partition's ends meet.
    """
    rows = links.withColumn("part", F.floor(F.col("seq") / (1 << 20)))
    w = Window.partitionBy("part").orderBy("seq")
    first = rows.groupBy("part").agg(F.max_by("parent", "seq").alias("last_parent")).withColumn("previous", F.lag("last_parent").over(Window.orderBy("part")))
    marked = rows.join(first.select("part", "previous"), "part").withColumn("before", F.coalesce(F.lag("parent").over(w), F.col("previous")))
    starts = marked.filter("before is null or before <> parent").groupBy("parent").agg(F.max("seq").alias("start"))
    return links.join(starts, "parent").filter("seq >= start").drop("start")


def build_graph(links: DataFrame, strict: bool = False, workspace: Workspace | None = None) -> CategoryGraph:
    """The graph of link rows ``(child, parent, type, seq)``.

    The kind is the first letter of the type, blanks and case aside: ``s`` subcategory, ``f`` file; any other type only
    makes its parent a category. Rows without a positive parent or child are left out. Subcategories keep the order of
    ``seq``. By default all rows of a parent are merged and ``limit`` follows the largest parent id; with ``strict``
    only the last group of adjacent rows of a parent counts, and ``limit`` follows the last parent, as when a dump is read
    in one pass. An empty table gives an empty graph with limit 1.
    """
    spark = links.sparkSession
    ws = workspace or Workspace(spark, "graph")
    rows = links.select(F.col("child").cast("int").alias("child"), F.col("parent").cast("int").alias("parent"), kind_letter(F.col("type")).alias("kind"), "seq").filter("parent > 0 and child > 0")
    if strict:
        rows = grouped_blocks(rows)
    rows = ws.write(rows, "rows")
    last = rows.agg(F.max_by("parent", "seq") if strict else F.max("parent")).first()[0]
    placed = ranked(ws, rows.filter("kind = 's'").select("parent", "seq", "child"), ["parent"], [F.col("seq"), F.col("child")], "placed", "pos")
    subcats = placed.select("parent", F.col("pos").cast("int").alias("pos"), "child")
    files = rows.filter("kind = 'f'").select("parent", F.col("child").alias("file"))
    blocks = rows.select(F.col("parent").alias("cat"), F.lit(True).alias("has_block"))
    known = rows.filter("kind = 's'").select(F.col("child").alias("cat"), F.lit(False).alias("has_block"))
    categories = blocks.union(known).groupBy("cat").agg(F.bool_or("has_block").alias("has_block"))
    return CategoryGraph(ws.write(subcats, "subcats"), ws.write(files, "files"), ws.write(categories, "categories"), (last or 0) + 1)


def violations(graph: CategoryGraph) -> DataFrame:
    """``(rule, n)``: edges against each rule of a sound graph. Subcategories are categories by construction."""
    as_file = graph.files.join(graph.categories.select(F.col("cat").alias("file")), "file", "left_semi")
    unknown = graph.subcats.join(graph.categories.select(F.col("cat").alias("child")), "child", "left_anti")
    beyond = graph.files.filter(F.col("file") >= graph.limit)
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n") for rule, df in (("file is a category", as_file), ("subcategory is no category", unknown), ("file beyond the last category", beyond))]
    return counts[0].union(counts[1]).union(counts[2])


def check_graph(graph: CategoryGraph) -> CategoryGraph:
    """The graph, if no file is a category and every subcategory is one; otherwise an error."""
    bad = {r["rule"]: r["n"] for r in violations(graph).collect() if r["n"] and not r["rule"].startswith("file beyond")}
    if bad:
        raise ValueError(f"unsound graph: {bad}")
    return graph


def categories_among(graph: CategoryGraph, ids: DataFrame) -> DataFrame:
    """The rows of ``ids`` (column ``id``) that are categories a query can meet."""
    return ids.join(graph.categories.filter(F.col("cat") < graph.limit).select(F.col("cat").alias("id")), "id", "left_semi")


def files_among(graph: CategoryGraph, ids: DataFrame) -> DataFrame:
    """The rows of ``ids`` that are within the id range and no category: files, and ids that nothing is known of."""
    inside = ids.filter((F.col("id") >= 0) & (F.col("id") < graph.limit))
    return inside.join(graph.categories.select(F.col("cat").alias("id")), "id", "left_anti")
