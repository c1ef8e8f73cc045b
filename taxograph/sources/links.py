"""Link rows from text dumps and from page and link tables."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATEGORY_NAMESPACE = 14
BATCH_IDS = 100_000
FETCH_ROWS = 10_000


def read_dump(spark: SparkSession, path: str, fail: bool = True) -> DataFrame:
    """``(child, parent, type, seq)`` of whitespace-separated lines ``child parent type``; empty lines are left out.

    ``seq`` follows the order of lines within a file and of files by name. A line of another form is an error, or left
    out with ``fail=False``.
    """
    form = r"^\s*(-?\d+)\s+(-?\d+)\s+(\S+)"
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    splits = read.select("file", "start").distinct().withColumn("split", F.row_number().over(Window.orderBy("file", "start")).cast("bigint"))  # a row for each split
    seq = F.shiftleft("split", 33) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    lines = read.filter("trim(value) <> ''").join(splits, ["file", "start"]).select("value", seq.alias("seq"))
    good = F.col("value").rlike(form)
    part = lambda k: F.regexp_extract("value", form, k)
    rows = lines.select(F.when(good, part(1)).cast("int").alias("child"), F.when(good, part(2)).cast("int").alias("parent"), F.when(good, part(3)).otherwise(F.raise_error(F.concat(F.lit("malformed line: "), "value")) if fail else F.lit(None)).alias("type"), "seq")
    return rows if fail else rows.filter("type is not null")


def delivered_links(links: DataFrame) -> DataFrame:
    """``(child, parent, type, seq)`` of a delivered links table ``(cl_from, page_id, cl_type, seq)``."""
    return links.select(F.col("cl_from").alias("child"), F.col("page_id").alias("parent"), F.col("cl_type").alias("type"), "seq")


def titled_links(page: DataFrame, links: DataFrame, kinds: tuple[str, ...] = ("subcat", "file")) -> DataFrame:
    """``(child, parent, type)`` by joining the categories of ``page`` with links that name them, ``cl_to = page_title``.

    Bytes are read as UTF-8. Pages without a title, links to no category and links of other kinds have no row.
    """
    text = lambda df, c: F.decode(F.col(c), "UTF-8") if dict(df.dtypes)[c] == "binary" else F.col(c)
    cats = page.filter(F.col("page_namespace") == CATEGORY_NAMESPACE).select(F.col("page_id").alias("parent"), text(page, "page_title").alias("title"))
    named = links.select(F.col("cl_from").alias("child"), text(links, "cl_to").alias("title"), text(links, "cl_type").alias("type")).filter(F.col("type").isin(*kinds))
    return named.join(cats, "title").select("child", "parent", "type")


def extracted(page: DataFrame, links: DataFrame, start: int = 0, end: int | None = None, kinds: tuple[str, ...] = ("subcat", "file")) -> DataFrame:
    """``(child, parent, type, seq)`` of ``titled_links`` below the categories with a page id in [start, end), in order of
    parent and child: what ``build_graph`` takes. The window is a filter on the page id, which a database source takes over."""
    within = page.filter(F.col("page_id") >= start) if end is None else page.filter((F.col("page_id") >= start) & (F.col("page_id") < end))
    return titled_links(within, links, kinds).orderBy("parent", "child", "type").withColumn("seq", F.monotonically_increasing_id())


def largest_page_id(page: DataFrame) -> DataFrame:
    """``(max_page_id)``, 0 for an empty table."""
    return page.agg(F.coalesce(F.max("page_id"), F.lit(0)).alias("max_page_id"))


def id_ranges(start: int, end: int, batch: int = BATCH_IDS) -> Iterator[tuple[int, int]]:
    """[lo, hi) windows over [start, end)."""
    for lo in range(max(0, start), end, batch):
        yield lo, min(lo + batch, end)


def jdbc_options(url: str, table: str, start: int, end: int, batch: int = BATCH_IDS, fetch: int = FETCH_ROWS, **properties: str) -> dict[str, str]:
    """Options of a read partitioned by page id, a partition for each window of ids."""
    windows = max(1, len(list(id_ranges(start, end, batch))))
    return {"url": url, "dbtable": table, "partitionColumn": "page_id", "lowerBound": str(start), "upperBound": str(max(end, start + 1)), "numPartitions": str(windows), "fetchsize": str(fetch), **properties}


def read_jdbc(spark: SparkSession, url: str, table: str, start: int = 0, end: int | None = None, batch: int = BATCH_IDS, fetch: int = FETCH_ROWS, dry_run: bool = False, **properties: str) -> DataFrame | dict[str, str]:
    """Rows of a database table with a page id in [start, end), read in windows of ids; ``dry_run`` gives the options only."""
    if end is None:
        probe = spark.read.format("jdbc").options(url=url, query=f"select coalesce(max(page_id), 0) as m from {table}", **properties).load()
        end = int(probe.first()[0]) + 1
    options = jdbc_options(url, table, start, end, batch, fetch, **properties)
    if dry_run:
        return options
    return spark.read.format("jdbc").options(**options).load().filter((F.col("page_id") >= start) & (F.col("page_id") < end))
