"""Commands: build, extract, serve, inspect.

    python -m taxograph build DUMP FOLDER [--strict]
    python -m taxograph extract PAGE LINKS FOLDER [--start N] [--end N] [--jdbc URL] [--dry-run]
    python -m taxograph serve FOLDER SEEDS [--port N]
    python -m taxograph inspect FOLDER TOOL [ID ...]

PAGE, LINKS and SEEDS are Parquet tables (PAGE and LINKS are table names with --jdbc). Spark is configured by spark-submit or its defaults.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxograph.operators import inspect as I
from taxograph.operators.graph import CategoryGraph, build_graph
from taxograph.sources import links as L
from taxograph.sources.snapshots import read_snapshot, write_snapshot

TOOLS: dict[str, Callable[[CategoryGraph, list[int]], DataFrame]] = {
    "totals": lambda g, _: I.totals(g),
    "degrees": lambda g, _: I.degrees(g),
    "search": lambda g, ids: I.with_degrees(g, *ids),
    "subcats": lambda g, ids: I.subcats_of(g, *ids).orderBy("parent", "pos"),
    "files": lambda g, ids: I.files_of(g, *ids).orderBy("parent", "pos"),
    "diamonds": lambda g, _: I.diamonds(g),
    "walks": lambda g, _: I.walk_counts(g).orderBy("d"),
    "components": lambda g, _: I.component_lines(g).orderBy("ord"),
    "loops": lambda g, _: I.loops(g).orderBy("ord"),
    "path": lambda g, ids: I.first_path(g, *ids).orderBy("pos"),
    "depths": lambda g, _: I.depth_histogram(g).orderBy("depth"),
    "deepest": lambda g, _: I.deepest_chains(g),
    "union": lambda g, ids: I.union_counts(g, g.spark.createDataFrame([(i,) for i in ids], "root int")),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="taxograph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build")
    build.add_argument("dump")
    build.add_argument("folder")
    build.add_argument("--strict", action="store_true")
    extract = sub.add_parser("extract")
    for name in ("page", "links", "folder"):
        extract.add_argument(name)
    extract.add_argument("--start", type=int, default=0)
    extract.add_argument("--end", type=int)
    extract.add_argument("--batch", type=int, default=L.BATCH_IDS)
    extract.add_argument("--jdbc")
    extract.add_argument("--dry-run", action="store_true")
    serve = sub.add_parser("serve")
    serve.add_argument("folder")
    serve.add_argument("seeds")
    serve.add_argument("--host", default="127.0.0.1")
    serve.add_argument("--port", type=int, default=8080)
    inspect = sub.add_parser("inspect")
    inspect.add_argument("folder")
    inspect.add_argument("tool", choices=sorted(TOOLS))
    inspect.add_argument("ids", nargs="*", type=int)
    return p


def main(args: list[str], spark: SparkSession | None = None) -> int:
    o = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("taxograph").getOrCreate()
    if o.command == "build":
        print(write_snapshot(build_graph(L.read_dump(spark, o.dump), strict=o.strict), o.folder))
    elif o.command == "extract":
        if o.jdbc:
            page = L.read_jdbc(spark, o.jdbc, o.page, o.start, o.end, o.batch, dry_run=o.dry_run)
            if o.dry_run:
                print(page)
                return 0
            links = spark.read.format("jdbc").options(url=o.jdbc, dbtable=o.links, fetchsize=str(L.FETCH_ROWS)).load()
        else:
            page, links = spark.read.parquet(o.page), spark.read.parquet(o.links)
        if o.dry_run:
            end = o.end if o.end is not None else L.largest_page_id(page).first()[0] + 1
            print(*(f"{a} {b}" for a, b in L.id_ranges(o.start, end, o.batch)), sep="\n")
            return 0
        print(write_snapshot(build_graph(L.extracted(page, links, o.start, o.end)), o.folder))
    elif o.command == "serve":
        from taxograph.plans.engine import Engine
        from taxograph.plans.http import server

        web = server(Engine(spark, o.folder, spark.read.parquet(o.seeds)), o.host, o.port)
        print(f"http://{o.host}:{web.server_address[1]}", flush=True)
        web.serve_forever()
    else:
        df = TOOLS[o.tool](read_snapshot(spark, o.folder)[0], o.ids)
        print(*df.columns, sep="\t")
        for row in df.select(*(F.col(c).cast("string") for c in df.columns)).toLocalIterator():
            print(*("" if x is None else x for x in row), sep="\t")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
