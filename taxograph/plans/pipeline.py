"""Queries of the general data-pipeline operators (skewed keys, hierarchies, snapshots)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxograph.operators import hierarchy as H
from taxograph.operators.key_profile import heavy_keys, key_profiles
from taxograph.operators.snapshot_diff import snapshot_changes
from taxograph.sources import table
from taxograph.workspace import Workspace


def _links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "categorylinks")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(_links(spark, d))


def p1_profiles(spark: SparkSession, d: str) -> DataFrame:
    return key_profiles(_links(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(spark, _links(spark, d))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    out = H.hierarchy_paths(spark, _links(spark, d))
    return out.select("node_id", "root_id", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(spark, _links(spark, d))


def p3_loops(spark: SparkSession, d: str) -> DataFrame:
    ws = Workspace(spark, "loops")
    found = H.loop_components(ws, ws.write(H.subcategory_edges(_links(spark, d)), "edges"))
    return found.select(F.col("node").alias("node_id"), F.col("component").alias("loop_id"), "members")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "categorylinks_snapshot"))


def p4_summary(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("snap_no", "change").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_profiles, p3_found, p3_paths, p3_descendants, p3_loops, p4_found, p4_summary)
}

KIND = r"nullif(lower(substr(regexp_replace(cl_type, '^\s+', ''), 1, 1)), '')"
EDGES = f"edges as (select distinct page_id as parent, cl_from as child from categorylinks where cl_from > 0 and page_id > 0 and {KIND} = 's')"
PROFILES = """select 'page_id' as side, cast(page_id as bigint) as key_id, count(*) as n_rows, count(distinct case when cl_from > 0 then cl_from end) as n_partners
from categorylinks where page_id > 0 group by page_id
union all
select 'cl_from', cast(cl_from as bigint), count(*), count(distinct case when page_id > 0 then page_id end) from categorylinks where cl_from > 0 group by cl_from"""
#: Pairs of nodes of one loop; the inner recursion keeps one row for each pair.
CLOSURE = "reach(a, b) as (select parent, child from edges union select r.a, e.child from reach r join edges e on e.parent = r.b)"
LOOPS = "loops as (select f.a as node_id, least(f.a, min(f.b)) as loop_id, count(distinct f.b) as members from reach f join reach g on f.a = g.b and f.b = g.a group by f.a)"
WALK = """walk(node, root, depth) using key (node, root) as (
  select parent, parent, 0 from (select distinct parent from edges where parent not in (select child from edges)) union
  select e.child, w.root, w.depth + 1 from walk w join edges e on e.parent = w.node left join recurring.walk v on v.node = e.child and v.root = w.root where v.node is null)"""
CHANGES = rf"""with rows as (
  select snap_no, cl_from, page_id, {KIND} as kind, nullif(regexp_replace(cl_sortkey, '^\s+|\s+$', '', 'g'), '') as sk,
         row_number() over (partition by snap_no, cl_from, page_id order by delivered_at desc nulls last) as rn
  from categorylinks_snapshot where snap_no is not null and cl_from is not null and page_id is not null),
records as (select * from rows where rn = 1),
numbers as (select snap_no, lead(snap_no) over (order by snap_no) as next_no from (select distinct snap_no from categorylinks_snapshot where snap_no is not null)),
olds as (select n.next_no as snap_no, r.cl_from, r.page_id, r.kind, r.sk from records r join numbers n on n.snap_no = r.snap_no and n.next_no is not null),
news as (select * from records where snap_no > (select min(snap_no) from numbers)),
changes as (
  select coalesce(n.snap_no, o.snap_no) as snap_no, coalesce(n.cl_from, o.cl_from) as cl_from, coalesce(n.page_id, o.page_id) as page_id,
         case when o.snap_no is null then 'added' when n.snap_no is null then 'removed' when n.kind is distinct from o.kind or n.sk is distinct from o.sk then 'changed' end as change
  from news n full join olds o on n.snap_no = o.snap_no and n.cl_from = o.cl_from and n.page_id = o.page_id)
"""
SQL: dict[str, str] = {
    "p1_found": f"select side, key_id from ({PROFILES}) where n_rows * 50 >= (select count(*) from categorylinks)",
    "p1_profiles": PROFILES,
    "p3_found": f"with recursive {EDGES}, {WALK}, {CLOSURE}, {LOOPS} select node as node_id, root as root_id, depth from walk union all select node_id, loop_id, -1 from loops",
    "p3_loops": f"with recursive {EDGES}, {CLOSURE}, {LOOPS} select * from loops",
    "p3_paths": f"""with recursive {EDGES}, walk(node, root, depth, path) using key (node, root) as (
  select parent, parent, 0, [parent] from (select distinct parent from edges where parent not in (select child from edges)) union
  select e.child, w.root, min(w.depth) + 1, min(list_append(w.path, e.child)) from walk w join edges e on e.parent = w.node left join recurring.walk v on v.node = e.child and v.root = w.root where v.node is null group by e.child, w.root)
select node as node_id, root as root_id, depth, array_to_string(path, '/') as path from walk""",
    "p3_descendants": f"""with recursive {EDGES}, walk(node, root, depth) using key (node, root) as (
  select distinct parent, parent, 0 from edges union
  select e.child, w.root, w.depth + 1 from walk w join edges e on e.parent = w.node left join recurring.walk v on v.node = e.child and v.root = w.root where v.node is null)
select root as ancestor_id, node as descendant_id, depth from walk where depth > 0""",
    "p4_found": CHANGES + "select * from changes where change is not null",
    "p4_summary": CHANGES + "select snap_no, change, count(*) as n from changes where change is not null group by snap_no, change",
}
