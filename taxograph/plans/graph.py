"""Queries of the category graph on the delivered links, requests and tag seeds, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxograph.operators import inspect as I
from taxograph.operators.actions import answer, defaults, good_tags, validated
from taxograph.operators.graph import CategoryGraph, build_graph, violations
from taxograph.operators.traverse import file_depths
from taxograph.sources import table
from taxograph.sources.links import delivered_links, largest_page_id, titled_links
from taxograph.workspace import Workspace


#: The last graphs built, by session, folder and state of its link files.
_BUILT: dict[tuple, tuple[Workspace, CategoryGraph]] = {}
KEPT_GRAPHS = 4


def _graph(spark: SparkSession, d: str) -> CategoryGraph:
    """The graph of a folder, built once for each state of its link files; the tables of the oldest are deleted."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/categorylinks.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    key = (spark.sparkContext.applicationId, d, tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path))))
    if key not in _BUILT:
        while len(_BUILT) >= KEPT_GRAPHS:
            _BUILT.pop(next(iter(_BUILT)))[0].delete()
        ws = Workspace(spark, "graph")
        _BUILT[key] = (ws, build_graph(delivered_links(table(spark, d, "categorylinks")), workspace=ws))
    return _BUILT[key][1]


def _accepted(graph: CategoryGraph, spark: SparkSession, d: str, ws: Workspace) -> DataFrame:
    return ws.write(validated(graph, defaults(table(spark, d, "workitem"))).filter("reason is null"), "accepted")


def _tags(ws: Workspace, graph: CategoryGraph, spark: SparkSession, d: str) -> DataFrame:
    return good_tags(ws, graph, table(spark, d, "tag_seeds"))


def good_tags_query(spark: SparkSession, d: str) -> DataFrame:
    """SET-3: tag and depth of everything below the tag seeds."""
    return _tags(Workspace(spark, "tags"), _graph(spark, d), spark, d)


def list_files(spark: SparkSession, d: str) -> DataFrame:
    """TRV-1: the files of every different list request, with their depth."""
    ws, graph = Workspace(spark, "list"), _graph(spark, d)
    asked = _accepted(graph, spark, d, ws).filter("a = 'list'").select(F.col("c1").alias("root"), F.col("d1").alias("bound"))
    rows, _ = file_depths(ws, graph, asked)
    return rows.select(F.col("root").alias("c1"), F.col("bound").alias("d1"), "id", "depth")


def _two(spark: SparkSession, d: str, a: str) -> tuple[DataFrame, DataFrame]:
    """Files of c1 of every different pair of searches, and what the search of c2 has seen."""
    ws, graph = Workspace(spark, a), _graph(spark, d)
    asked = ws.write(_accepted(graph, spark, d, ws).filter(F.col("a") == a).select("c1", "d1", "c2", "d2").distinct(), "asked")
    rows, seen = file_depths(ws, graph, asked.select(F.col("c1").alias("root"), F.col("d1").alias("bound")).union(asked.select("c2", "d2")))
    one = asked.join(rows.select(F.col("root").alias("c1"), F.col("bound").alias("d1"), "id", "depth"), ["c1", "d1"])
    return one, seen.select(F.col("root").alias("c2"), F.col("bound").alias("d2"), "id", "depth2")


def and_files(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-1: files below both categories of every different ``and`` request, with the sum of their depths."""
    one, two = _two(spark, d, "and")
    return one.join(two, ["c2", "d2", "id"]).select("c1", "d1", "c2", "d2", "id", (F.col("depth") + F.col("depth2")).alias("depth"))


def not_files(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-2: files below the first category and not below the second."""
    one, two = _two(spark, d, "not")
    return one.join(two, ["c2", "d2", "id"], "left_anti").select("c1", "d1", "c2", "d2", "id", "depth")


def fqv(spark: SparkSession, d: str) -> DataFrame:
    """JOIN-4: tagged files of every different ``fqv`` request."""
    ws, graph = Workspace(spark, "fqv"), _graph(spark, d)
    asked = _accepted(graph, spark, d, ws).filter("a = 'fqv'").select(F.col("c1").alias("root"), F.col("d1").alias("bound"))
    rows, _ = file_depths(ws, graph, asked)
    tags = _tags(Workspace(spark, "tags"), graph, spark, d)
    return rows.join(tags, "id").filter("tag between 1 and 4").select(F.col("root").alias("c1"), F.col("bound").alias("d1"), "id", (F.col("depth") + F.col("good_depth")).alias("depth"), "tag")


def _answers(spark: SparkSession, d: str, *actions: str):
    ws, graph = Workspace(spark, "answers"), _graph(spark, d)
    tags = _tags(Workspace(spark, "tags"), graph, spark, d)
    r = table(spark, d, "workitem")
    return answer(graph, r.filter(F.coalesce(F.lower(F.trim("a")), F.lit("and")).isin(*actions)) if actions else r, tags, workspace=ws)


def path(spark: SparkSession, d: str) -> DataFrame:
    """TRV-2: the shortest path of every path request that has one."""
    return _answers(spark, d, "path").rows.select("req_id", "n", "id")


def pages(spark: SparkSession, d: str) -> DataFrame:
    """LIM-1, LIM-2: the page of every request, in order, with frontier rows as a bounded search shows them."""
    return _answers(spark, d).rows


def page_totals(spark: SparkSession, d: str) -> DataFrame:
    """LIM-3, LIM-4: the exact or estimated size of every request's answer."""
    return _answers(spark, d).totals


def rejections(spark: SparkSession, d: str) -> DataFrame:
    """PRD-8: the requests that are not answered."""
    return validated(_graph(spark, d), defaults(table(spark, d, "workitem"))).filter("reason is not null").select("req_id", "reason")


def graph_checks(spark: SparkSession, d: str) -> DataFrame:
    return violations(_graph(spark, d))


def subcats(spark: SparkSession, d: str) -> DataFrame:
    return I.subcats_of(_graph(spark, d))


def fileinfo(spark: SparkSession, d: str) -> DataFrame:
    return I.files_of(_graph(spark, d))


def dbinfo(spark: SparkSession, d: str) -> DataFrame:
    return I.totals(_graph(spark, d))


def degrees(spark: SparkSession, d: str) -> DataFrame:
    return I.degrees(_graph(spark, d))


def pfs_search(spark: SparkSession, d: str) -> DataFrame:
    return I.with_degrees(_graph(spark, d), 1, 1, 1)


def diamond(spark: SparkSession, d: str) -> DataFrame:
    return I.diamonds(_graph(spark, d))


def scc(spark: SparkSession, d: str) -> DataFrame:
    return I.strong_components(_graph(spark, d))


def scc_lines(spark: SparkSession, d: str) -> DataFrame:
    return I.component_lines(_graph(spark, d))


def walk_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.walk_counts(_graph(spark, d))


def clear_depths(spark: SparkSession, d: str) -> DataFrame:
    """CLI-9 for the categories whose depth does not depend on the order of a visit."""
    return I.clear_depths(_graph(spark, d))


def depth_hist(spark: SparkSession, d: str) -> DataFrame:
    return I.depth_histogram(_graph(spark, d))


def deepest(spark: SparkSession, d: str) -> DataFrame:
    return I.deepest_chains(_graph(spark, d))


def loops(spark: SparkSession, d: str) -> DataFrame:
    return I.loops(_graph(spark, d))


def dfs_path(spark: SparkSession, d: str) -> DataFrame:
    """CLI-3, from the category with the most subcategories to the last of their subcategories."""
    graph = _graph(spark, d)
    start = graph.subcats.groupBy("parent").count().orderBy(F.desc("count"), "parent").first()
    if start is None:
        return I.first_path(graph, 0, 0)
    below = graph.subcats.filter(F.col("parent") == start["parent"]).select(F.col("child").alias("parent"), F.col("pos").alias("first"))
    goal = graph.subcats.join(below, "parent").orderBy(F.desc("first"), F.desc("pos")).first()
    return I.first_path(graph, start["parent"], goal["child"] if goal else start["parent"])


def union_counts(spark: SparkSession, d: str) -> DataFrame:
    """CLI-10, for every category that a request names."""
    graph = _graph(spark, d)
    w = table(spark, d, "workitem")
    return I.union_counts(graph, w.select(F.col("c1").alias("root")).union(w.select("c2")).filter("root is not null"))


def max_page_id(spark: SparkSession, d: str) -> DataFrame:
    return largest_page_id(table(spark, d, "page"))


def extraction(spark: SparkSession, d: str) -> DataFrame:
    """SRC-4, SRC-5: links that name their category by title, joined with the categories of ``page``."""
    page = table(spark, d, "page")
    titles = page.filter("page_namespace = 14 and page_title is not null").groupBy("page_id").agg(F.min("page_title").alias("cl_to"))
    return titled_links(page, table(spark, d, "categorylinks").join(titles, "page_id").select("cl_from", "cl_to", "cl_type"))


NAMED = {"good_tags": good_tags_query}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = NAMED | {
    f.__name__: f
    for f in (
        list_files, and_files, not_files, fqv, path, pages, page_totals, rejections, graph_checks, subcats, fileinfo, dbinfo, degrees, pfs_search, diamond,
        scc, scc_lines, walk_counts, clear_depths, depth_hist, deepest, loops, dfs_path, union_counts, max_page_id, extraction,
    )
}

ROWS = r"""rows as (select seq, cl_from as child, page_id as parent, nullif(lower(substr(regexp_replace(cl_type, '^\s+', ''), 1, 1)), '') as kind from categorylinks where cl_from > 0 and page_id > 0),
lim as (select coalesce(max(parent), 0) + 1 as lim from rows), subs as (select parent, child, row_number() over (partition by parent order by seq, child) as pos from rows where kind = 's'),
fls as (select parent, child as file from rows where kind = 'f'), blocks as (select distinct parent as cat from rows), cats as (select cat from blocks union select child from subs)"""
REQ = """req as (select req_id, coalesce(lower(trim(a)), 'and') as a, c1, coalesce(c2, c1) as c2, case when d1 is null or d1 < 0 then -1 else d1 end as d1, case when d2 is null or d2 < 0 then -1 else d2 end as d2 from workitem),
incats as (select cat from cats where cat < (select lim from lim)),
judged as (select *, case when c1 is null then 'no c1' when a not in ('and', 'not', 'list', 'fqv', 'path') then 'unknown action' when a = 'path' and c1 = c2 then 'path to itself'
  when c1 < 0 or c2 < 0 or c1 >= (select lim from lim) or c2 >= (select lim from lim) then 'id out of range'
  when c1 not in (select cat from incats) or (a <> 'path' and c2 not in (select cat from incats)) then 'no category' end as reason from req),
ok as (select * from judged where reason is null)"""
WALK = """steps as (select distinct parent, child from subs where child < (select lim from lim) and child in (select cat from blocks)),
walk(node, root, depth) using key (node, root) as (
  select distinct root, root, 0 from roots union
  select e.child, w.root, w.depth + 1 from walk w join steps e on e.parent = w.node left join recurring.walk v on v.node = e.child and v.root = w.root where v.node is null),
reached as (select w.root, f.file as id, min(w.depth) as depth from walk w join fls f on f.parent = w.node where f.file < (select lim from lim) group by w.root, f.file)"""
ROOTS = "roots as (select c1 as root from ok where a = '{0}' union select c2 from ok where a = '{0}')"
SEEN = "seen as (select root, id, min(d) as d, min(r) as r from (select root, node as id, 0 as d, depth as r from walk union all select root, id, least(depth, 254), depth from reached) group by root, id)"
TAGS = """tagroots as (select prio, cat_id as root, case when depth < 0 then -1 else depth end as bound, tag from tag_seeds where cat_id in (select cat from cats) and cat_id < (select lim from lim)),
kids as (select distinct t.prio, s.child, s.child in (select cat from blocks) as block from tagroots t join subs s on s.parent = t.root where s.child < (select lim from lim) and s.child <> t.root),
entered as (select prio, root as id from tagroots union select k.prio, k.child from kids k join tagroots t using (prio) where t.bound >= 1 and k.block),
lasts as (select t.prio, t.bound, t.root, case when t.bound = 0 then t.root else k.child end as cat from tagroots t left join kids k on k.prio = t.prio and k.block where t.bound = 0 or k.child is not null),
tagseen as (select prio, id, 0 as d from entered
  union all select l.prio, s.child, l.bound from lasts l join subs s on s.parent = l.cat where s.child < (select lim from lim)
  union all select prio, f.file, case when e.id = t.root then 0 else 1 end from entered e join tagroots t using (prio) join fls f on f.parent = e.id where f.file < (select lim from lim)),
tags as (select id, arg_min(tag, prio) as tag, arg_min(d, prio) as good_depth from (select prio, id, min(d) as d, any_value(tag) as tag from tagseen join tagroots using (prio) group by prio, id) group by id)"""
SQL: dict[str, str] = {
    "good_tags": f"with {ROWS}, {TAGS} select * from tags",
    "list_files": f"with recursive {ROWS}, {REQ}, {ROOTS.format('list')}, {WALK} select distinct c1, d1, id, depth from ok join reached on root = c1 where a = 'list' and (d1 < 0 or depth <= d1)",
    "and_files": f"""with recursive {ROWS}, {REQ}, {ROOTS.format('and')}, {WALK},
second as (select root, id, depth as r, least(depth, 254) as d from reached union all select root, node, depth, 0 from walk)
select o.c1, o.d1, o.c2, o.d2, x.id, x.depth + min(y.d) as depth from (select distinct c1, d1, c2, d2 from ok where a = 'and') o join reached x on x.root = o.c1 and (o.d1 < 0 or x.depth <= o.d1)
join second y on y.root = o.c2 and y.id = x.id and (o.d2 < 0 or y.r <= o.d2) group by o.c1, o.d1, o.c2, o.d2, x.id, x.depth""",
    "not_files": f"""with recursive {ROWS}, {REQ}, {ROOTS.format('not')}, {WALK},
second as (select root, id, depth as r from reached union all select root, node, depth from walk)
select o.c1, o.d1, o.c2, o.d2, x.id, x.depth from (select distinct c1, d1, c2, d2 from ok where a = 'not') o join reached x on x.root = o.c1 and (o.d1 < 0 or x.depth <= o.d1)
where not exists (select 1 from second y where y.root = o.c2 and y.id = x.id and (o.d2 < 0 or y.r <= o.d2))""",
    "fqv": f"with recursive {ROWS}, {REQ}, {ROOTS.format('fqv')}, {WALK}, {TAGS} select distinct c1, d1, id, depth + good_depth as depth, tag from ok join reached on root = c1 join tags using (id) where a = 'fqv' and (d1 < 0 or depth <= d1) and tag between 1 and 4",
    "path": f"""with recursive {ROWS}, {REQ}, roots as (select distinct c1 as root from ok where a = 'path'), hops as (select * from subs where child < (select lim from lim)),
tree(node, root, depth, way) using key (node, root) as (
  select root, root, 0, {{'p': []::bigint[], 'ids': [root]}} from roots union
  select e.child, t.root, min(t.depth) + 1, min({{'p': list_append(t.way.p, e.pos), 'ids': list_append(t.way.ids, e.child)}}) from tree t join hops e on e.parent = t.node
  left join recurring.tree v on v.node = e.child and v.root = t.root where v.node is null group by e.child, t.root),
ends as (select o.req_id, t.depth, t.way from ok o join tree t on t.root = o.c1 and t.node = o.c2 where o.a = 'path' and (o.d1 < 0 or t.depth <= o.d1)
  union all select o.req_id, t.depth, t.way from ok o join fls f on f.file = o.c2 and f.file < (select lim from lim) and f.file not in (select cat from cats) join tree t on t.root = o.c1 and t.node = f.parent where o.a = 'path' and (o.d1 < 0 or t.depth <= o.d1)),
best as (select req_id, min({{'d': depth, 'p': way.p, 'ids': way.ids}}) as b from ends group by req_id)
select req_id, unnest(generate_series(1, len(b.ids))) as n, unnest(b.ids) as id from best""",
    "rejections": f"with {ROWS}, {REQ} select req_id, reason from judged where reason is not null",
    "graph_checks": f"""with {ROWS} select 'file is a category' as rule, count(*) as n from fls where file in (select cat from cats)
union all select 'subcategory is no category', count(*) from subs where child not in (select cat from cats)
union all select 'file beyond the last category', count(*) from fls where file >= (select lim from lim)""",
    "subcats": f"with {ROWS} select parent, pos, child from subs",
    "fileinfo": f"with {ROWS} select parent, row_number() over (partition by parent order by file desc) as pos, file from fls",
    "dbinfo": f"with {ROWS} select (select lim from lim) - (select count(*) from cats where cat < (select lim from lim)) as files, (select count(*) from cats where cat < (select lim from lim)) as categories, (select count(*) from subs) as subcat_relations, (select count(*) from fls) as file_relations",
    "degrees": f"""with {ROWS} select cat, coalesce(p.n, 0) as parents, coalesce(f.n, 0) as files, coalesce(s.n, 0) as subcats from cats left join (select child, count(*) as n from subs group by 1) p on p.child = cat
left join (select parent, count(*) as n from fls group by 1) f on f.parent = cat left join (select parent, count(*) as n from subs group by 1) s on s.parent = cat""",
    "pfs_search": f"""with {ROWS} select cat from cats where (select count(*) from subs where child = cat) = 1 and (select count(*) from fls where parent = cat) = 1 and (select count(*) from subs where parent = cat) = 1""",
    "diamond": f"""with {ROWS}, routes as (select x.parent as a, x.child as b, y.child as d, row_number() over w as rn, first_value(x.child) over w as first from subs x join subs y on y.parent = x.child
  window w as (partition by x.parent, y.child order by x.pos, y.pos)) select a, first, b, d from routes where rn > 1""",
    "scc": f"""with recursive {ROWS}, edges as (select distinct parent, child from subs), reach(a, b) as (select parent, child from edges union select r.a, e.child from reach r join edges e on e.parent = r.b),
found as (select f.a as node, least(f.a, min(f.b)) as component, count(distinct f.b) as members from reach f join reach g on f.a = g.b and f.b = g.a group by f.a) select component, node, members from found where members > 1""",
    "walk_counts": f"""with recursive {ROWS}, edges as (select parent, child, count(*) as times from subs group by 1, 2), n as (select count(*) as n from cats),
w(cat, d, walks) as (select cat, 0, 1::hugeint from cats union all select e.parent, max(w.d) + 1, sum(w.walks * e.times)::hugeint from w join edges e on e.child = w.cat where w.d < 30 group by e.parent)
select ds.d, try_cast(coalesce(sum(walks), 0) // (select n from n) as bigint) as mean, try_cast(coalesce(max(walks), 0) as bigint) as most from (select unnest(generate_series(0, 30)) as d) ds left join w on w.d = ds.d group by ds.d""",
    "clear_depths": f"""with recursive {ROWS}, edges as (select distinct parent, child from subs), reach(a, b) as (select parent, child from edges union select r.a, e.child from reach r join edges e on e.parent = r.b),
looped as (select a from reach where a = b), tangled as (select a from looped union select a from reach where b in (select a from looped)),
down(cat, depth) as (select cat, 0 from cats where cat not in (select a from tangled) union select e.parent, d.depth + 1 from down d join edges e on e.child = d.cat where e.parent not in (select a from tangled))
select cat, max(depth) as depth from down group by cat""",
    "union_counts": f"""with recursive {ROWS}, roots as (select c1 as root from workitem where c1 in (select cat from blocks) union select c2 from workitem where c2 in (select cat from blocks)), edges as (select distinct parent, child from subs),
walk(node, root) as (select root, root from roots union select e.child, w.root from walk w join edges e on e.parent = w.node)
select r.root, count(distinct f.parent) as categories, count(distinct f.file) as files from roots r join walk w on w.root = r.root left join fls f on f.parent = w.node group by r.root""",
    "max_page_id": "select coalesce(max(page_id), 0) as max_page_id from page",
    "extraction": """with t as (select page_id, min(page_title) as cl_to from page where page_namespace = 14 and page_title is not null group by 1), l as (select cl_from, cl_to, cl_type from categorylinks join t using (page_id))
select cl_from as child, page_id as parent, cl_type as type from l join page p on p.page_title = l.cl_to where p.page_namespace = 14 and cl_type in ('subcat', 'file')""",
}
