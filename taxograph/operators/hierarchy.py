"""Hierarchies of unknown depth from parent-child rows: depths, paths, descendants and loops.

All of it is level-wise: a frontier joins the edges, new pairs are kept, until no pair is new. Several levels form one
job, and the pairs that a job found are written to the shared folder, so neither the lineage nor the number of jobs
grows with every level. Joins carry no hint: Spark broadcasts a frontier only while its measured size is small (which also cuts
the chain of stages), and otherwise a node with very many children or roots is split by adaptive execution, as an
aggregation by another key follows each join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxograph.functions import kind_letter
from taxograph.workspace import Workspace, leveled

#: Levels joined in one job; the first jobs, with wide frontiers, take fewer.
LEVELS = (2, 3, 6)
#: Levels of a frontier that releases nodes, and of one that spreads colours, in one job.
RELEASES = (3, 6)
HOPS = (2, 4)

#: Levels as SQL. A search: rows found are carried by edges from each node to itself (step 0).
LEVEL = """select t.child as node, s.root, min(s.depth + t.step) as depth, bool_and(t.step = 1) as newest
from STATE s join {steps} t on s.node = t.parent where s.newest or t.step = 0 group by t.child, s.root"""
REACH_LEVEL = """select t.child as node, s.root, s.reach, min(s.depth + t.step) as depth, bool_and(t.step = 1) as newest
from STATE s join {steps} t on s.node = t.parent where t.step = 0 or (s.newest and (s.reach < 0 or s.depth < s.reach)) group by t.child, s.root, s.reach"""
PATH_LEVEL = """select node, root, x.depth, newest, x.path from (
  select t.child as node, s.root, bool_and(t.step = 1) as newest,
    min(struct(s.depth + t.step as depth, case when t.step = 1 then concat(s.path, array(t.child)) else s.path end as path)) as x
  from STATE s join {steps} t on s.node = t.parent where s.newest or t.step = 0 group by t.child, s.root)"""
PLACE_LEVEL = """select node, root, x.depth, newest, x.places, x.path from (
  select t.child as node, s.root, bool_and(t.step = 1) as newest, min(struct(s.depth + t.step as depth,
    case when t.step = 1 then concat(s.places, array(t.pos)) else s.places end as places, case when t.step = 1 then concat(s.path, array(t.child)) else s.path end as path)) as x
  from STATE s join {steps} t on s.node = t.parent where s.newest or t.step = 0 group by t.child, s.root)"""
#: A search with steps of any length: rows are newest where they came with fewer steps than they had.
STEP_LEVEL = """select t.child as node, s.root, min(s.depth + t.step) as depth, coalesce(min(s.depth + t.step) < min(case when t.step = 0 then s.depth end), true) as newest
from STATE s join {steps} t on s.node = t.parent where s.newest or t.step = 0 group by t.child, s.root"""
UNSETTLED = "select f.* from STATE f left anti join {settled} h on f.node = h.node and f.root = h.root"
UNBEATEN = UNSETTLED + " and h.depth <= f.depth"
#: Released nodes tell their children (step 1) and parents (step 2); others wait for fewer, or go on waiting (step 0).
RELEASE = """select node, ins, outs, ins = 0 or outs = 0 as newest from (
  select t.child as node, sum(case t.step when 0 then s.ins when 1 then -1 else 0 end) as ins,
    sum(case t.step when 0 then s.outs when 2 then -1 else 0 end) as outs, min(t.step) as least
  from STATE s join {steps} t on s.node = t.parent where s.newest <> (t.step = 0) group by t.child) where least = 0"""
COLOUR = """select node, colour, colour > own as newest from (
  select t.child as node, max(s.colour) as colour, max(case when t.step = 0 then s.colour end) as own
  from STATE s join {steps} t on s.node = t.parent where s.newest or t.step = 0 group by t.child)"""


def subcategory_edges(links: DataFrame) -> DataFrame:
    """Distinct ``(parent, child)`` of the subcategory rows (first letter s, blanks and case aside) with ids > 0."""
    kept = links.filter((kind_letter(F.col("cl_type")) == "s") & (F.col("cl_from") > 0) & (F.col("page_id") > 0))
    return kept.select(F.col("page_id").cast("int").alias("parent"), F.col("cl_from").cast("int").alias("child")).distinct()


def hierarchy_roots(edges: DataFrame) -> DataFrame:
    """``(node)``: the parents that are nobody's child."""
    return edges.select(F.col("parent").alias("node")).distinct().join(edges.select(F.col("child").alias("node")), "node", "left_anti")


def level_search(ws: Workspace, edges: DataFrame, starts: DataFrame, paths: bool = False, label: str = "reach") -> DataFrame:
    """``(node, root, depth[, path])``: every node reached from each start, with the fewest steps.

    ``starts`` has ``(node, root)`` at depth 0. Of several shortest paths the smallest, compared id by id, is given.
    A walk inside one job may run into pairs that are already settled; they are dropped when the job ends, so a loop
    costs at most the levels of one job. Empty edges or starts give the starts alone. Starts may have a ``reach``, one for each
    root: the search from it ends at that depth, or nowhere if it is negative. If the edges have a ``pos`` (INT), the path with the
    smallest list of positions is given instead, and that list as ``places``.

    Within a job the rows found so far are carried along by an edge from each node to itself, which makes every level the
    same join and aggregate: the plan grows by one of each a level, and all levels share one shuffle of the edges and
    one generated code.
    """
    ends = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    placed = "pos" in edges.columns
    both = _with_selves(edges, ends)
    steps = ws.write(edges.select("parent", "child", "pos", F.lit(1).alias("step")).unionByName(both.filter("step = 0").withColumn("pos", F.lit(0))) if placed else both, f"{label}-steps")
    held = [f"{label}-0"]
    bound = [c for c in starts.columns if c == "reach"]
    begun = [F.array().cast("array<int>").alias("places")] * placed + [F.array("node").alias("path")] * (placed or paths)
    first = starts.select("node", "root", *bound).distinct().select("node", "root", *bound, F.lit(0).alias("depth"), F.lit(True).alias("newest"), *begun)
    frontier, more = ws.write_and_look(first, held[0], "newest")
    schema = frontier.schema
    names = [c for c in schema.names if c not in ("newest", "reach")]
    text = PLACE_LEVEL if placed else REACH_LEVEL if bound else PATH_LEVEL if paths else LEVEL
    while more:
        levels = LEVELS[min(len(held) - 1, len(LEVELS) - 1)]
        settled = ws.read(held, schema)
        held.append(f"{label}-{len(held)}")
        met = leveled(frontier, text, levels, UNSETTLED, steps=steps, settled=settled)
        frontier, more = ws.write_and_look(met.select(*schema.names), held[-1], "newest")
        frontier = frontier.filter("newest")
    return ws.read(held, schema).select(*names)


def _with_selves(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(parent, child, step)``: the edges (step 1) and an edge from every node to itself (step 0)."""
    selves = nodes.select(F.col("node").alias("parent"), F.col("node").alias("child"), F.lit(0).alias("step"))
    return edges.select("parent", "child", F.lit(1).alias("step")).union(selves)


def trimmed(ws: Workspace, edges: DataFrame, label: str) -> DataFrame:
    """The (distinct) edges between nodes that no frontier releases: those on loops or between loops.

    One frontier goes down from the roots, one goes up from the leaves: level by level a node is released once all its
    parents are, or all its children. The state has a row for each node that is not released yet, with the numbers it waits
    for; it shrinks from level to level, and nodes that stay unreached are the result.
    """
    one, zero = F.lit(1), F.lit(0)
    ends = edges.select(F.col("parent").alias("node"), zero.alias("ins"), one.alias("outs")).union(edges.select("child", one, zero))
    degrees = ends.groupBy("node").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs"))
    released = F.col("ins").eqNullSafe(0) | F.col("outs").eqNullSafe(0)
    state, more = ws.write_and_look(degrees.withColumn("newest", released), f"{label}-state-0", "newest")
    back = edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"), F.lit(2).alias("step"))
    steps = ws.write(_with_selves(edges, state).union(back), f"{label}-steps")
    turn = 0
    while more:
        state = leveled(state, RELEASE, RELEASES[min(turn, len(RELEASES) - 1)], steps=steps)
        turn += 1
        state, more = ws.write_and_look(state, f"{label}-state-{turn}", "newest")
        ws.drop(f"{label}-state-{turn - 1}")
    alive = state.filter(~F.col("newest")).select("node")
    within = edges.select("parent", "child").join(alive.toDF("parent"), "parent", "left_semi").join(alive.toDF("child"), "child", "left_semi")
    return ws.write(within.select("parent", "child"), label)


def _coloured(ws: Workspace, edges: DataFrame, label: str) -> DataFrame:
    """``(node, colour)``: the largest id that reaches each node, itself included; frontiers start at all nodes and meet."""
    nodes = ws.write(edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct(), f"{label}-nodes")
    steps = ws.write(_with_selves(edges, nodes), f"{label}-steps")
    state, turn = nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("newest")), 0
    while True:
        state = leveled(state, COLOUR, HOPS[min(turn, len(HOPS) - 1)], steps=steps)
        state, more = ws.write_and_look(state, f"{label}-{turn}", "newest")
        ws.drop(f"{label}-{turn - 1}")
        if not more:
            return state.select("node", "colour")
        turn += 1


def _peeled(ws: Workspace, edges: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """The loops that one colouring finds, and the edges without them.

    A frontier goes back from each node that kept its own colour, inside that colour. What it reaches, the node reaches
    too; it is a loop if the start is met again, that is if anything but the start is met, or the start is its own child.
    """
    of = _coloured(ws, edges, f"{label}-colour")
    inner = edges.join(of.toDF("parent", "pc"), "parent").join(of.toDF("child", "cc"), "child")
    back = ws.write(inner.filter("pc = cc").select(F.col("child").alias("parent"), F.col("parent").alias("child")), f"{label}-back")
    met = level_search(ws, back, of.filter("node = colour").select("node", F.col("colour").alias("root")), label=f"{label}-behind")
    sizes = met.groupBy("root").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("members"))
    selves = edges.filter("parent = child").select(F.col("parent").alias("root")).distinct().withColumn("own", F.lit(True))
    repeated = sizes.join(selves, "root", "left").filter("members > 1 or own")
    found = ws.write(met.join(repeated, "root").select("node", "component", "members"), f"{label}-found")
    gone = met.select("node")
    rest = edges.join(gone.toDF("parent"), "parent", "left_anti").join(gone.toDF("child"), "child", "left_anti").select("parent", "child")
    return found, ws.write(rest, f"{label}-rest")


def loop_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """``(node, component, members)`` for each node on a loop: ``component`` is the smallest id of all nodes that it
    reaches and that reach it, ``members`` their number. A node that is its own child is a loop; others have no row.

    Nodes that the frontiers from roots and leaves leave unreached are taken; in what they span, loops are the nodes that
    a frontier meets again (``_peeled``). Loops that hang below others come off in further turns, so no step ever holds a
    graph in one task, whatever the size of a loop.
    """
    left, turn, done = trimmed(ws, edges, "trim"), 0, []
    while not left.isEmpty():
        found, rest = _peeled(ws, left, f"peel-{turn}")
        done.append(found)
        left, turn = trimmed(ws, rest, f"trim-{turn}"), turn + 1
    if not done:
        return left.select(F.col("parent").alias("node"), F.col("parent").alias("component"), F.lit(0).cast("bigint").alias("members"))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def suspects(ws: Workspace, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """The edges that can lie on loops, by what the search from the roots met: few beside the edges of all trees.

    All nodes of a loop are reached from the same roots, or from none. Round a loop the fewest steps from the roots can't
    grow all the way, so some edge leads to a node that is repeated (met before with no more steps than its parent has) or
    unreached. What lies below the end of such an edge and above the start of one, by edges between nodes of the same
    roots, is returned; roots are compared by their number and a hash, which can let an edge more through but none less.
    """
    marks = reached.groupBy("node").agg(F.min("depth").alias("d"), F.struct(F.count(F.lit(1)), F.bit_xor(F.xxhash64("root"))).alias("roots"))
    of = lambda c: marks.select(F.col("node").alias(c), F.col("d").alias(f"{c}_d"), F.col("roots").alias(f"{c}_roots"))
    both = edges.join(of("parent"), "parent", "left").join(of("child"), "child", "left").filter(F.col("parent_roots").eqNullSafe(F.col("child_roots")))
    alike = ws.write(both.select("parent", "child", (F.col("parent_d").isNull() | (F.col("parent_d") >= F.col("child_d"))).alias("repeats")), "alike")
    nothing = F.lit(0).alias("root")
    below = level_search(ws, alike, alike.filter("repeats").select(F.col("child").alias("node"), nothing), label="below").select(F.col("node").alias("parent"))
    inner = ws.write(alike.join(below, "parent", "left_semi"), "inner")
    back = inner.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    above = level_search(ws, back, inner.filter("repeats").select(F.col("parent").alias("node"), nothing), label="above").select("node")
    kept = inner.join(above.toDF("parent"), "parent", "left_semi").join(above.toDF("child"), "child", "left_semi")
    return ws.write(kept.select("parent", "child"), "suspects")


def chains(ws: Workspace, edges: DataFrame) -> list[DataFrame]:
    """Jumps along nodes of one parent, ``(node, parent, up, dist, open)``: in table k, 2^k steps upwards or, if that is less, as far as
    the first node that has no parent or several. A row is ``open`` if its jump ends at a node of one parent.

    A jump is two of the table before, so a way of any length takes its logarithm in tables, of a row a node each. Above
    a node that is n steps below the end are nodes of all smaller numbers: once a table ends no more jumps than the one before, what
    is open in the last lies on or below a loop that nothing enters.
    """
    ones = edges.groupBy("child").agg(F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent")).filter("n = 1")
    ones = ws.write(ones.select(F.col("child").alias("node"), "parent"), "ones")
    above = ones.select(F.col("node").alias("parent"), F.lit(True).alias("open"))
    first = ones.join(above, "parent", "left").select("node", "parent", F.col("parent").alias("up"), F.lit(1).alias("dist"), F.coalesce("open", F.lit(False)).alias("open"))
    state, still = ws.write_and_count(first, "chain-0", "open")
    out, before = [state], None
    while still and still != before:
        then = state.select(F.col("node").alias("up"), F.col("up").alias("end"), F.col("dist").alias("more"), F.col("open").alias("on"))
        longer = state.filter("open").join(then, "up").select("node", "parent", F.col("end").alias("up"), (F.col("dist") + F.col("more")).alias("dist"), F.col("on").alias("open"))
        before = still
        state, still = ws.write_and_count(state.filter("not open").union(longer), f"chain-{len(out)}", "open")
        out.append(state)
    return out


def fewest_steps(ws: Workspace, hops: DataFrame, starts: DataFrame, label: str) -> DataFrame:
    """``(node, root, depth)``: every node reached from each start ``(node, root)``, over edges ``(parent, child, step)`` of any length.

    As ``level_search``, but a pair that comes again with fewer steps goes on once more.
    """
    ends = hops.select(F.col("parent").alias("node")).union(hops.select("child")).distinct()
    selves = ends.select(F.col("node").alias("parent"), F.col("node").alias("child"), F.lit(0).alias("step"))
    steps = ws.write(hops.select("parent", "child", "step").union(selves), f"{label}-steps")
    held = [f"{label}-0"]
    frontier, more = ws.write_and_look(starts.select("node", "root", F.lit(0).alias("depth"), F.lit(True).alias("newest")), held[0], "newest")
    schema = frontier.schema
    while more:
        settled = ws.read(held, schema)
        levels = LEVELS[min(len(held) - 1, len(LEVELS) - 1)]
        held.append(f"{label}-{len(held)}")
        met = leveled(frontier, STEP_LEVEL, levels, UNBEATEN, steps=steps, settled=settled)
        frontier, more = ws.write_and_look(met.select(*schema.names), held[-1], "newest")
        frontier = frontier.filter("newest")
    return ws.write(ws.read(held, schema).groupBy("node", "root").agg(F.min("depth").alias("depth")), label)


def _loop_rows(ws: Workspace, jumps: list[DataFrame], entries: DataFrame, found: DataFrame) -> DataFrame:
    """``(node, root, depth)``, depth -1, of all nodes on loops, by ``found``, the loops among the ends of jumps.

    Nodes of one parent are on a loop if they lie above the start of an edge (of ``entries``) between two ends of one loop; jumps
    of all lengths from there meet all of them.
    """
    of = lambda c, name: found.select(F.col("node").alias(c), F.col("component").alias(name))
    inside = entries.join(of("end", "component"), "end").join(of("child", "other"), "child").filter("component = other and parent <> end")
    marks = inside.select(F.col("parent").alias("node"), "component").distinct()
    for k, jump in enumerate(jumps):
        both = marks.join(jump.select("node", "up"), "node", "left").select(F.explode(F.array("node", "up")).alias("node"), "component")
        marks = both.filter("node is not null").distinct()
        if k % 2:
            marks = ws.write(marks, f"marks-{k}")
    members = ws.write(found.select("node", "component").union(marks.select("node", "component")).distinct(), "members")
    least = members.groupBy("component").agg(F.min("node").alias("root"))
    return members.join(least, "component").select("node", "root", F.lit(-1).alias("depth"))


def hierarchy(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``(node_id, root_id, depth)`` for each category and each root that reaches it, and depth -1 for each category on a
    loop, with the smallest id of its loop as ``root_id``.

    Reads ``cl_from``, ``page_id``, ``cl_type``; repeated rows, nulls and ids below 1 play no part. A category that no
    root reaches (a loop that nothing enters, or what hangs under one) has only a loop row, or none. Empty in, empty out.

    What is searched, from the roots and for loops, is the graph of the nodes that have no parent or several: an edge to such a
    node is a hop from the end of the jumps of its parent. All other nodes have the rows of their end, so many steps deeper.
    """
    ws = Workspace(spark, "hierarchy")
    edges = ws.write(subcategory_edges(links), "edges")
    jumps = chains(ws, edges)
    last = jumps[-1]
    into = edges.join(last.select(F.col("node").alias("child")), "child", "left_anti")
    jumped = last.select(F.col("node").alias("parent"), "up", "dist", "open")
    entries = into.join(jumped, "parent", "left").filter("open is null or not open").select(F.coalesce("up", "parent").alias("end"), "parent", "child", (F.coalesce("dist", F.lit(0)) + 1).alias("step"))
    entries = ws.write(entries, "entries")
    hops = ws.write(entries.groupBy("end", "child").agg(F.min("step").alias("step")).withColumnRenamed("end", "parent"), "hops")
    met = fewest_steps(ws, hops, hierarchy_roots(edges).select("node", F.col("node").alias("root")), "ends")
    below = last.filter("not open").join(met.withColumnRenamed("node", "up"), "up").select("node", "root", (F.col("depth") + F.col("dist")).alias("depth"))
    unentered = last.filter("open").select("parent", F.col("node").alias("child"))
    found = loop_components(ws, suspects(ws, hops.select("parent", "child").union(unentered), met))
    return met.union(below).union(_loop_rows(ws, jumps, entries, found)).withColumnsRenamed({"node": "node_id", "root": "root_id"})


def hierarchy_paths(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``(node_id, root_id, depth, path)``: the rows of ``hierarchy`` that have a path, without a search for loops."""
    ws = Workspace(spark, "paths")
    edges = ws.write(subcategory_edges(links), "edges")
    reached = level_search(ws, edges, hierarchy_roots(edges).select("node", F.col("node").alias("root")), paths=True)
    return reached.withColumnsRenamed({"node": "node_id", "root": "root_id"})


def descendants(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``(ancestor_id, descendant_id, depth)``: every category below each category, with the fewest steps, at least 1.

    A category on a loop is not listed below itself. The same search as ``hierarchy``, started from every parent.
    """
    ws = Workspace(spark, "descendants")
    edges = ws.write(subcategory_edges(links), "edges")
    reached = level_search(ws, edges, edges.select(F.col("parent").alias("node"), F.col("parent").alias("root")).distinct())
    return reached.filter("depth > 0").select(F.col("root").alias("ancestor_id"), F.col("node").alias("descendant_id"), "depth")
