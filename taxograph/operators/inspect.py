"""Inspection of a category graph: totals, degrees, diamonds, walks, depths, loops and unions of file sets.

Counts and joins are plain DataFrame plans. What depends on the order of a depth-first visit (printing order of
components, back edges, the first path, depths on loops) is sequential by nature; it runs in one task over a graph of at
most ``VISIT_EDGES`` edges, a counted bound, and refuses larger ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxograph.operators.graph import CategoryGraph
from taxograph.operators.hierarchy import level_search, loop_components
from taxograph.operators.ranking import ranked
from taxograph.workspace import Workspace

VISIT_EDGES = 1 << 22
WALK_LEVELS = 30


def totals(graph: CategoryGraph) -> DataFrame:
    """One row ``(files, categories, subcat_relations, file_relations)``; ``files`` counts all ids that are no category."""
    return (
        graph.categories.filter(F.col("cat") < graph.limit).agg((F.lit(graph.limit) - F.count(F.lit(1))).cast("bigint").alias("files"), F.count(F.lit(1)).alias("categories"))
        .crossJoin(graph.subcats.filter(F.col("parent") < graph.limit).agg(F.count(F.lit(1)).alias("subcat_relations")))
        .crossJoin(graph.files.filter(F.col("parent") < graph.limit).agg(F.count(F.lit(1)).alias("file_relations")))
    )  # three rows of one


def degrees(graph: CategoryGraph) -> DataFrame:
    """``(cat, parents, files, subcats)`` of every category, repeated edges counted."""
    tagged = graph.categories.select("cat", F.lit(0).alias("parents"), F.lit(0).alias("files"), F.lit(0).alias("subcats"), F.lit(1).alias("known"))
    zero = F.lit(0)
    ins = graph.subcats.select(F.col("child").alias("cat"), F.lit(1).alias("parents"), zero.alias("files"), zero.alias("subcats"), zero.alias("known"))
    subs = graph.subcats.select(F.col("parent").alias("cat"), zero.alias("parents"), zero.alias("files"), F.lit(1).alias("subcats"), zero.alias("known"))
    files = graph.files.select(F.col("parent").alias("cat"), zero.alias("parents"), F.lit(1).alias("files"), zero.alias("subcats"), zero.alias("known"))
    sums = tagged.unionByName(ins).unionByName(subs).unionByName(files).groupBy("cat").agg(*(F.sum(c).alias(c) for c in ("parents", "files", "subcats", "known")))
    return sums.filter("known > 0").drop("known")


def with_degrees(graph: CategoryGraph, parents: int, files: int, subcats: int) -> DataFrame:
    """``(cat)`` of the categories with exactly these numbers of parents, files and subcategories."""
    return degrees(graph).filter((F.col("parents") == parents) & (F.col("files") == files) & (F.col("subcats") == subcats)).select("cat")


def subcats_of(graph: CategoryGraph, parent: int | None = None) -> DataFrame:
    """``(parent, pos, child)``: direct subcategories in input order, of one category or of all."""
    return graph.subcats if parent is None else graph.subcats.filter(F.col("parent") == parent)


def files_of(graph: CategoryGraph, parent: int | None = None) -> DataFrame:
    """``(parent, pos, file)``: direct files by id downwards, of one category or of all; a repeated file repeats."""
    rows = graph.files if parent is None else graph.files.filter(F.col("parent") == parent)
    return ranked(Workspace(graph.spark, "files"), rows, ["parent"], [F.desc("file")], "ranked", "pos").select("parent", F.col("pos").cast("int").alias("pos"), "file")


def diamonds(graph: CategoryGraph) -> DataFrame:
    """``(a, first, b, d)``: a reaches d through b, after having reached it through ``first``. k routes give k - 1 rows."""
    one, two = graph.subcats.select(F.col("parent").alias("a"), F.col("pos").alias("pos1"), F.col("child").alias("b")), graph.subcats.select(F.col("parent").alias("b"), F.col("pos").alias("pos2"), F.col("child").alias("d"))
    w = Window.partitionBy("a", "d").orderBy("pos1", "pos2")
    routes = one.join(two, "b").select("a", "b", "d", F.row_number().over(w).alias("rn"), F.first("b").over(w).alias("first"))
    return routes.filter("rn > 1").select("a", "first", "b", "d")


def walk_counts(graph: CategoryGraph, levels: int = WALK_LEVELS) -> DataFrame:
    """``(d, mean, most)`` for d = 0..levels: walks of d steps down from a category, mean (fraction dropped) and maximum.

    Counts are DECIMAL(38, 0) on the way and BIGINT in the result; a figure beyond either is null. Levels at which no category has
    a walk have 0 and 0.
    """
    ws = Workspace(graph.spark, "walks")
    edges = ws.write(graph.subcats.groupBy("parent", "child").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("times")), "edges")
    n = graph.categories.count()
    now = ws.write(graph.categories.select("cat", F.lit(1).cast("decimal(38,0)").alias("walks")), "level-0")
    out = now.agg(F.lit(0).alias("d"), F.coalesce(F.sum("walks"), F.lit(0)).cast("decimal(38,0)").alias("total"), F.coalesce(F.max("walks"), F.lit(0)).cast("decimal(38,0)").alias("most"))
    for d in range(1, levels + 1):
        now = now.join(edges, F.col("cat") == F.col("child")).groupBy("parent").agg(F.try_sum(F.try_multiply("walks", "times").cast("decimal(38,0)")).alias("walks")).select(F.col("parent").alias("cat"), "walks")
        if d % 3 == 0:
            now = ws.write(now, f"level-{d}")
        out = out.union(now.agg(F.lit(d), F.when(F.count(F.lit(1)) == F.count("walks"), F.coalesce(F.try_sum("walks"), F.when(F.count(F.lit(1)) == 0, 0))), F.when(F.count(F.lit(1)) == F.count("walks"), F.coalesce(F.max("walks"), F.lit(0)))))
    divisor = max(n, 1)
    return out.select("d", F.when(F.col("total") < F.lit(Decimal(divisor << 63)), F.floor(F.col("total") / F.lit(divisor))).try_cast("bigint").alias("mean"), F.col("most").try_cast("bigint").alias("most"))


def strong_components(graph: CategoryGraph) -> DataFrame:
    """``(component, node, members)`` of the strongly connected components of more than one category."""
    ws = Workspace(graph.spark, "components")
    edges = ws.write(graph.subcats.select("parent", "child").distinct(), "edges")
    return loop_components(ws, edges).filter("members > 1").select("component", "node", "members")


def union_counts(graph: CategoryGraph, roots: DataFrame) -> DataFrame:
    """``(root, categories, files)``: for each ``(root)``, the categories in and below it that hold files, and their distinct files."""
    ws = Workspace(graph.spark, "union")
    known = graph.categories.filter("has_block").select(F.col("cat").alias("root"))
    starts = roots.select("root").distinct().join(known, "root", "left_semi").select("root", F.col("root").alias("node"))
    met = level_search(ws, ws.write(graph.subcats.select("parent", "child").distinct(), "edges"), starts)
    held = met.join(graph.files, F.col("node") == F.col("parent")).groupBy("root", "file").agg(F.count(F.lit(1)).alias("x"))
    cats = met.join(graph.files.select(F.col("parent").alias("node")).distinct(), "node", "left_semi").groupBy("root").agg(F.count(F.lit(1)).alias("categories"))
    files = held.groupBy("root").agg(F.count(F.lit(1)).alias("files"))
    return starts.select("root").join(cats, "root", "left").join(files, "root", "left").fillna(0)


def _settled_depths(graph: CategoryGraph) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(cat, depth)`` of the categories that reach no loop, ``(cat)`` of those that do, and the edges ``(parent, pos, child)``."""
    ws = Workspace(graph.spark, "depths")
    edges = ws.write(graph.subcats.select("parent", "pos", "child"), "edges")
    plain = ws.write(edges.select("parent", "child").distinct(), "plain")
    loops = ws.write(loop_components(ws, plain).select("node"), "loops")
    up = plain.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    tangled = ws.write(level_search(ws, up, loops.select("node", F.lit(0).alias("root")), label="above").select(F.col("node").alias("cat")), "tangled")
    cats = graph.categories.select("cat")
    state = ws.write(cats.join(tangled, "cat", "left_anti").join(plain.select(F.col("parent").alias("cat")), "cat", "left_anti").select("cat", F.lit(0).alias("depth"), F.lit(True).alias("newest")), "state-0")
    clear = plain.join(tangled.select(F.col("cat").alias("parent")), "parent", "left_anti")
    ends = clear.select("parent").union(clear.select("child")).union(cats.join(tangled, "cat", "left_anti")).distinct()
    climb = ws.write(clear.select(F.col("child").alias("low"), F.col("parent").alias("high"), F.lit(1).alias("step")).union(ends.select(F.col("parent").alias("low"), F.col("parent").alias("high"), F.lit(0).alias("step"))), "climb")
    turn = 0
    while not state.filter("newest").isEmpty():
        for _ in range(6):
            moved = state.join(climb, F.col("cat") == F.col("low")).filter(F.col("newest") | (F.col("step") == 0))
            state = moved.select(F.col("high").alias("cat"), (F.col("depth") + F.col("step")).alias("depth"), (F.col("step") == 1).alias("newest")).groupBy("cat").agg(F.max("depth").alias("depth"), F.bool_or("newest").alias("newest"))
        turn += 1
        state = ws.write(state, f"state-{turn}")
        ws.drop(f"state-{turn - 1}")
    return state.select("cat", "depth"), tangled, edges


def clear_depths(graph: CategoryGraph) -> DataFrame:
    """``(cat, depth)``: the longest descent below each category that cannot reach a loop."""
    return _settled_depths(graph)[0]


def depths(graph: CategoryGraph) -> DataFrame:
    """``(cat, depth)``: the longest descent below each category.

    Categories that cannot reach a loop are settled level by level from below, in parallel. For the others the value
    depends on the order of a depth-first visit by ascending id (an edge back onto the current path counts 0); they are
    visited in one task.
    """
    settled, tangled, edges = _settled_depths(graph)
    rest = edges.join(tangled.select(F.col("cat").alias("parent")), "parent", "left_semi").join(settled.withColumnRenamed("cat", "child"), "child", "left").select("parent", "pos", "child", "depth")
    return settled.unionByName(visit(rest, _tangled_depths, "cat int, depth int"))


def depth_histogram(graph: CategoryGraph) -> DataFrame:
    """``(depth, n)`` for every depth from 0 to the largest, zeros included; one row (0, 0) for an empty graph."""
    d = depths(graph)
    counts = d.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    whole = d.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("most")).select(F.explode(F.sequence(F.lit(0), "most")).alias("depth"))
    return whole.join(counts, "depth", "left").select("depth", F.coalesce("n", F.lit(0)).alias("n"))


def deepest_chains(graph: CategoryGraph, at: DataFrame | None = None) -> DataFrame:
    """``(cat, chain)``: for each category of the largest depth, the first child with the needed depth, and so on; ``x`` where none has it."""
    ws = Workspace(graph.spark, "chains")
    d = ws.write(depths(graph) if at is None else at, "depths")
    most = d.agg(F.max("depth")).first()[0]
    if most is None:
        return d.select("cat", F.lit("").alias("chain")).limit(0)
    below = ws.write(graph.subcats.join(d.withColumnRenamed("cat", "child"), "child").groupBy("parent", "depth").agg(F.min_by("child", "pos").alias("child")), "below")
    now = d.filter(F.col("depth") == most).select("cat", F.col("cat").alias("last"), F.col("cat").cast("string").alias("chain"))
    for need in range(most - 1, -1, -1):
        now = now.join(below.filter(F.col("depth") == need).select(F.col("parent").alias("last"), "child"), "last", "left").select("cat", F.coalesce("child", "last").alias("last"), F.concat_ws("|", "chain", F.coalesce(F.col("child").cast("string"), F.lit("x"))).alias("chain"))
        if need % 8 == 0:
            now = ws.write(now, f"chain-{need}")
    return now.select("cat", "chain")


def visit(edges: DataFrame, run: Callable, schema: str, most: int = VISIT_EDGES) -> DataFrame:
    """Run a depth-first visit over all edges in one task; an error if there are more than ``most``."""
    n = edges.count()
    if n > most:
        raise ValueError(f"{n} edges are too many for a depth-first visit in one task (at most {most})")
    return edges.groupBy().applyInPandas(run, schema)


def _children(pdf) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for p, c in pdf.sort_values(["parent", "pos"])[["parent", "child"]].itertuples(index=False):
        out.setdefault(int(p), []).append(int(c))
    return out


def _tangled_depths(pdf):
    """Depths of the parents of the given edges; ``depth`` is that of children settled before."""
    import pandas as pd

    children = _children(pdf)
    done = {int(c): int(d) for c, d in zip(pdf["child"], pdf["depth"], strict=True) if d == d and d is not None}
    below: dict[int, int] = {}
    on: set[int] = set()
    for start in sorted(children):
        if start in done:
            continue
        below[start] = 0
        on.add(start)
        todo = [(start, iter(children[start]))]
        while todo:
            v, rest = todo[-1]
            for w in rest:
                if w in on:
                    continue
                if w not in done and w in children:
                    below[w] = 0
                    on.add(w)
                    todo.append((w, iter(children[w])))
                    break
                below[v] = max(below[v], 1 + done.get(w, 0))
            else:
                todo.pop()
                on.discard(v)
                done[v] = below[v]
                if todo:
                    above = todo[-1][0]
                    below[above] = max(below[above], 1 + done[v])
    return pd.DataFrame({"cat": sorted(below), "depth": [done[v] for v in sorted(below)]}).astype("int32")


def _back_edges(children: dict[int, list[int]]) -> Iterator[list[int]]:
    """[start, loop...]: the path from the visited-again category back to itself, roots and children in order."""
    seen: set[int] = set()
    for start in sorted(set(children) | {c for cs in children.values() for c in cs}):
        if start in seen:
            continue
        seen.add(start)
        path, place = [start], {start: 0}
        todo = [iter(children.get(start, ()))]
        while todo:
            for w in todo[-1]:
                if w in place:
                    yield [start, *path[place[w] :], w]
                elif w not in seen:
                    seen.add(w)
                    place[w] = len(path)
                    path.append(w)
                    todo.append(iter(children.get(w, ())))
                    break
            else:
                todo.pop()
                del place[path.pop()]


def loops(graph: CategoryGraph, most: int = VISIT_EDGES) -> DataFrame:
    """``(ord, start, length, loop)``: every back edge of the depth-first forest, in the order of the visit; ``loop`` is a
    list of ids that ends with the one it starts with. ``start`` is the root of the visit."""

    def run(pdf):
        import pandas as pd

        rows = [(k, x[0], len(x) - 2, x[1:]) for k, x in enumerate(_back_edges(_children(pdf)))]
        return pd.DataFrame(rows, columns=["ord", "start", "length", "loop"])

    return visit(graph.subcats, run, "ord bigint, start int, length int, loop array<int>", most)


def component_lines(graph: CategoryGraph, most: int = VISIT_EDGES) -> DataFrame:
    """``(ord, line)``: components of more than one category as ``n : id|id|...``, in the order a depth-first search closes them."""

    def run(pdf):
        import pandas as pd

        return pd.DataFrame(list(enumerate(_closing(_children(pdf)))), columns=["ord", "line"]).astype({"ord": "int64", "line": "object"})

    return visit(graph.subcats, run, "ord bigint, line string", most)


def _closing(children: dict[int, list[int]]) -> Iterator[str]:
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    stack: list[int] = []
    on: set[int] = set()

    def enter(v: int) -> tuple[int, Iterator[int]]:
        index[v] = low[v] = len(index)
        stack.append(v)
        on.add(v)
        return v, iter(children.get(v, ()))

    for start in sorted(children):
        todo = [enter(start)] if start not in index else []
        while todo:
            v, rest = todo[-1]
            for w in rest:
                if w not in index:
                    todo.append(enter(w))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[v])
                if low[v] == index[v]:
                    members = [stack.pop()]
                    while members[-1] != v:
                        members.append(stack.pop())
                    on.difference_update(members)
                    if len(members) > 1:
                        yield f"{len(members)} : " + "|".join(map(str, members))


def first_path(graph: CategoryGraph, start: int, goal: int, deepest: int = 300, most: int = VISIT_EDGES) -> DataFrame:
    """``(pos, cat)``: the first path that a depth-first search finds, at most ``deepest`` categories long; empty without one."""

    def run(pdf):
        import pandas as pd

        children, seen, path, todo = _children(pdf), set(), [], []

        def enter(v: int) -> None:
            seen.add(v)
            path.append(v)
            todo.append(iter(children.get(v, ())))

        enter(start)
        while todo and path[-1] != goal:
            for w in todo[-1]:
                if len(path) < deepest and w not in seen:
                    enter(w)
                    break
            else:
                todo.pop()
                path.pop()
        return pd.DataFrame({"pos": range(len(path)), "cat": path}).astype("int32")

    if start == goal:
        return graph.categories.filter(F.col("cat") == start).select(F.lit(0).alias("pos"), "cat")
    return visit(graph.subcats, run, "pos int, cat int", most)
