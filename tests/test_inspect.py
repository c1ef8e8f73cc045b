"""Inspection tools against recursive brute force on random graphs with loops, repeats and self links."""

import random
from collections import Counter, defaultdict

import pytest
from model import FIXTURE
from test_requests import graph_of

from taxograph.operators import inspect as I


def brute_depths(children, cats):
    done = {}

    def depth(v):
        done[v], below = None, 0
        for w in children[v]:
            below = max(below, 1 + depth(w) if w not in done else 0 if done[w] is None else 1 + done[w])
        done[v] = below
        return below

    for v in sorted(cats):
        if v not in done:
            depth(v)
    return done


def brute_loops(children, cats):
    out, mask = [], set()

    def tag(v, path):
        if v in mask:
            if v in path:
                out.append((path[0], len(path) - path.index(v), [*path[path.index(v) :], v]))
            return
        mask.add(v)
        for w in children[v]:
            tag(w, [*path, v])

    for v in sorted(cats):
        if v not in mask:
            tag(v, [])
    return out


def brute_path(children, a, b, deepest):
    seen = set()

    def go(v, path):
        if len(path) == deepest or v in seen:
            return None
        if v == b:
            return [*path, v]
        seen.add(v)
        for w in children[v]:
            if found := go(w, [*path, v]):
                return found
        return None

    return go(a, []) or []


@pytest.mark.parametrize("seed", range(2))
def test_tools(spark, seed):
    rnd = random.Random(seed)
    links = []
    for p in range(1, 15):
        links += [(rnd.randint(1, 18), p, "s") for _ in range(rnd.randint(0, 2))] + [(rnd.randint(50, 60), p, "f") for _ in range(rnd.randint(0, 3))]
    links += [(a + 1, a, "s") for a in range(100, 112)] + [(104, 101, "s"), (61, 120, "f"), (62, 3, "page")]
    graph = graph_of(spark, links)
    children, files = defaultdict(list), defaultdict(list)
    cats = {p for _, p, _ in links} | {c for c, _, t in links if t == "s"}
    for c, p, t in links:
        if t == "s":
            children[p].append(c)
        elif t == "f":
            files[p].append(c)
    parents = Counter(c for cs in children.values() for c in cs)

    assert tuple(I.totals(graph).first()) == (graph.limit - len(cats), len(cats), sum(map(len, children.values())), sum(map(len, files.values())))
    want = {(c, parents[c], len(files[c]), len(children[c])) for c in cats}
    assert {tuple(r) for r in I.degrees(graph).collect()} == want
    assert {r["cat"] for r in I.with_degrees(graph, 1, 1, 1).collect()} == {w[0] for w in want if w[1:] == (1, 1, 1)}
    assert [r["child"] for r in I.subcats_of(graph, 101).orderBy("pos").collect()] == [102, 104]
    for p in files:
        assert [r["file"] for r in I.files_of(graph, p).orderBy("pos").collect()] == sorted(files[p], reverse=True)

    diamonds = []
    for a in cats:
        first = {}
        for b in children[a]:
            for d in children[b]:
                if d in first:
                    diamonds.append((a, first[d], b, d))
                else:
                    first[d] = b
    assert sorted(map(tuple, I.diamonds(graph).collect())) == sorted(diamonds)

    walks, rows = {c: 1 for c in cats}, []
    for d in range(7):
        rows.append((d, sum(walks.values()) // len(cats), max(walks.values())))
        walks = {c: sum(walks[w] for w in children[c]) for c in cats}
    assert sorted(map(tuple, I.walk_counts(graph, 6).collect())) == rows

    depths = brute_depths(children, cats)
    assert {tuple(r) for r in I.depths(graph).collect()} == set(depths.items())
    counts = Counter(depths.values())
    assert sorted(map(tuple, I.depth_histogram(graph).collect())) == [(d, counts[d]) for d in range(max(counts) + 1)]
    most = max(depths.values())
    chains = set()
    for v in (c for c in cats if depths[c] == most):
        chain, w = [str(v)], v
        for need in range(most - 1, -1, -1):
            hit = next((x for x in children[w] if depths[x] == need), None)
            w = w if hit is None else hit
            chain.append("x" if hit is None else str(hit))
        chains.add((v, "|".join(chain)))
    assert {tuple(r) for r in I.deepest_chains(graph).collect()} == chains

    found = [(r["start"], r["length"], list(r["loop"])) for r in I.loops(graph).orderBy("ord").collect()]
    assert found == brute_loops(children, cats)
    for a, b in ((1, 9), (100, 112), (112, 100), (5, 5)):
        assert [r["cat"] for r in I.first_path(graph, a, b).orderBy("pos").collect()] == brute_path(children, a, b, 300)
    assert I.first_path(graph, 100, 112, deepest=5).collect() == []

    def below(v):
        seen, todo = {v}, [v]
        while todo:
            for w in children[todo.pop()]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    roots = spark.createDataFrame([(1,), (100,), (5,), (999,)], "root int")
    want = {(r, sum(bool(files[c]) for c in below(r)), len({f for c in below(r) for f in files[c]})) for r in (1, 100, 5) if r in {p for _, p, _ in links}}
    assert {tuple(r) for r in I.union_counts(graph, roots).collect()} == want

    same = {frozenset(x for x in cats if x in below(v) and v in below(x)) for v in cats}
    same = {c for c in same if len(c) > 1}
    assert {(r["component"], r["node"], r["members"]) for r in I.strong_components(graph).collect()} == {(min(c), x, len(c)) for c in same for x in c}
    lines = [r["line"] for r in I.component_lines(graph).collect()]
    assert {frozenset(map(int, x.split(" : ")[1].split("|"))) for x in lines} == same


def test_fixture_figures(spark):
    graph = graph_of(spark, FIXTURE)
    assert tuple(I.totals(graph).first()) == (5_799_985, 16, 8, 19)
    assert sorted(map(tuple, I.depth_histogram(graph).collect())) == [(0, 11), (1, 4), (2, 1)]
    assert [tuple(r) for r in I.deepest_chains(graph).collect()] == [(1, "1|2|6")]
    assert [tuple(r)[:2] for r in I.walk_counts(graph, 2).orderBy("d").collect()] == [(0, 1), (1, 0), (2, 0)]
    assert sorted(r["cat"] for r in I.with_degrees(graph, 1, 1, 0).collect()) == [3, 6, 10, 110, 120, 210, 220]
    assert I.loops(graph).collect() == [] and I.strong_components(graph).collect() == [] and I.diamonds(graph).collect() == []


def test_empty_and_too_large(spark):
    graph = graph_of(spark, [])
    assert tuple(I.totals(graph).first()) == (1, 0, 0, 0)
    assert I.degrees(graph).collect() == [] and I.diamonds(graph).collect() == [] and I.loops(graph).collect() == []
    assert [tuple(r) for r in I.depth_histogram(graph).collect()] == [(0, 0)] and I.deepest_chains(graph).collect() == []
    with pytest.raises(ValueError):
        I.loops(graph_of(spark, FIXTURE), most=3)


def test_walks_beyond_numbers(spark):
    graph = graph_of(spark, [(1, 1, "s")] * 5000 + [(2, 1, "f")])
    rows = {r["d"]: (r["mean"], r["most"]) for r in I.walk_counts(graph).collect()}
    assert rows[1] == (5000, 5000) and rows[5] == (5000**5, 5000**5) and rows[6] == (None, None) and rows[30] == (None, None)
