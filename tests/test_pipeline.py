"""Key profiles, hierarchies and snapshot differences against brute force, on nulls, repeats, ties and empty tables."""

import datetime as dt
import random
from collections import Counter, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from taxograph.operators import hierarchy as H
from taxograph.operators import snapshot_diff
from taxograph.operators.key_profile import chunk_layout, frequent_keys, heavy_keys, key_profiles, merge_rounds, tree_merge
from taxograph.operators.snapshot_diff import snapshot_changes
from taxograph.workspace import Workspace

LINKS = "cl_from int, page_id int, cl_type string, side string, key_id int, chunk int, node int"


def links(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], LINKS)


@pytest.mark.parametrize("chunk_rows, fan_in, hot_share", [(1 << 20, 8, 500), (7, 2, 5), (3, 3, 2)])
def test_key_profiles(spark, chunk_rows, fan_in, hot_share):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, -3, 0, 1, 2, 3, 9, *[7] * 10]), rnd.choice([None, -3, 0, 1, 4, *[5] * 10]), "f") for _ in range(300)]
    want = {}
    for side, at in (("page_id", 1), ("cl_from", 0)):
        for key in {r[at] for r in rows if r[at] and r[at] > 0}:
            own = [r for r in rows if r[at] == key]
            want[side, key] = (len(own), len({r[1 - at] for r in own if r[1 - at] and r[1 - at] > 0}))
    got = {(r["side"], r["key_id"]): (r["n_rows"], r["n_partners"]) for r in key_profiles(links(spark, rows), chunk_rows=chunk_rows, fan_in=fan_in, hot_share=hot_share).collect()}
    assert got == want


@pytest.mark.parametrize("seed, chunk_rows, share", [(0, 1 << 16, 50), (1, 20, 10), (2, 5, 4), (3, 64, 7)])
def test_heavy_keys(spark, seed, chunk_rows, share):
    rnd = random.Random(seed)
    ids = [None, -3, 0, *[7] * 30, *range(1, 12), *range(20, 40)]
    rows = [(rnd.choice(ids) if k % 200 < 150 else 11, rnd.choice(ids[: 3 + k // 20]), "f") for k in range(1000)]  # some keys lie in a few chunks, some in all
    counts = Counter(("page_id", r[1]) for r in rows) + Counter(("cl_from", r[0]) for r in rows)
    want = {k for k, n in counts.items() if k[1] and k[1] > 0 and n * share >= len(rows)}
    df = links(spark, rows)
    assert {tuple(r) for r in heavy_keys(df, share=share, chunk_rows=chunk_rows, fan_in=2).collect()} == want
    total, found = frequent_keys(df, "page_id", "cl_from", share, chunk_rows, 2)
    names = ("page_id", "cl_from")
    near = {(names[r["side"]], r["key_id"]) for r in found.collect()}
    assert total == len(rows) and want <= near and all(sum(s == side for s, _ in near) <= share * 4 / 3 for side in names)


def test_rounds_of_a_tree(spark):
    df = links(spark, [(1, 2, "f")] * 1000).repartition(4)
    total, each, chunks = chunk_layout(df, 16)
    assert total == 1000 and chunks == 4 * each and each >= 16
    assert merge_rounds(1, 4) == 0 and merge_rounds(64, 4) == 3 and merge_rounds(65, 4) == 4
    states = spark.range(0, 100, 1, 4).selectExpr("id % 2 as k", "id as chunk", "1 as n")
    merged = tree_merge(states, ["k"], ["n"], 100, 4)
    assert merged._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == merge_rounds(100, 4) == 4
    assert {tuple(r) for r in merged.collect()} == {(0, 50), (1, 50)}


def test_key_profiles_of_nothing(spark):
    empty = links(spark, [])
    assert key_profiles(empty).collect() == [] and heavy_keys(empty).collect() == []
    nulls = links(spark, [(None, None, "f"), (0, -1, "f")])
    assert key_profiles(nulls).collect() == [] and heavy_keys(nulls).collect() == []


def brute_hierarchy(edges):
    children, parents = defaultdict(set), defaultdict(set)
    for a, b in edges:
        children[a].add(b)
        parents[b].add(a)
    below = {}
    for a in set(children) | set(parents):
        dist, todo = {}, deque([(a, 0)])
        while todo:
            x, d = todo.popleft()
            for y in children[x]:
                if y not in dist:
                    dist[y] = d + 1
                    todo.append((y, d + 1))
        below[a] = dist
    rows = set()
    for a in below:
        if children[a] and not parents[a]:
            rows |= {(a, a, 0)} | {(b, a, d) for b, d in below[a].items()}
        if a in below[a]:
            rows.add((a, min(b for b in below[a] if a in below[b]), -1))
    return rows, below


@pytest.mark.parametrize("seed", range(2))
def test_hierarchy(spark, seed):
    rnd = random.Random(seed)
    n = 40
    edges = {(rnd.randint(1, n), rnd.randint(1, n)) for _ in range(rnd.choice([30, 45]))} | {(100 + i, 101 + i) for i in range(25)} | {(7, 7)}
    rows = [(b, a, rnd.choice(["s", " Subcat", "subcat "])) for a, b in edges for _ in range(rnd.randint(1, 2))]
    rows += [(1, 2, "file"), (3, None, "s"), (None, 3, "s"), (0, 5, "s"), (5, -1, "s"), (6, 1, None), (8, 1, "")]
    want, below = brute_hierarchy(edges)
    df = links(spark, rows)
    assert {tuple(r) for r in H.hierarchy(spark, df).collect()} == want
    with_paths = H.hierarchy_paths(spark, df).collect()
    assert {(r["node_id"], r["root_id"], r["depth"]) for r in with_paths} == {r for r in want if r[2] >= 0}
    for r in with_paths:
        assert r["path"][0] == r["root_id"] and r["path"][-1] == r["node_id"] and len(r["path"]) == r["depth"] + 1
        assert all((a, b) in edges for a, b in zip(r["path"], r["path"][1:], strict=False))
    found = {(r["ancestor_id"], r["descendant_id"], r["depth"]) for r in H.descendants(spark, df).collect()}
    assert found == {(a, b, d) for a in below for b, d in below[a].items() if a != b}
    ws = Workspace(spark, "test")
    frame = ws.write(H.subcategory_edges(df), "edges")
    one = [tuple(r) for r in H.loop_components(ws, frame).collect()]
    assert len(one) == len({a for a, _, _ in one})
    assert {(a, b) for a, b, _ in one} == {(a, b) for a, b, d in want if d == -1}
    sizes = Counter(c for _, c, _ in one)
    assert all(sizes[c] == m for _, c, m in one)


def long_ways(seed):
    """Ways of one parent, loops with long ways between few entries, loops that nothing enters, and what hangs under them."""
    rnd = random.Random(seed)
    edges = {(i, i + 1) for i in range(1, 150)} | {(150, 90), (40, 95), (40, 120), (100, 41), (7, 7), (110, 60)} if seed == 0 else set()
    for at in range(200, 500, 50):
        k, tail = rnd.randint(1, 9), rnd.randint(1, 20)
        edges |= {(at + i, at + (i + 1) % k) for i in range(k)} | {(at + k + i - 1, at + k + i) for i in range(tail)}
        if rnd.random() < 0.6:  # else nothing enters the loop
            edges.add((500 + at, at + rnd.randrange(k)))
        if rnd.random() < 0.7:
            edges.add((at + k + tail - 1, 200 + rnd.randrange(300)))
    for _ in range(12):
        edges.add((rnd.randint(200, 520), rnd.randint(200, 520)))
    return edges


@pytest.mark.parametrize("seed", range(2))
def test_hierarchy_of_long_ways(spark, seed):
    edges = long_ways(seed)
    want, _ = brute_hierarchy(edges)
    got = [tuple(r) for r in H.hierarchy(spark, links(spark, [(b, a, "s") for a, b in edges])).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_tables_of_a_deep_hierarchy(spark, monkeypatch):
    """A way of 300 nodes takes as many tables as its logarithm says, not one for every few levels."""
    labels, write = [], Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda ws, df, label: labels.append(label) or write(ws, df, label))
    rows = H.hierarchy(spark, links(spark, [(i + 1, i, "s") for i in range(1, 300)] + [(1000, 1, "s"), (1000, 300, "s")])).collect()
    assert {tuple(r) for r in rows} == {(i, 1, i - 1) for i in range(1, 301)} | {(1000, 1, 1)}
    assert len(labels) < 40


def test_hierarchy_of_nothing_and_of_loops_only(spark):
    assert H.hierarchy(spark, links(spark, [])).collect() == []
    loop = links(spark, [(1, 2, "s"), (2, 1, "s"), (9, 2, "s")])
    assert {tuple(r) for r in H.hierarchy(spark, loop).collect()} == {(1, 1, -1), (2, 1, -1)}


SNAP = "snap_no int, cl_from int, page_id int, cl_type string, cl_sortkey string, delivered_at timestamp, change string"


def brute_changes(rows):
    held = defaultdict(dict)
    blank = lambda t: (t or "").strip() or None
    for s, a, b, kind, key, at, _ in rows:
        if None in (s, a, b):
            continue
        own = held[s].setdefault((a, b), (dt.datetime.min, None))
        if (at or dt.datetime.min) >= own[0]:
            held[s][a, b] = (at or dt.datetime.min, ((blank(kind) or " ")[0].lower(), blank(key)))
    out, numbers = set(), sorted(held)
    for old, new in zip(numbers, numbers[1:], strict=False):
        for k in held[old].keys() | held[new].keys():
            x, y = held[old].get(k), held[new].get(k)
            if x is None or y is None or x[1] != y[1]:
                out.add((new, *k, "added" if x is None else "removed" if y is None else "changed"))
    return out


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_snapshot_changes(spark, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    rnd, at = random.Random(5), dt.datetime(2024, 1, 1)
    rows = []
    for s in (3, 4, 9, None):
        for _ in range(60):
            at += dt.timedelta(minutes=1)
            row = (s, rnd.choice([None, 1, 2, 3, 4, 5]), rnd.choice([None, 1, 2, 3]), rnd.choice(["file", " File", "subcat", None, "", "page"]), rnd.choice(["A", " A ", "a", "", "  ", None]), rnd.choice([at, at, None, at - dt.timedelta(days=30000)]), "x")
            rows += [row] * rnd.randint(1, 2)
    seen = {}
    rows = [r for r in rows if r[5] or seen.setdefault(r[:3], r) is r]  # one record without a time for each key: no tie
    got = [tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SNAP)).collect()]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == len(set(got)) and set(got) == brute_changes(rows)


def test_snapshot_changes_of_nothing_and_of_one(spark):
    assert snapshot_changes(spark.createDataFrame([], SNAP)).collect() == []
    assert snapshot_changes(spark.createDataFrame([(1, 1, 1, "f", "x", None, "y")], SNAP)).collect() == []


def test_row_hash_tells_nulls_apart(spark):
    rows = [("a", None), (None, "a"), ("", "a"), ("a", ""), ("a1:", ""), (None, None), ("", "")]
    hashes = spark.createDataFrame(rows, "a string, b string").select(snapshot_diff.row_hash(F.col("a"), F.col("b")).alias("h")).distinct()
    assert hashes.count() == len(rows)
