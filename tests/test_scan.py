"""Scans of requests inside tasks: what they write, and long, sparse and unsound listings against the plain-Python queue."""

import random
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from model import Model
from pyspark.sql import functions as F
from test_requests import SEED, graph_of, random_case

from taxograph.operators import scan
from taxograph.operators.actions import REQUEST, answer, good_tags
from taxograph.operators.graph import build_graph
from taxograph.workspace import Workspace


def test_no_table_of_combinations(spark):
    """40 combinations of a listing of 2,000 files: pages and totals come without a table of 80,000 rows."""
    links = [(c, 1, "s") for c in range(2, 42)] + [(1000 + f, 1, "f") for f in range(2000)] + [(1000 + c, c, "f") for c in range(2, 42)] + [(5000, 5000, "x")]
    requests = [(c, "not", 1, c, None, None, 0, 10) for c in range(2, 42)]
    graph = graph_of(spark, links)
    with Workspace(spark, "scan") as ws:
        tags = good_tags(ws, graph, spark.createDataFrame([(1, 2, -1, 3)], SEED))
        found = answer(graph, spark.createDataFrame(requests, REQUEST), tags, workspace=ws)
        rows, totals = found.rows.collect(), found.totals.collect()
        written = sum(pq.ParquetFile(p).metadata.num_rows for p in Path(ws.path.removeprefix("file:")).rglob("*.parquet"))
    assert len(rows) == 400 and {r["outof"] for r in totals} == {10 * 2000 // 9}
    assert written <= 100


@pytest.mark.parametrize("seed", range(3))
def test_scans_in_steps(spark, seed, monkeypatch):
    """In steps of three rows, with pairs of which one listing is far smaller, against the model."""
    monkeypatch.setattr(scan, "STEP", 3)
    monkeypatch.setattr(scan, "KEPT_BYTES", 4000)
    rnd = random.Random(seed)
    links = []
    for at in range(8):
        links += [(c + 100 * at, p + 100 * at, t) for c, p, t in random_case(rnd)]
    top = 901  # a category above others, with many files of its own and files of theirs
    files = sorted({c for c, _, t in links if t == "f"})
    links += [(p, top, "s") for p in sorted({p for _, p, _ in links}) if rnd.random() < 0.5]
    links += [(f, top, "f") for f in rnd.sample(files, len(files) // 2)] + [(2000 + f, top, "f") for f in range(60)] + [(3000, 3000, "x")]
    model = Model(links)
    cats = sorted(c for c in model.cats if c < model.limit)
    seeds = [(k + 1, rnd.choice(cats), rnd.randint(-1, 2), rnd.randint(1, 4)) for k in range(5)]
    tags = model.tags(seeds)
    graph = graph_of(spark, links)
    with Workspace(spark, "scan") as ws:
        good_tags(ws, graph, spark.createDataFrame(seeds, SEED))
        arrays = scan.Graph(graph.arrays())
        arrays.load_tags(f"{ws.path}/tags")
        requests = []
        for k in range(2000):
            c1, c2 = (top if rnd.random() < 0.4 else rnd.choice(cats) for _ in range(2))
            requests.append((k, rnd.choice(["list", "and", "not", "fqv"]), c1, c2, rnd.randint(-1, 3), rnd.randint(-1, 3), rnd.choice([0, 0, 1, 5, -2]), rnd.choice([0, 1, 3, 20, 100])))
        scanner = scan.Scanner(arrays, True)
        for q in sorted(requests, key=lambda q: (q[2], q[3])):
            _, a, c1, c2, d1, d2, o, s = q
            ((_, places, depths, of, one, _, outof, *_),) = scanner.answers([q])
            ids, depth, _ = one.at(places)
            tag = arrays.tags_of(ids)[1] if of is None else of
            got = list(zip(ids.tolist(), (depth if depths is None else depth + depths).tolist(), tag.tolist(), strict=True))
            if o < 0:  # the model counts from the first row on
                assert len(got) <= max(o + s, 1) and len({x[0] for x in got}) == len(got)
                continue
            assert (got, outof) == model.request(a, c1, c2, d1, d2, o, s, tags), q


def test_ids_that_are_both(spark):
    """A file that is a category as well counts as seen in either role, with the smaller depth."""
    links = [(2, 1, "s"), (3, 1, "s"), (4, 2, "s"), (4, 3, "f"), (9, 3, "f"), (9, 4, "f"), (10, 10, "x")]
    requests = [(1, "and", 3, 2, -1, -1, 0, 9), (2, "not", 3, 2, -1, -1, 0, 9), (3, "and", 3, 2, -1, 0, 0, 9)]
    graph = graph_of(spark, links)
    tags = good_tags(Workspace(spark, "tags"), graph, spark.createDataFrame([(1, 3, 0, 2)], SEED))
    found = answer(graph, spark.createDataFrame(requests, REQUEST), tags)
    got = sorted((r["req_id"], r["n"], r["id"], r["depth"], r["tag"]) for r in found.rows.collect())
    assert got == [(1, 1, 9, 1, 2), (1, 2, 4, 0, 2), (3, 1, 4, 0, 2)]


def test_pages_of_any_size(spark):
    """Pages beyond one batch, and many requests for the same combination in several tasks; every place comes once."""
    links = spark.range(70_000).selectExpr("cast(id + 10 as int) as child", "1 as parent", "'f' as type", "id as seq").union(spark.sql("select 3, 80100, 'f', 99999"))
    graph = build_graph(links)
    requests = [(k, "list", 1, 1, -1, -1, 0, 1 << 30) for k in range(2)] + [(k, "and", 1, 1, -1, -1, 7 * k, 5) for k in range(2, 1200)]
    with Workspace(spark, "scan") as ws:
        tags = good_tags(ws, graph, spark.createDataFrame([], SEED))
        found = answer(graph, spark.createDataFrame(requests, REQUEST), tags, workspace=ws)
        assert found.rows.rdd.getNumPartitions() == 3
        got = found.rows.groupBy("req_id").agg(F.count("*").alias("n"), F.sum(F.col("id") + F.col("n")).alias("x"), F.max("n").alias("most")).collect()
    first = 70_009  # files of a category come by id downwards
    want = {k: (70_000, 70_000 * (first + 1), 70_000) for k in range(2)} | {k: (5, 5 * (first + 1 - 7 * k), 5) for k in range(2, 1200)}
    assert {r["req_id"]: (r["n"], r["x"], r["most"]) for r in got} == want


class Counted(np.ndarray):
    """An array that counts what is looked for in it."""

    looks = 0

    def searchsorted(self, v, *args, **kwargs):
        Counted.looks += np.size(v)
        return np.asarray(self).searchsorted(v, *args, **kwargs)


def test_paths_do_not_search_all_categories_again(spark):
    """1,000 paths below 400 categories: in few of them is each category looked at; all are those of a plain queue."""
    rnd = random.Random(4)
    parent = {c: rnd.choice([1, *range(2, c)][-30:]) for c in range(2, 402)}
    files = [(1000 + f, c) for f in range(600) for c in rnd.sample(range(1, 402), 2)] + [(5000, 500)]
    links = [(c, p, "s") for c, p in parent.items()] + [(f, c, "f") for f, c in files] + [(9000, 9000, "x")]
    graph = graph_of(spark, links)  # its tables go with it
    arrays = scan.Graph(graph.arrays())
    arrays.keys = arrays.keys.view(Counted)
    order = [1]
    for c in order:
        order += arrays.below(c)[0]
    place, depth = {c: k for k, c in enumerate(order)}, {1: 0}
    for c in order[1:]:
        depth[c] = depth[parent[c]] + 1
    scanner, Counted.looks = scan.Scanner(arrays, True), 0
    for k in range(1000):
        goal, bound = rnd.choice([*range(1000, 1603), 5000]), rnd.choice([-1, -1, 3, 8])
        held = sorted((place[c], c) for f, c in files if f == goal and c in place)
        want = None
        if held and (bound < 0 or depth[held[0][1]] <= bound):
            want = [held[0][1]]
            while want[0] != 1:
                want.insert(0, parent[want[0]])
        assert scanner.path(1, goal, bound) == want, (goal, bound)
    assert Counted.looks < 20_000
