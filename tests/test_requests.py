"""List, and, not, fqv and path against a plain-Python queue, on the small dump and on random graphs."""

import random

import pytest
from model import FIXTURE, SEEDS, Model

from taxograph.operators.actions import REQUEST, answer, good_tags
from taxograph.operators.graph import build_graph, categories_among, check_graph, files_among, violations
from taxograph.workspace import Workspace

LINK = "child int, parent int, type string, seq bigint"
SEED = "prio int, cat_id int, depth int, tag int"


def graph_of(spark, links):
    return build_graph(spark.createDataFrame([(c, p, t, i) for i, (c, p, t) in enumerate(links)], LINK))


def run(spark, links, requests, seeds):
    graph = graph_of(spark, links)
    tags = good_tags(Workspace(spark, "tags"), graph, spark.createDataFrame(seeds, SEED))
    found = answer(graph, spark.createDataFrame(requests, REQUEST), tags)
    rows = {}
    for r in found.rows.collect():
        rows.setdefault(r["req_id"], []).append((r["n"], r["id"], r["depth"], r["tag"]))
    rows = {k: [x[1:] for x in sorted(v)] for k, v in rows.items()}
    totals = {r["req_id"]: (r["outof"], r["found"]) for r in found.totals.collect()}
    rejected = {r["req_id"]: r["reason"] for r in found.rejected.collect()}
    return rows, totals, rejected


def test_golden_lines(spark):
    requests = [
        (1, "fqv", 1, None, 15, None, 0, 200), (2, "fqv", 1, None, 0, None, 0, 200), (3, "fqv", 3, None, 15, None, 0, 200), (4, None, 100, 200, None, None, None, None), (5, "not", 100, 200, None, None, None, None),
        (6, "list", 1, None, None, None, None, None), (7, "list", 1, None, 0, None, None, None), (8, "list", 1, None, 1, None, None, None), (9, "list", 100, None, 0, None, None, None), (10, "list", 200, None, None, None, None, None),
        (11, "path", 1, 9, None, None, None, None), (12, "path", 1, 6, 2, None, None, None), (13, "path", 1, 5, None, None, None, None), (14, "path", 1, 6, 1, None, None, None), (15, "path", 1, 100, None, None, None, None),
        (16, "and", 100, 200, None, None, 0, 1), (17, "and", 100, 200, None, None, 1, 1), (18, "and", 100, 200, None, None, 1, 100), (19, "and", 100, 200, None, None, 5, 10), (20, "not", 100, 200, None, None, 0, 1), (21, "not", 100, 200, None, None, 0, 2), (22, "and", 100, 200, None, None, 0, 0),
        (30, "list", None, None, None, None, None, None), (31, "zap", 1, None, None, None, None, None), (32, "path", 1, None, None, None, None, None), (33, "list", 4, None, None, None, None, None), (34, "and", 1, 4, None, None, None, None), (35, "and", 1, 99999999, None, None, None, None),
    ]
    rows, totals, rejected = run(spark, FIXTURE, requests, SEEDS)
    assert rows[1] == [(5, 0, 1), (4, 0, 1), (7, 1, 3), (8, 1, 4)] and totals[1][0] == 4
    assert rows[2] == [(5, 0, 1), (4, 0, 1)] and totals[2][0] == 2
    assert rows[3] == [(8, 0, 4)] and totals[3][0] == 1
    assert rows[4] == [(101, 0, 0), (104, 2, 0)] and totals[4][0] == 2
    assert rows[5] == [(102, 0, 0), (103, 1, 0)] and totals[5][0] == 2
    assert [r[:2] for r in rows[6]] == [(5, 0), (4, 0), (7, 1), (8, 1), (9, 2)] and totals[6][0] == 5
    assert [r[:2] for r in rows[7]] == [(2, 0), (3, 0), (5, 0), (4, 0)]
    assert [r[:2] for r in rows[8]] == [(5, 0), (4, 0), (6, 1), (7, 1), (8, 1)]
    assert [r[:2] for r in rows[9]] == [(110, 0), (120, 0), (102, 0), (101, 0)]
    assert [r[:2] for r in rows[10]] == [(202, 0), (101, 0), (203, 1), (104, 1)]
    assert rows[11] == rows[12] == [(1, 1, 0), (2, 2, 0), (6, 3, 0)] and rows[13] == [(1, 1, 0)]
    assert 14 not in rows and totals[14] == (None, False) and totals[15] == (None, False) and totals[11] == (None, True)
    assert [totals[k][0] for k in (16, 17, 18, 19, 20, 21)] == [4, 2, 1, -3, None, 4] and rows[22] == [(101, 0, 0)]
    assert set(rejected) == {30, 31, 32, 33, 34, 35}


def random_case(rnd):
    n = rnd.randint(3, 9)
    cats, files = list(range(1, n + 1)), list(range(20, 30))
    links = []
    for p in sorted(rnd.sample(cats, rnd.randint(2, n))):
        for _ in range(rnd.randint(0, 5)):
            links.append((rnd.choice(cats), p, "s") if rnd.random() < 0.5 else (rnd.choice(files), p, "f"))
    links.append((rnd.choice(files), rnd.choice([25, 40]) if rnd.random() < 0.5 else 50, "f"))
    links = [x for x in links if not (x[2] == "f" and any(x[0] in (y[1], y[0] if y[2] == "s" else 0) for y in links))]
    return links


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    links = []
    for at in range(6):  # six graphs that share no id
        links += [(c + 100 * at, p + 100 * at, t) for c, p, t in random_case(rnd)]
    model = Model(links)
    cats = sorted(c for c in model.cats if c < model.limit)
    seeds = [(k + 1, rnd.choice(cats), rnd.randint(-1, 2), rnd.randint(1, 4)) for k in range(5)]
    tags = model.tags(seeds)
    requests = []
    for k in range(160):
        a = rnd.choice(["list", "and", "not", "fqv", "path"])
        c1 = rnd.choice(cats)
        near = [c for c in cats if c // 100 == c1 // 100 and c != c1] or [c1]
        c2 = rnd.choice(near + ([f for p in near for f in model.files[p] if f < model.limit] if a == "path" else []))
        requests.append((k, a, c1, c2, rnd.randint(-1, 3), rnd.randint(-1, 3), rnd.choice([0, 0, 1, 2, 5]), rnd.choice([0, 1, 2, 3, 100])))
    rows, totals, rejected = run(spark, links, requests, seeds)
    for q in requests:
        k, a, c1, c2, d1, d2, o, s = q
        if k in rejected:
            assert a == "path" and c1 == c2 or c2 not in model.cats
            continue
        if a == "path":
            want = model.path(c1, c2, d1)
            assert [r[0] for r in rows.get(k, [])] == (want or []), q
            assert totals[k] == (None, want is not None), q
        else:
            want, outof = model.request(a, c1, c2, d1, d2, o, s, tags)
            assert rows.get(k, []) == want, (q, links)
            assert totals[k][0] == outof, q


def test_graph_rules(spark):
    links = [(5, 2, "File", 0), (6, 2, " subcat", 1), (5, 1, "f", 2), (7, 2, "page", 3), (8, 2, "f", 4), (9, 0, "f", 5), (0, 2, "f", 6), (4, 3, None, 7), (None, 3, "f", 8)]
    df = spark.createDataFrame(links, LINK)
    merged = build_graph(df)
    assert merged.limit == 4 and sorted(map(tuple, merged.files.collect())) == [(1, 5), (2, 5), (2, 8)]
    assert sorted(map(tuple, merged.subcats.collect())) == [(2, 1, 6)]
    assert sorted(map(tuple, merged.categories.collect())) == [(1, True), (2, True), (3, True), (6, False)]
    strict = build_graph(df, strict=True)
    assert sorted(map(tuple, strict.files.collect())) == [(1, 5), (2, 8)] and strict.subcats.count() == 0
    assert {r["rule"]: r["n"] for r in violations(merged).collect()} == {"file is a category": 0, "subcategory is no category": 0, "file beyond the last category": 3}
    ids = spark.createDataFrame([(None,), (-1,), (0,), (1,), (3,), (6,), (99,)], "id int")
    assert sorted(r["id"] for r in categories_among(merged, ids).collect()) == [1, 3] and [r["id"] for r in files_among(merged, ids).collect()] == [0]
    assert check_graph(merged) is merged
    with pytest.raises(ValueError):
        check_graph(build_graph(spark.createDataFrame([(2, 1, "s", 0), (2, 3, "f", 1)], LINK)))
    empty = build_graph(df.limit(0))
    assert empty.limit == 1 and empty.categories.count() == 0
