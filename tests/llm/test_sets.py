"""Set overlaps and distinct-count bitmaps against exact counts."""

import random
from collections import defaultdict

import pytest

from taxograph.llm import distinct_sketch as S
from taxograph.llm.overlap import overlaps
from taxograph.workspace import Workspace


@pytest.mark.parametrize("spread", [1, 3, 32])
def test_overlaps(spark, spread):
    rnd = random.Random(spread)
    links = [(rnd.choice([None, *range(1, 30)]), rnd.choice([None, *range(1, 9)])) for _ in range(150)] + [(500, s) for s in range(1, 9)] * 2
    asked = [(rnd.choice([None, -1, 0, *range(1, 10)]), rnd.choice([None, *range(1, 10)])) for _ in range(60)]
    sets = defaultdict(set)
    for i, s in links:
        if i is not None and s is not None:
            sets[s].add(i)
    want = {}
    for a, b in asked:
        if a and b and a > 0 and b > 0 and a != b:
            x, y = sets[min(a, b)], sets[max(a, b)]
            want[min(a, b), max(a, b)] = (len(x), len(y), len(x & y))
    args = (spark.createDataFrame(links, "id int, set_id int"), spark.createDataFrame(asked, "a int, b int"))
    got = {(r["c_low"], r["c_high"]): (r["n_low"], r["n_high"], r["shared"]) for r in overlaps(spark, *args, spread=spread).collect()}
    assert got == want
    large = {tuple(r)[:2] for r in overlaps(spark, *args, min_size=12, spread=spread).collect()}
    assert large == {k for k, v in want.items() if min(v[:2]) >= 12}


def test_an_id_in_very_many_sets(spark):
    links = spark.range(3000).selectExpr("1 as id", "cast(id + 1 as int) as set_id").union(spark.range(1, 3000, 3).selectExpr("2 as id", "cast(id as int)"))
    asked = spark.range(2, 2500).selectExpr("1 as a", "cast(id as int) as b").union(spark.createDataFrame([(7, 10), (8, 9), (9000, 4)], "a int, b int"))
    before = {t.name for t in spark.catalog.listTables()}
    got = {(r["c_low"], r["c_high"]): (r["n_low"], r["n_high"], r["shared"]) for r in overlaps(spark, links, asked).collect()}
    want = {(1, b): (2, 1 + (b % 3 == 1), 1 + (b % 3 == 1)) for b in range(2, 2500)} | {(7, 10): (2, 2, 2), (8, 9): (1, 1, 1), (4, 9000): (2, 0, 0)}
    assert got == want and {t.name for t in spark.catalog.listTables()} == before


def test_overlaps_of_nothing(spark):
    none = spark.createDataFrame([], "id int, set_id int")
    asked = spark.createDataFrame([(2, 1)], "a int, b int")
    assert [tuple(r) for r in overlaps(spark, none, asked).collect()] == [(1, 2, 0, 0, 0)]
    assert overlaps(spark, none, asked.limit(0)).collect() == []


def test_estimates_and_merging(spark):
    sizes = [1, 5, 100, 3000, 40_000, 300_000]
    rows = spark.range(0).selectExpr("cast(0 as int) as g", "id")
    for g, n in enumerate(sizes):
        rows = rows.union(spark.range(n).selectExpr(f"{g} as g", f"id * 7 + {g} * 1000003 as id"))
    rows = rows.union(rows.filter("g < 3"))  # repeated rows
    state = S.states(rows, ["g"], "id")
    got = {r["g"]: (r["n_rows"], r["n_distinct"]) for r in S.estimates(state, ["g"]).collect()}
    for g, n in enumerate(sizes):
        assert got[g][0] == n * (2 if g < 3 else 1)
        assert abs(got[g][1] - n) <= max(2, 4 * S.STANDARD_ERROR * n)
    assert state.groupBy("g").count().agg({"count": "max"}).first()[0] <= S.SLICES * S.BITS // 64
    whole = S.estimates(S.states(rows.selectExpr("0 as all", "id"), ["all"], "id"), ["all"]).first()
    merged = S.estimates(S.merge(state.selectExpr("0 as all", "slice", "word", "bits", "n_rows"), ["all"]), ["all"]).first()
    assert whole == merged


def test_error_of_many_estimates(spark):
    sizes = [int(50 * 1.05**k) for k in range(160)]  # 50 to about 120,000
    rows = spark.createDataFrame(list(enumerate(sizes)), "g int, n int").selectExpr("g", "n", "explode(sequence(1, n)) as k").selectExpr("g", "xxhash64(g, k) as id")
    got = {r["g"]: r["n_distinct"] for r in S.estimates(S.states(rows, ["g"], "id"), ["g"]).collect()}
    errors = [got[g] / n - 1 for g, n in enumerate(sizes)]
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 <= S.STANDARD_ERROR and max(map(abs, errors)) <= 4 * S.STANDARD_ERROR
    assert abs(sum(errors) / len(errors)) <= 0.01


def test_states_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(1, None), (1, None), (2, 5)], "g int, id int")
    assert {tuple(r) for r in S.estimates(S.states(rows, ["g"], "id"), ["g"]).collect()} == {(1, 2, 0.0), (2, 1, 1.0)}
    assert S.estimates(S.states(rows.limit(0), ["g"], "id"), ["g"]).collect() == []


def test_repeated_groups(spark):
    rnd = random.Random(3)
    rows = []
    for g in range(1, 40):
        n, u = rnd.randint(15, 200), rnd.randint(5, 120)
        rows += [(g, rnd.choice([None, *range(u)])) for _ in range(n)]
    rows += [(None, 1)] * 50
    own = defaultdict(list)
    for g, i in rows:
        own[g].append(i)
    want = {g for g, ids in own.items() if g and len(ids) >= 20 and 2 * len(set(ids) - {None}) < len(ids)}
    got = S.repeated_groups(spark.createDataFrame(rows, "g int, id int"), ["g"], "id", 20, Workspace(spark, "test"))
    assert [r["g"] for r in got.orderBy("g").collect()] == sorted(want)
    judged = S.judged_groups(spark.createDataFrame(rows, "g int, id int").dropna(subset=["g"]), ["g"], "id", 20).collect()
    assert {r["g"] for r in judged if r["sure"]} <= want <= {r["g"] for r in judged}
