"""Two-pass ranks against a plain sort, with one group that holds most rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from taxograph.operators.ranking import ranked
from taxograph.workspace import Workspace


def test_ranked(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 1, 1, 1, 2, 3, None]), rnd.choice([None, *range(5000)]), "x") for _ in range(6000)]
    df = spark.createDataFrame(rows, "k int, v int, range_rows string")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    with Workspace(spark, "test") as ws:
        got = ranked(ws, df.filter("k is not null").select("k", "v"), ["k"], [F.desc("v")], "r", "n", "total").collect()
        parts = ws.read(["r"], ws.spark.read.parquet(f"{ws.path}/r").schema).filter("k = 1").select("range_part").distinct().count()
        assert ranked(ws, df.limit(0).select("k", "v"), ["k"], [F.col("v")], "none").collect() == []
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    own = defaultdict(list)
    for k, v, _ in rows:
        if k is not None:
            own[k].append(v)
    assert parts > 2 and len(got) == sum(map(len, own.values()))
    for k, values in own.items():
        found = sorted((r["n"], r["v"]) for r in got if r["k"] == k)
        assert [n for n, _ in found] == list(range(1, len(values) + 1)) and {r["total"] for r in got if r["k"] == k} == {len(values)}
        assert [v for _, v in found] == sorted(values, key=lambda v: -1 if v is None else v, reverse=True)
