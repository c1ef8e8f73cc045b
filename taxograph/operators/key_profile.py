"""Per-key counts where a few keys hold most rows: a tree of partial aggregates.

The rows of each input split are taken in chunks of a fixed size. A chunk is counted where it lies, and only its states
travel: they meet in rounds of a small fan-in, so no task ever receives all partial states of a key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 16
FAN_IN = 4
#: A chunk keeps the keys that hold this part of the share looked for; more of it means fewer keys to count again.
SLACK = 4
#: Keys with about this share of the rows are merged in rounds by ``key_profiles``, all others at once.
HOT_SHARE = 500


def merge_rounds(chunks: int, fan_in: int = FAN_IN) -> int:
    """Rounds until one state of so many is left."""
    rounds = 0
    while chunks > 1:
        chunks, rounds = math.ceil(chunks / fan_in), rounds + 1
    return rounds


def tree_merge(states: DataFrame, keys: list[str], sums: list[str], chunks: int, fan_in: int = FAN_IN) -> DataFrame:
    """Merge the partial sums of each key, held per ``chunk``, in rounds of at most ``fan_in`` states a reducer row.

    A key has at most ``chunks`` states; round r brings ``fan_in`` neighbouring chunks together, so after
    ``merge_rounds`` rounds one state is left.
    """
    for _ in range(merge_rounds(chunks, fan_in)):
        states = states.withColumn("chunk", F.floor(F.col("chunk") / fan_in)).groupBy(*keys, "chunk").agg(*(F.sum(c).alias(c) for c in sums))
    return states.select(*keys, *sums)


def chunk_layout(rows: DataFrame, chunk_rows: int = CHUNK_ROWS) -> tuple[int, int, int]:
    """(rows, chunks of the largest input split, chunks of all): read from row counts alone, no column is read."""
    sizes = rows.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    r = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.max("n").alias("most"), F.max("p").alias("last")).first()
    if not r["total"]:
        return 0, 1, 1
    each = math.ceil(r["most"] / chunk_rows)
    return r["total"], each, each * (r["last"] + 1)


def _chunk_states(chunk_rows: int, each: int, least: int, batches: Iterator) -> Iterator:
    """Of record batches (l, r): for each chunk and side, the keys that hold a ``least``-th of the chunk's rows or more."""
    import pyarrow as pa
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() * each
    held: list = []
    block = size = 0

    def states(table):
        import numpy as np

        for side, name in enumerate(("l", "r")):
            column = table.column(name).drop_null().to_numpy()
            keys, counts = np.unique(column[column > 0], return_counts=True)
            kept = counts * least >= table.num_rows
            n = int(kept.sum())
            columns = [np.full(n, side, "int32"), keys[kept], np.full(n, first + min(block, each - 1), "int64"), counts[kept].astype("int64"), np.full(n, table.num_rows, "int64")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["side", "key_id", "chunk", "n", "seen"])

    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, chunk_rows - size)
            batch = batch.slice(part.num_rows)
            held.append(part)
            size += part.num_rows
            if size == chunk_rows:
                yield from states(pa.Table.from_batches(held))
                held, size, block = [], 0, block + 1
    if held:
        yield from states(pa.Table.from_batches(held))


def frequent_keys(links: DataFrame, left: str, right: str, share: int, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> tuple[int, DataFrame]:
    """The number of rows, and ``(side, key_id, n, seen)`` of all keys > 0 that may stand in a ``share``-th of them (side 0: left).

    ``n`` is the key's number of rows in the chunks that kept it, and ``seen`` how many rows those chunks have. A chunk drops a
    key with less than a ``share * SLACK``-th of its rows, so at most that much of the other rows is the key's. The result
    has at most ``share * SLACK / (SLACK - 1)`` keys a side.
    """
    total, each, chunks = chunk_layout(links, chunk_rows)
    pairs = links.select(F.col(left).cast("long").alias("l"), F.col(right).cast("long").alias("r"))
    states = pairs.mapInArrow(lambda batches: _chunk_states(chunk_rows, each, share * SLACK, batches), "side int, key_id bigint, chunk bigint, n bigint, seen bigint")
    merged = tree_merge(states, ["side", "key_id"], ["n", "seen"], chunks, fan_in)
    return total, merged.filter(F.col("n") * share * SLACK + total - F.col("seen") >= total * SLACK)


def heavy_keys(links: DataFrame, left: str = "page_id", right: str = "cl_from", share: int = 50, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """``(side, key_id)`` of the ids > 0 that stand in at least one ``share``-th of all rows of the table.

    Repeated and invalid rows count on both sides of the division; an empty table has no such id. Keys that the merged states
    leave open (between the rows counted and the most they can be) are counted exactly, in the same tree of chunks.
    """
    spark = links.sparkSession
    total, found = frequent_keys(links, left, right, share, chunk_rows, fan_in)
    listed = found.collect()  # bounded, see frequent_keys
    sure = [(r["side"], r["key_id"]) for r in listed if r["n"] * share >= total]
    names = F.when(F.col("side") == 0, left).otherwise(right).alias("side")
    out = spark.createDataFrame(sure, "side int, key_id bigint").select(names, "key_id")
    for side, column in enumerate((left, right)):
        open_keys = [r["key_id"] for r in listed if r["side"] == side and r["n"] * share < total]
        if open_keys:
            _, each, chunks = chunk_layout(links, chunk_rows)
            block = F.least(F.floor(F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) / chunk_rows), F.lit(each - 1))
            kept = links.select(F.col(column).cast("long").alias("key_id")).filter(F.col("key_id").isin(open_keys))
            rows = kept.select("key_id", (F.spark_partition_id() * each + block).alias("chunk"))
            counts = tree_merge(rows.select("key_id", F.floor(F.col("chunk") / fan_in).alias("chunk")).groupBy("key_id", "chunk").agg(F.count(F.lit(1)).alias("n")), ["key_id"], ["n"], math.ceil(chunks / fan_in), fan_in)
            out = out.union(counts.filter(F.col("n") * share >= total).select(F.lit(column), "key_id"))
    return out


def key_profiles(links: DataFrame, left: str = "page_id", right: str = "cl_from", chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN, hot_share: int = HOT_SHARE) -> DataFrame:
    """``(side, key_id, n_rows, n_partners)`` for every id > 0 of either column.

    ``n_rows`` counts all rows of the key, repeated and invalid ones included; ``n_partners`` the distinct ids > 0
    beside it. Null, zero and negative keys have no row; an empty table gives none. Other columns are not read.

    Repeated rows collapse first, keyed by the whole pair, which no hot key can skew. Distinct partners that lie in different
    tasks then add up: the states of hot keys (found by ``frequent_keys``, a bounded number) meet in rounds, those of all
    others, with few rows each, at once.
    """
    _, found = frequent_keys(links, left, right, hot_share, chunk_rows, fan_in)
    hot = [[r["key_id"] for r in found.collect() if r["side"] == side] for side in (0, 1)]
    pairs = links.select(F.col(left).cast("long").alias("l"), F.col(right).cast("long").alias("r")).groupBy("l", "r").agg(F.count(F.lit(1)).alias("n"))

    def side(name: str, key: str, partner: str, keys: list[int]):
        return F.struct(F.lit(name).alias("side"), F.col(key).alias("key_id"), F.coalesce(F.col(key).isin(keys), F.lit(False)).alias("hot"), F.when(F.col(partner) > 0, 1).otherwise(0).cast("long").alias("n_partners"))

    sides = pairs.select("n", F.explode(F.array(side(left, "l", "r", hot[0]), side(right, "r", "l", hot[1]))).alias("x")).select("x.*", F.col("n").alias("n_rows")).filter("key_id > 0")
    keys, sums = ["side", "key_id"], ["n_rows", "n_partners"]
    added = [F.sum(c).alias(c) for c in sums]
    cold = sides.filter(~F.col("hot")).groupBy(*keys).agg(*added)
    tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    states = sides.filter("hot").select(*keys, *sums, F.floor(F.spark_partition_id() / fan_in).alias("chunk")).groupBy(*keys, "chunk").agg(*added)
    return cold.unionByName(tree_merge(states, keys, sums, math.ceil(tasks / fan_in), fan_in))
