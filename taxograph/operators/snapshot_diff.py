"""Differences between full snapshots that follow each other, in one aggregation shuffle."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxograph.functions import blank_to_null, kind_letter

#: Snapshot rows are spread over so many parts for the join with the list of snapshots, should that list be too long to broadcast.
SPREAD = 64


def row_hash(*cols: Column) -> Column:
    """64-bit hash of nullable texts; null differs from every text and columns can't run into each other.

    Only hashes of one record in two snapshots are ever compared, so a wrong match has a chance of 2 to the power of -64 a record.
    """
    marked = [F.coalesce(F.concat(F.lit("="), F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cols]
    return F.xxhash64(*marked)


def following(snapshots: DataFrame) -> DataFrame:
    """``(snap_no, next_no, is_first)`` of each snapshot of the table, the last with a null ``next_no``; one row a snapshot."""
    listed = snapshots.filter("snap_no is not null").agg(F.array_sort(F.collect_set("snap_no")).alias("all"))
    pairs = F.arrays_zip(F.col("all").alias("snap_no"), F.slice("all", 2, F.size("all")).alias("next_no"))
    return listed.select(F.posexplode(pairs).alias("at", "x")).select("x.snap_no", "x.next_no", (F.col("at") == 0).alias("is_first"))


def snapshot_changes(snapshots: DataFrame) -> DataFrame:
    """``(snap_no, cl_from, page_id, change)`` for each snapshot after the first against the one before it.

    A snapshot holds one record per key, the row delivered last (a null time counts as earliest; of rows delivered at
    one instant the one with the largest hash). Rows without snapshot number or key are left out; a snapshot all of whose
    rows lack a key is empty. One snapshot, or an empty table, has no changes. A record is changed if its kind letter or its
    sort key without outer blanks differs.

    Every row stands once as the new side of its own snapshot and once as the old side of the next; both sides meet in
    one shuffle by key and snapshot. Time and hash are one number there, so each side's latest record is a plain maximum.
    """
    spread = F.pmod(F.xxhash64("cl_from", "page_id"), F.lit(SPREAD)).cast("int")
    at = F.coalesce(F.unix_micros(F.col("delivered_at").cast("timestamp")), F.lit(-(1 << 62))).cast("decimal(20,0)")
    h = row_hash(kind_letter(F.col("cl_type")), blank_to_null(F.col("cl_sortkey"))).cast("decimal(20,0)") + F.lit(Decimal(1 << 63))
    rec = (at * F.lit(Decimal(1 << 64))).cast("decimal(38,0)") + h
    rows = snapshots.filter("snap_no is not null and cl_from is not null and page_id is not null").select("snap_no", "cl_from", "page_id", spread.alias("spread"), rec.cast("decimal(38,0)").alias("rec"))
    order = following(snapshots).select("*", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread"))
    placed = rows.join(order, ["snap_no", "spread"])
    new = F.struct(F.when(~F.col("is_first"), F.col("snap_no")).alias("snap_no"), F.lit(True).alias("is_new"))
    old = F.struct(F.col("next_no").alias("snap_no"), F.lit(False).alias("is_new"))
    tagged = placed.select(F.explode(F.array(new, old)).alias("at"), "cl_from", "page_id", "rec").select("at.snap_no", "at.is_new", "cl_from", "page_id", "rec").filter("snap_no is not null")
    met = tagged.groupBy("snap_no", "cl_from", "page_id").agg(F.max(F.when(F.col("is_new"), F.col("rec"))).alias("n"), F.max(F.when(~F.col("is_new"), F.col("rec"))).alias("o"))
    hashed = lambda c: F.pmod(F.col(c), F.lit(Decimal(1 << 64)))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(hashed("n") != hashed("o"), "changed")
    return met.select("snap_no", "cl_from", "page_id", change.alias("change")).filter("change is not null")
