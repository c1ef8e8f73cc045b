"""Sizes of the overlap between many large sets, from counts of membership signatures. SQL only.

Every step is a SQL text over named inputs. Joins on a set are spread by a hash of the other side's row over ``SPREAD`` parts, so a set
that holds a third of all members is no hot key; joins on a signature meet a signature's sets one row each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taxograph.workspace import Workspace

#: Parts over which the members of a set, or the signatures that hold it, are spread in a join.
SPREAD = 32

PAIRS = """select c_low, c_high from (select cast(least(a, b) as int) as c_low, cast(greatest(a, b) as int) as c_high from {asked} where a > 0 and b > 0 and a <> b)
group by c_low, c_high"""
#: The asked-for sets that hold an id, sorted; equal lists are counted, and named by two hashes. (Rows repeated ``SPREAD`` times are never broadcast.)
SIGNATURES = """select signature, xxhash64(signature) as s1, xxhash64(reverse(signature), size(signature)) as s2, count(*) as weight from (
  select /*+ SHUFFLE_HASH(w) */ l.id, array_sort(collect_set(l.set_id)) as signature from (select id, set_id, pmod(xxhash64(id), SPREAD) as part from {links} where id is not null) l
  left semi join (select set_id, part from (select c_low as set_id from {pairs} union select c_high from {pairs}) lateral view explode(sequence(0, SPREAD - 1)) as part) w
  on l.set_id = w.set_id and l.part = w.part group by l.id)
group by signature"""
#: A row for each set of each signature.
SETS = """select s1, s2, weight, width, set_id from (select *, size(signature) as width from {signatures}) lateral view explode(signature) as set_id"""
SIZES = "select set_id, sum(weight) as n from {sets} group by set_id"
LARGE = """select p.c_low, p.c_high, coalesce(a.n, 0) as n_low, coalesce(b.n, 0) as n_high from {pairs} p
left join {sizes} a on a.set_id = p.c_low left join {sizes} b on b.set_id = p.c_high where least(coalesce(a.n, 0), coalesce(b.n, 0)) >= LEAST_SIZE"""
#: Each pair stands at the side that is in fewer pairs, so a set that is in very many pairs expands into none of them.
POINTERS = """select case when d.n <= e.n then c_low else c_high end as set_id, case when d.n <= e.n then c_high else c_low end as other, part from {pairs} p
join {degrees} d on d.set_id = p.c_low join {degrees} e on e.set_id = p.c_high lateral view explode(sequence(0, SPREAD - 1)) as part"""
DEGREES = "select set_id, count(*) as n from (select c_low as set_id from {pairs} union all select c_high from {pairs}) group by set_id"
#: A signature expands into the asked-for pairs of its sets; those whose other side it holds too are pairs of its members.
EXPANDED = """select x.set_id, x.other, sum(x.weight) as shared from (
  select /*+ SHUFFLE_HASH(p) */ s.s1, s.s2, s.weight, s.set_id, p.other from (select *, cast(pmod(s1, SPREAD) as int) as part from {sets} where width > 1) s
  join {pointers} p on p.set_id = s.set_id and p.part = s.part) x
left semi join {sets} y on y.s1 = x.s1 and y.s2 = x.s2 and y.set_id = x.other group by x.set_id, x.other"""
OVERLAPS = """select p.c_low, p.c_high, p.n_low, p.n_high, coalesce(s.shared, 0) as shared from {pairs} p
left join {expanded} s on least(s.set_id, s.other) = p.c_low and greatest(s.set_id, s.other) = p.c_high"""


def overlaps(spark: SparkSession, links: DataFrame, asked: DataFrame, min_size: int = 0, spread: int = SPREAD) -> DataFrame:
    """``(c_low, c_high, n_low, n_high, shared)``: sizes of two sets and of their overlap, for each pair asked for.

    ``links`` has ``(id, set_id)``, repeats allowed; ``asked`` has ``(a, b)`` in either order. Pairs with a null, an id
    below 1 or twice the same id are left out. A set without members has size 0. With ``min_size``, pairs with a smaller
    side have no row and nothing is expanded for them.

    Each id becomes the sorted list of the asked-for sets that hold it; equal lists are counted, and each distinct list
    is expanded into its asked-for pairs, weighted by its count. The counts are exact. A list is never expanded into all of its
    pairs, so lists of every length go the same way: the work for one is its length times the pairs that point from a set,
    which are at most the root of twice the number of pairs.
    """
    ws = Workspace(spark, "overlap")

    def sql(text: str, **names: DataFrame) -> DataFrame:
        return spark.sql(text.replace("SPREAD", str(int(spread))).replace("LEAST_SIZE", str(int(min_size))), **names)

    pairs = ws.write(sql(PAIRS, asked=asked), "pairs")
    signatures = ws.write(sql(SIGNATURES, links=links, pairs=pairs), "signatures")
    sets = ws.write(sql(SETS, signatures=signatures), "sets")
    large = ws.write(sql(LARGE, pairs=pairs, sizes=sql(SIZES, sets=sets)), "large")
    pointers = sql(POINTERS, pairs=large, degrees=sql(DEGREES, pairs=large))
    return sql(OVERLAPS, pairs=large, expanded=sql(EXPANDED, sets=sets, pointers=pointers))
