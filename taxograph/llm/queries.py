"""Queries of the operators for training corpora, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxograph.functions import kind_letter
from taxograph.llm import distinct_sketch as S
from taxograph.llm.leakage import decontaminate, leaks
from taxograph.llm.overlap import overlaps
from taxograph.llm.subjects import subjects
from taxograph.llm.tokenizer import encode_corpus, same_ids, vocabulary_path
from taxograph.sources import table
from taxograph.workspace import Workspace


#: The files and categories of the file rows, and the pairs of the request log.
FILES = r"""select cl_from as id, page_id as set_id from {links} where cl_from > 0 and page_id > 0 and lower(substr(regexp_replace(cl_type, r'^\s+', ''), 1, 1)) = 'f'"""
ASKED = "select c1 as a, c2 as b from {requests}"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(ASKED, requests=table(spark, d, "workitem"))


def _overlaps(spark: SparkSession, d: str, min_size: int = 0) -> DataFrame:
    return overlaps(spark, spark.sql(FILES, links=table(spark, d, "categorylinks")), _asked(spark, d), min_size)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("select c_low, c_high from {found} where shared * 10 >= 3 * least(n_low, n_high)", found=_overlaps(spark, d, 50))


def p2_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(spark, d)


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """(link_day, page_id, cl_from) of the link rows of any kind; rows without a timestamp have a null day."""
    links = table(spark, d, "categorylinks").filter((F.col("cl_from") > 0) & (F.col("page_id") > 0))
    return links.select(F.date_format("cl_timestamp", "yyyy-MM-dd").alias("link_day"), "page_id", "cl_from")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return S.repeated_groups(_dated(spark, d), ["link_day", "page_id"], "cl_from", 20, Workspace(spark, "repeated"))


def p5_day_category(spark: SparkSession, d: str) -> DataFrame:
    return S.estimates(S.states(_dated(spark, d).filter("link_day is not null"), ["link_day", "page_id"], "cl_from"), ["link_day", "page_id"])


def p5_days(spark: SparkSession, d: str) -> DataFrame:
    return S.estimates(S.states(_dated(spark, d).filter("link_day is not null"), ["link_day"], "cl_from"), ["link_day"])


def p5_categories(spark: SparkSession, d: str) -> DataFrame:
    return S.estimates(S.states(_dated(spark, d), ["page_id"], "cl_from"), ["page_id"])


def p5_unions(spark: SparkSession, d: str) -> DataFrame:
    """Children under either category of each pair that was asked for, from the merged states of both."""
    state = S.states(_dated(spark, d), ["page_id"], "cl_from")
    asked = _asked(spark, d).filter("a > 0 and b > 0 and a <> b").select(F.least("a", "b").alias("c_low"), F.greatest("a", "b").alias("c_high")).distinct()
    sides = asked.select("c_low", "c_high", F.explode(F.array("c_low", "c_high")).alias("page_id"))
    return S.estimates(S.merge(state.join(sides, "page_id"), ["c_low", "c_high"]), ["c_low", "c_high"])


def p5_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Of the groups of the four queries before: how many there are, and how many estimates lie outside of four standard errors and
    three identifiers of the exact count."""
    dated = _dated(spark, d)
    asked = _asked(spark, d).filter("a > 0 and b > 0 and a <> b").select(F.least("a", "b").alias("c_low"), F.greatest("a", "b").alias("c_high")).distinct()
    sides = asked.select("c_low", "c_high", F.explode(F.array("c_low", "c_high")).alias("page_id"))
    out = None
    for what, keys, rows, estimated in (
        ("day and category", ["link_day", "page_id"], dated.filter("link_day is not null"), p5_day_category),
        ("day", ["link_day"], dated.filter("link_day is not null"), p5_days),
        ("category", ["page_id"], dated, p5_categories),
        ("pair of categories", ["c_low", "c_high"], dated.select("page_id", "cl_from").distinct().join(sides, "page_id"), p5_unions),
    ):
        exact = rows.select(*keys, "cl_from").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("exact"))
        far = F.abs(F.col("n_distinct") - F.col("exact")) > 4 * S.STANDARD_ERROR * F.col("exact") + 3
        part = exact.join(estimated(spark, d), keys, "left").agg(F.count(F.lit(1)).alias("n_groups"), F.count(F.when(far | F.col("n_distinct").isNull(), 1)).alias("n_outside"))
        part = part.select(F.lit(what).alias("what"), "*")
        out = part if out is None else out.union(part)
    return out


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents"), vocabulary_path("byte_bpe_50k"), Workspace(spark, "encode"))


def p6_joined(spark: SparkSession, d: str) -> DataFrame:
    """All documents in parts of 500 characters, joined in rounds between tasks, against the library's ids of whole texts."""
    return same_ids(table(spark, d, "documents"), vocabulary_path("byte_bpe_50k"), Workspace(spark, "joined"), 500)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects(table(spark, d, "documents"), table(spark, d, "subject_areas"), table(spark, d, "subject_labels"), Workspace(spark, "subjects"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each area and their share of all documents."""
    n = table(spark, d, "documents").count()
    return _subjects(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents")).withColumn("share", F.col("n_documents") / F.lit(max(n, 1)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_overlaps, p5_found, p5_day_category, p5_days, p5_categories, p5_unions, p5_bounds, p6_ids, p6_joined, p7_found, p7_leaks, p7_clean, p8_found, p8_composition)
}

KIND = r"nullif(lower(substr(regexp_replace(cl_type, '^\s+', ''), 1, 1)), '')"
OVERLAPS = rf"""with pairs as (select distinct least(c1, c2) as c_low, greatest(c1, c2) as c_high from workitem where c1 > 0 and c2 > 0 and c1 <> c2),
files as (select distinct page_id, cl_from from categorylinks where cl_from > 0 and page_id > 0 and {KIND} = 'f'),
sizes as (select page_id, count(*) as n from files group by page_id),
met as (select c_low, c_high, count(*) as n from pairs join files a on a.page_id = c_low join files b on b.page_id = c_high and b.cl_from = a.cl_from group by c_low, c_high),
result as (select p.c_low, p.c_high, coalesce(a.n, 0) as n_low, coalesce(b.n, 0) as n_high, coalesce(m.n, 0) as shared
  from pairs p left join sizes a on a.page_id = p.c_low left join sizes b on b.page_id = p.c_high left join met m on m.c_low = p.c_low and m.c_high = p.c_high)
"""
SQL: dict[str, str] = {
    "p2_found": OVERLAPS + "select c_low, c_high from result where least(n_low, n_high) >= 50 and shared * 10 >= 3 * least(n_low, n_high)",
    "p2_overlaps": OVERLAPS + "select * from result",
    "p5_found": """select strftime(cl_timestamp, '%Y-%m-%d') as link_day, page_id from categorylinks
where cl_from > 0 and page_id > 0 and cl_timestamp is not null group by 1, 2 having count(*) >= 20 and count(distinct cl_from) * 2 < count(*)""",
    "p5_bounds": """with dated as (select strftime(cl_timestamp, '%Y-%m-%d') as day, page_id, cl_from from categorylinks where cl_from > 0 and page_id > 0),
pairs as (select distinct least(c1, c2) as c_low, greatest(c1, c2) as c_high from workitem where c1 > 0 and c2 > 0 and c1 <> c2)
select 'day and category' as what, count(*) as n_groups, 0::bigint as n_outside from (select distinct day, page_id from dated where day is not null)
union all select 'day', count(*), 0 from (select distinct day from dated where day is not null) union all select 'category', count(*), 0 from (select distinct page_id from dated)
union all select 'pair of categories', count(*), 0 from pairs where c_low in (select page_id from dated) or c_high in (select page_id from dated)""",
    "p6_joined": "select count(*) as n_documents, count(*) as n_same from documents",
    "p7_leaks": """with texts as (select item_id, prompt as text from eval_items union all select item_id, solution from eval_items),
iw as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from texts), dw as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents),
ig as (select distinct item_id, array_to_string(w[i:i + 11], ' ') as g from (select item_id, w, unnest(generate_series(1, len(w) - 11)) as i from iw)),
dg as (select doc_id, len(w) as n, i, array_to_string(w[i:i + 11], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 11)) as i from dw)),
hits as (select distinct doc_id, item_id, n, i from dg join ig using (g)),
runs as (select *, i - row_number() over (partition by doc_id, item_id order by i) as island, lead(i) over (partition by doc_id, item_id order by i) - i as gap from hits),
islands as (select doc_id, item_id, n, count(*) + 11 as longest, sum(coalesce(least(gap, 12), 12)) as covered from runs group by doc_id, item_id, n, island)
select doc_id, item_id, cast(n as int) as doc_words, cast(max(longest) as int) as longest, cast(sum(covered) as int) as covered from islands group by doc_id, item_id, n""",
    "p7_found": """with texts as (select item_id, prompt as text from eval_items union all select item_id, solution from eval_items),
iw as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from texts), dw as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents),
ig as (select distinct item_id, array_to_string(w[i:i + 11], ' ') as g from (select item_id, w, unnest(generate_series(1, len(w) - 11)) as i from iw)),
dg as (select distinct doc_id, array_to_string(w[i:i + 11], ' ') as g from (select doc_id, w, unnest(generate_series(1, len(w) - 11)) as i from dw))
select distinct doc_id, item_id from dg join ig using (g)""",
}
