"""All named queries of the core."""

from taxograph.plans import graph, pipeline

FLAGSHIP = "list_files"
QUERIES = {**graph.QUERIES, **pipeline.QUERIES}
SQL = {**graph.SQL, **pipeline.SQL}
