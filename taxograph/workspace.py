"""Intermediate tables in the shared folder of the cluster.

Iterative operators cut their lineage by writing a Parquet table and reading it back. The tables lie under
``spark.checkpoint.dir``, which all executors share, so the loss of an executor costs only the running tasks.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Only a local session without that setting gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="taxograph-")
    return _LOCAL[app]


def _delete_rest() -> None:
    for ws in list(_OPEN):
        ws.delete()


#: Temporary folders of local sessions, and workspaces whose tables are still there.
_LOCAL: dict[str, str] = {}
_OPEN: set[Workspace] = set()
atexit.register(_delete_rest)


def leveled(state: DataFrame, level: str, levels: int, last: str = "select * from STATE", **tables: DataFrame) -> DataFrame:
    """The state after so many levels, as one query: ``level`` is SQL that reads ``STATE`` (and the named tables, in braces).

    The text of all levels is analysed once, not once for each operation of each level.
    """
    parts = ["l0 as (select * from {first})", *(f"l{k + 1} as ({level.replace('STATE', f'l{k}')})" for k in range(levels))]
    return state.sparkSession.sql(f"with {', '.join(parts)} {last.replace('STATE', f'l{levels}')}", first=state, **tables)


class Workspace:
    """A folder of Parquet tables of one operator call.

    A lazy result reads them, so they stay until ``delete`` (or the end of a ``with`` block, or of the process): who has
    consumed a result, as the engine has after each answer, deletes them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        _OPEN.add(self)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.delete()

    def delete(self) -> None:
        """Delete all tables."""
        self._delete(self.path)
        _OPEN.discard(self)

    def write(self, df: DataFrame, label: str) -> DataFrame:
        """The same rows, read back from a table of this workspace."""
        path = f"{self.path}/{label}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_and_look(self, df: DataFrame, label: str, flag: str) -> tuple[DataFrame, bool]:
        """As ``write``, and whether any row has the flag."""
        out, n = self.write_and_count(df, label, flag)
        return out, n > 0

    def write_and_count(self, df: DataFrame, label: str, flag: str) -> tuple[DataFrame, int]:
        """As ``write``, and how many rows have the flag; told by the job that writes."""
        look = Observation()
        out = self.write(df.observe(look, F.count(F.when(F.col(flag), 1)).alias("n")), label)
        return out, look.get["n"]

    def drop(self, label: str) -> None:
        """Delete a table that no later step reads."""
        self._delete(f"{self.path}/{label}")

    def read(self, labels: list[str], schema) -> DataFrame:
        """The union of tables of one schema."""
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{x}" for x in labels))

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended: the folder's owner clears it
            pass
