"""A stream of requests, answered micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from taxograph.plans.engine import Engine
from taxograph.workspace import Workspace


def serve(engine: Engine, requests: DataFrame, out: str, checkpoint: str, refresh: bool = True) -> StreamingQuery:
    """Answer a streaming table of requests into ``out/rows``, ``out/totals`` and ``out/rejected``.

    Each micro-batch is answered as one batch and written under its number, so a batch that is run again after a failure
    replaces what it wrote. The stream takes what is there and ends.
    """

    def run(batch: DataFrame, number: int) -> None:
        if refresh:
            engine.refresh()
        with Workspace(engine.spark, "batch") as ws:
            found = engine.batch(batch, ws)
            for name in ("rows", "totals", "rejected"):
                getattr(found, name).write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return requests.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
