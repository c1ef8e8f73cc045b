"""A running engine: a snapshot with its quality tags, answering requests one by one or in batches."""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Callable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from taxograph.operators.actions import REQUEST, Answers, answer, good_tags
from taxograph.plans.requests import QueryRequest, RequestError, Status, body_lines, rendered
from taxograph.sources.snapshots import current_version, read_snapshot
from taxograph.workspace import Workspace

QUEUE_SLOTS = 1000
#: Seconds between two progress messages.
NOTICE = 0.2


class Engine:
    """``folder`` holds snapshots; ``seeds`` are the quality-tag categories ``(prio, cat_id, depth, tag)``."""

    def __init__(self, spark: SparkSession, folder: str, seeds: DataFrame, slots: int = QUEUE_SLOTS, callback: str = "callback"):
        self.spark, self.folder, self.seeds, self.slots = spark, folder, seeds, slots
        self.callback = callback
        self.lock, self.waiting, self.taken, self.ended = threading.Lock(), 0, 0, 0
        self.pool = ThreadPoolExecutor(max_workers=1)  # one request is computed at a time, in order
        self._load()

    def _load(self) -> None:
        graph, meta = read_snapshot(self.spark, self.folder)
        tags = good_tags(Workspace(self.spark, "engine"), graph, self.seeds)
        self.graph, self.meta, self.tags = graph, meta, tags

    def refresh(self) -> bool:
        """Take the current version if it is another one."""
        if current_version(self.spark, self.folder) == self.meta["version"]:
            return False
        self._load()
        return True

    def age(self) -> float:
        """Seconds since the snapshot was built."""
        return time.time() - self.meta["built_at"]

    def status(self) -> str:
        """The status document."""
        return json.dumps({"queue": self.waiting, "relsize": self.graph.limit, "dbage": round(self.age()), "load": list(os.getloadavg())})

    def batch(self, requests: DataFrame, workspace: Workspace | None = None, progress: Callable[[int, int], None] | None = None) -> Answers:
        """Answer a table of requests together; the answers can be read until the workspace is deleted."""
        return answer(self.graph, requests, self.tags, workspace=workspace, progress=progress)

    def compute(self, request: QueryRequest) -> list[str]:
        """The messages that answer one request; an error if it is not valid."""
        with Workspace(self.spark, "answer") as ws:
            return self._compute(request, ws)

    def _compute(self, request: QueryRequest, ws: Workspace) -> list[str]:
        request.status = Status.PREPROCESS

        def sizes(first: int, second: int) -> None:
            request.sizes = (first, second)

        found = self.batch(self.spark.createDataFrame([request.row()], REQUEST), ws, sizes)
        refused = found.rejected.first()
        if refused:
            raise RequestError(refused["reason"])
        request.status = Status.COMPUTING
        rows = [(r["id"], r["depth"], r["tag"]) for r in found.rows.orderBy("n").collect()]  # one page
        total = found.totals.first()
        request.status = Status.STREAMING
        lines = rendered(request.transport, body_lines(request.a, rows, total["outof"], total["found"], self.age()), self.callback)
        request.status = Status.DONE
        return lines

    def submit(self, params: Mapping[str, str], socket: bool = False, tell: Callable[[str], None] = lambda _: None) -> Future:
        """Queue a request given by its parameters; refused if the queue is full. ``QUEUED`` tells how many are ahead."""
        request = QueryRequest.from_params(params, socket=socket)
        with self.lock:
            if self.waiting >= self.slots - 1:
                raise RequestError("queue full")
            tell(f"QUEUED {self.waiting}")
            self.waiting += 1
            self.taken += 1
            place = self.taken

        def run() -> list[str]:
            try:
                return self.compute(request)
            finally:
                with self.lock:
                    self.waiting -= 1
                    self.ended += 1

        out = self.pool.submit(run)
        out.progress = lambda: f"WAITING {max(0, place - 1 - self.ended)}" if request.status is Status.WAITING else "WORKING {} {}".format(*request.sizes)
        return out

    def follow(self, answer: Future, tell: Callable[[str], None]) -> list[str]:
        """Wait for a submitted request and tell its progress every ``NOTICE`` seconds."""
        while True:
            try:
                return answer.result(timeout=NOTICE)
            except TimeoutError:
                if answer.done():
                    raise
                tell(answer.progress())
