"""Subject areas of documents: term weighting, truncated singular value decomposition, seed centroids refined by cosine.

1. Each text becomes its set of terms: words of names, comments and strings, split at case changes and underscores, lower
   case, plural s dropped. A term is hashed to one of ``BUCKETS`` features, weighted by inverse document frequency; a
   document has unit length, so a long text weighs no more than a short one.
2. Subspace iteration over all documents gives the ``RANK`` leading right singular vectors: each pass sums, over the
   documents, their contribution to X'XQ, and the sums of the tasks meet in rounds of ``FAN_IN``. The last pass also gives the
   covariance of the projections, by which they are whitened: a language of few documents then counts as one of many does.
3. Seeds are the mean embeddings of an area's labelled documents and of its description, less the mean of documents without an
   area. The centroids are freed of what they have in common, and each is a direction among the features. In each
   round every document gets the areas whose direction it meets at a cosine of at least a threshold; the centroids become
   the means of the documents that have one area only, the mean of the others is taken anew. The threshold is the one that
   fits the labelled documents best.
4. A document is written for each area that it meets at that cosine after the last round: several, one or none.

Everything that is sent to the driver or to all tasks is bounded by BUCKETS, RANK, the number of areas and ``MAX_LABELLED``.
Only labels are sampled; all statistics and the assignment cover all documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxograph.workspace import Workspace

BUCKETS = 1 << 16
RANK = 64
#: Passes over the features: all but the last turn the basis, the last measures it.
PASSES = 4
ROUNDS = 4
#: Added to the standard deviation of each direction when it is whitened.
RIDGE = 0.04
#: The least cosine where no labels tell a better one.
NEAR = 0.11
#: A feature in fewer documents has no weight.
MIN_DOCUMENTS = 3
#: Labelled documents used as seeds, those with the smallest hash of their id if there are more.
MAX_LABELLED = 20_000
CHUNK = 256
BLOCK = 1024
#: Sums of so many tasks are added by one group.
FAN_IN = 16

CASE = re.compile(r"(?<=[a-z])(?=[A-Z])")
LETTERS = re.compile(r"[^\W\d_]{2,}")
#: The same for texts of ASCII characters only, which it finds faster.
ASCII_LETTERS = re.compile(r"[A-Za-z]{2,}")
#: Different names that a worker keeps the terms of.
KNOWN_NAMES = 300_000


def stem(word: str) -> str:
    """The word without a plural s."""
    return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word


def terms_of_name(name: str) -> list[str]:
    """Terms of a run of letters, split where an upper-case letter follows a lower-case one."""
    return [stem(w) for w in (x.lower() for x in CASE.split(name)) if len(w) > 1]


def names_of(text: str) -> set[str]:
    """The distinct runs of letters of a text."""
    return set((ASCII_LETTERS if text.isascii() else LETTERS).findall(text))


def terms_of(text: str | None) -> list[str]:
    """The distinct terms of a text, sorted; none for a null text."""
    return sorted({t for name in names_of(text) for t in terms_of_name(name)}) if text else []


def bucket_of(term: str, buckets: int = BUCKETS) -> int:
    return zlib.crc32(term.encode()) % buckets


class _Names(dict):
    """Features of names met before."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, name: str):
        if len(self) > KNOWN_NAMES:
            self.clear()
        found = self[name] = [bucket_of(t, self.buckets) for t in terms_of_name(name)]
        return found


def _extract(buckets: int, batches: Iterator) -> Iterator:
    import pyarrow as pa

    known = _Names(buckets)
    for batch, texts in _chunks(batches, "text"):
        lists = [list({b for name in names_of(text) for b in known[name]}) if text else [] for text in texts.to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "buckets"])


@dataclass
class Basis:
    """Weights of features and, for those with a weight, their rows of the singular vectors."""

    row: object  # of each bucket: its row, -1 without weight
    weight: object  # of each row
    vectors: object  # rows x rank
    whitening: object | None = None  # rank x rank

    def entries(self, lists) -> Iterator:
        """(document, rows, weights) of the documents with features, given as a list array of distinct buckets; documents
        have unit length. One at a time: what a document needs then stays in the processor's cache."""
        import numpy as np

        offsets = lists.offsets.to_numpy()
        flat = np.asarray(lists.values.to_numpy(zero_copy_only=False))[offsets[0] : offsets[-1]]
        doc = np.repeat(np.arange(len(lists)), np.diff(offsets))
        row = self.row[flat]
        keep = row >= 0
        doc, row = doc[keep], row[keep]
        w = self.weight[row]
        norm = np.sqrt(np.bincount(doc, w * w, len(lists)))
        w = (w / norm[doc]).astype("float32")
        ends = np.searchsorted(doc, np.arange(len(lists) + 1)).tolist()
        for d, (i, j) in enumerate(zip(ends, ends[1:], strict=False)):
            if i < j:
                yield d, row[i:j], w[i:j]

    def project(self, lists):
        """Projection of each document: documents x rank; zero for a document without features."""
        import numpy as np

        out = np.zeros((len(lists), self.vectors.shape[1]), dtype="float32")
        for d, row, w in self.entries(lists):
            out[d] = w @ self.vectors[row]
        return out


def _chunks(batches: Iterator, column: str) -> Iterator:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            yield part, part.column(column)


def _products(basis: Basis, batches: Iterator) -> Iterator:
    """The task's part of X'XQ, with the column sums of X beside it, in blocks of rows."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    total = np.zeros((len(basis.weight), basis.vectors.shape[1] + 1), dtype="float32")
    z = np.ones(total.shape[1], dtype="float32")
    for _, lists in _chunks(batches, "buckets"):
        for _, row, w in basis.entries(lists):
            z[:-1] = w @ basis.vectors[row]
            total[row] += np.outer(w, z)
    task = TaskContext.get().partitionId()
    for block in range(0, len(total), BLOCK):
        part = total[block : block + BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.array([block // BLOCK], pa.int32()), pa.array([task], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "node", "part"])


def _add_blocks(pdf):
    import numpy as np
    import pandas as pd

    total = np.frombuffer(pdf["part"].iloc[0], dtype="float32").astype("float64")
    for part in pdf["part"].iloc[1:]:
        total += np.frombuffer(part, dtype="float32")
    return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "node": [int(pdf["node"].iloc[0])], "part": [total.astype("float32").tobytes()]})


def add_parts(parts: DataFrame, tasks: int, fan_in: int = FAN_IN) -> DataFrame:
    """``(block, node, part)`` with the parts of each block added up, at most ``fan_in`` of them by one group in each round."""
    while tasks > 1:
        parts = parts.withColumn("node", F.floor(F.col("node") / fan_in).cast("int")).groupBy("block", "node").applyInPandas(_add_blocks, "block int, node int, part binary")
        tasks = -(-tasks // fan_in)
    return parts


def singular_vectors(features: DataFrame, rank: int = RANK, passes: int = PASSES, seed: int = 7, buckets: int = BUCKETS, fan_in: int = FAN_IN) -> Basis | None:
    """The basis of all documents' features (column ``buckets``); none if no feature has a weight."""
    import numpy as np

    spark = features.sparkSession
    n = features.count()
    counts = features.select(F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= MIN_DOCUMENTS) & (F.col("n") < n)).toPandas().sort_values("b")  # at most BUCKETS rows
    if counts.empty:
        return None
    row = np.full(buckets, -1, dtype="int32")
    row[counts["b"].to_numpy()] = np.arange(len(counts), dtype="int32")
    rank = min(rank, len(counts))
    vectors = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(counts), rank)))[0]
    weight = np.log(n / counts["n"].to_numpy()).astype("float32")
    width, tasks = rank + 1, features.select("buckets").rdd.getNumPartitions()
    for turn in range(passes):
        basis = Basis(row, weight, vectors.astype("float32"))
        shared = spark.sparkContext.broadcast(basis)
        parts = features.select("buckets").mapInArrow(lambda batches, s=shared: _products(s.value, batches), "block int, node int, part binary")
        summed = np.zeros((len(counts), width))
        for r in add_parts(parts, tasks, fan_in).collect():  # at most BUCKETS x (RANK + 1) numbers
            part = np.frombuffer(r["part"], dtype="float32").reshape(-1, width)
            summed[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] += part
        if turn < passes - 1:
            vectors = np.linalg.qr(summed[:, :-1])[0]
        shared.unpersist()
    mean = summed[:, -1] @ basis.vectors / n
    spread, axes = np.linalg.eigh(basis.vectors.T.astype("float64") @ summed[:, :-1] / n - np.outer(mean, mean))
    basis.whitening = axes / (np.sqrt(np.maximum(spread, 0)) + RIDGE)
    return basis


def _embed(basis: Basis, batches: Iterator) -> Iterator:
    import pyarrow as pa

    for part, lists in _chunks(batches, "buckets"):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([z.tobytes() for z in basis.project(lists)], pa.binary())], ["doc_id", "z"])


def _unit(m):
    import numpy as np

    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-9)


@dataclass
class Centroids:
    """The mean of documents without an area, the centroids (whitened, of unit length) and the least cosine."""

    plain: object
    centres: object
    whitening: object
    least: float = NEAR

    def directions(self):
        """Of each centroid, without what others have of it, the direction in the space of the projections: areas x rank."""
        import numpy as np

        alone = np.linalg.solve(self.centres @ self.centres.T + 1e-6 * np.eye(len(self.centres)), self.centres)
        return _unit(alone @ self.whitening.T)

    def cosines(self, z):
        """Cosine of each document, which has unit length, with each direction; -1 for a document without features."""
        import numpy as np

        return np.where(np.any(z, axis=1)[:, None], (z - self.plain) @ self.directions().T, -1.0)

    def fit(self, z, labels) -> None:
        """Set the least cosine to the middle of those that fit the labels best (F measure, a row of flags a document)."""
        import numpy as np

        if not len(z) or not labels.any():
            return
        cosines = self.cosines(z)
        steps = np.linspace(0.02, 0.6, 117)
        taken = [cosines >= t for t in steps]
        fits = np.array([2 * (x & labels).sum() / (x.sum() + labels.sum()) for x in taken])
        self.least = float(np.median(steps[fits >= fits.max() - 0.001]))


def _arrays(column, rank: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), dtype="float32").reshape(-1, rank)


def _sums(now: Centroids, batches: Iterator) -> Iterator:
    """The task's sums of the embeddings that have one area only, and of those without one (the last): ``(c, j, v)``; j = rank counts them."""
    import numpy as np
    import pyarrow as pa

    areas, rank = now.centres.shape
    total = np.zeros((areas + 1, rank + 1))
    for _, column in _chunks(batches, "z"):
        z = _arrays(column, rank)
        z = z[np.any(z, axis=1)]
        taken = now.cosines(z) >= now.least
        own = taken.sum(axis=1)
        for c in range(areas + 1):
            of = z[(own == 1) & taken[:, c]] if c < areas else z[own == 0]
            total[c, :-1] += of.sum(axis=0)
            total[c, -1] += len(of)
    c, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(j, pa.int32()), pa.array(total[c, j])], ["c", "j", "v"])


def centroids(embedded: DataFrame, basis: Basis, z, labels, about, rounds: int = ROUNDS) -> Centroids:
    """The centroids after ``rounds`` rounds over all documents (column ``z``).

    ``z`` and ``labels`` (flags, a column an area) are the labelled sample, ``about`` the projected descriptions of the areas.
    """
    import numpy as np

    spark = embedded.sparkSession
    areas, rank = about.shape
    without = z[~labels.any(axis=1)] if len(z) else z
    plain = without.mean(axis=0) if len(without) else z.mean(axis=0) if len(z) else np.zeros(rank)
    share = labels / np.maximum(labels.sum(axis=1, keepdims=True), 1)
    told = np.where(np.any(about, axis=1)[:, None], about - plain, 0)
    now = Centroids(plain, _unit((share.T @ (z - plain) + told) @ basis.whitening), basis.whitening)
    now.fit(z, labels)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(now)
        rows = embedded.select("z").mapInArrow(lambda batches, s=shared: _sums(s.value, batches), "c int, j int, v double").groupBy("c", "j").agg(F.sum("v").alias("v")).collect()  # (areas + 1) x (rank + 1) numbers
        shared.unpersist()
        total = np.zeros((areas + 1, rank + 1))
        for r in rows:
            total[r["c"], r["j"]] = r["v"]
        means = total[:, :-1] / np.maximum(total[:, -1:], 1)
        plain = means[-1] if total[-1, -1] else now.plain
        centres = np.where(total[:-1, -1:] > 0, _unit((means[:-1] - plain) @ basis.whitening), now.centres)
        now = Centroids(plain, centres, basis.whitening, now.least)
        now.fit(z, labels)
    return now


def _placed(now: Centroids, batches: Iterator) -> Iterator:
    """A row (doc_id, area, cosine) for each area of each document."""
    import numpy as np
    import pyarrow as pa

    for part, column in _chunks(batches, "z"):
        cosines = now.cosines(_arrays(column, now.centres.shape[1]))
        d, a = np.nonzero(cosines >= now.least)
        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d)), pa.array(a, pa.int32()), pa.array(cosines[d, a], pa.float64())], ["doc_id", "area", "cosine"])


def labelled_sample(labels: DataFrame, names: list[str], limit: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, areas)``: area numbers that readers gave to a document, an empty list for ``none``; at most ``limit`` documents."""
    known = F.array(*(F.lit(n) for n in names)) if names else F.array().cast("array<string>")
    place = F.array_position(known, F.lower(F.trim("subject")))
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), place.cast("int").alias("p"), (F.lower(F.trim("subject")) == "none").alias("none")).filter("doc_id is not null and (p > 0 or none)")
    of = rows.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("p") > 0, F.col("p") - 1))).alias("areas"))
    return of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def subjects(documents: DataFrame, areas: DataFrame, labels: DataFrame, workspace: Workspace, rank: int = RANK, max_labelled: int = MAX_LABELLED, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, subject, cosine)``: the areas, as spelt in ``areas``, that each document is written for.

    Reads ``doc_id, text``; ``subject, about``; ``doc_id, subject``. Null, empty and blank texts have no area. Labels of
    unknown spelling are left out, case and outer blanks aside; without any label the descriptions alone are the seeds and
    ``NEAR`` is the least cosine. Rows that share a ``doc_id`` are looked at apart and have one row for each area of any of
    them, with the largest cosine; as a labelled document the first of them counts. Without areas or documents the result is empty.
    """
    import numpy as np
    import pyarrow as pa

    spark = documents.sparkSession
    empty = spark.createDataFrame([], "doc_id bigint, subject string, cosine double")
    listed = sorted((r["subject"], r["about"] or "") for r in areas.select("subject", "about").filter("subject is not null").distinct().limit(BLOCK + 1).collect())
    if len(listed) > BLOCK:
        raise ValueError(f"more than {BLOCK} subject areas")
    if not listed:
        return empty
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = workspace.write(rows.mapInArrow(lambda batches: _extract(buckets, batches), "doc_id bigint, buckets array<int>"), "features")
    basis = singular_vectors(features, rank, buckets=buckets)
    if basis is None:
        return empty
    shared = spark.sparkContext.broadcast(basis)
    embedded = workspace.write(features.mapInArrow(lambda batches: _embed(shared.value, batches), "doc_id bigint, z binary"), "embedded")
    workspace.drop("features")
    labelled = workspace.write(labelled_sample(labels, [s.strip().lower() for s, _ in listed], max_labelled), "labelled")
    sample = embedded.join(F.broadcast(labelled), "doc_id").groupBy("doc_id").agg(F.min(F.struct("z", "areas")).alias("x")).select("doc_id", "x.*").collect()  # at most max_labelled documents
    sample.sort(key=lambda r: r["doc_id"])
    width = basis.vectors.shape[1]
    z = np.array([np.frombuffer(r["z"], dtype="float32") for r in sample], dtype="float64").reshape(len(sample), width)
    flags = np.zeros((len(sample), len(listed)), dtype=bool)
    for k, r in enumerate(sample):
        flags[k, list(r["areas"])] = True
    about = basis.project(pa.array([sorted({bucket_of(t, buckets) for t in terms_of(f"{s} {x}")}) for s, x in listed], pa.list_(pa.int32())))
    final = spark.sparkContext.broadcast(centroids(embedded, basis, z, flags, about))
    placed = embedded.mapInArrow(lambda batches: _placed(final.value, batches), "doc_id bigint, area int, cosine double")
    spelt = F.element_at(F.array(*(F.lit(s) for s, _ in listed)), F.col("area") + 1)
    return placed.groupBy("doc_id", "area").agg(F.max("cosine").alias("cosine")).select("doc_id", spelt.alias("subject"), "cosine")
