"""Centroid clustering whose bounds are loosened by the geometry of each move.

Vectors are turned into integers, so that all distances and sums are exact. Every vector
carries its cluster, the exact squared distance to that centroid and a lower bound of
its distance to each centroid. When the centroids move, a vector needs no scan as long as
its distance to its own centroid stays under all of its bounds.

A bound is loosened by what the vector can have come nearer to the moved centroid. All
vectors of a cluster lie in a sphere around its centroid, with the farthest one as its
radius. For a centroid that moves from c to c' by a step of length s, a point x comes
nearer by (|x-c|^2 - |x-c'|^2) / (|x-c| + |x-c'|). The numerator is 2 s a, where a is the
height of x along the step over the midpoint m of c and c', and the denominator is at least
2 |x-m|. So it comes nearer by s cos(angle at m between x and the step) at most. Within the plane
of m, the step and the sphere's centre that angle is at least the centre's angle less the angle
of the tangent from m to the sphere. Only where m lies inside the sphere is the whole step taken
off, and where the sphere lies behind m nothing is.

Vectors whose distance isn't under all bounds are ambiguous: they are compared with all
centroids in integers, ties to the smaller number, and their bounds become exact.

What a round moves: one row of sums per task and cluster of the vectors that changed their
cluster, and per cluster the farthest distance. The state of a round is kept by the executors
(memory, then disk), its lineage is map-only, so a lost executor costs the passes over its own
partitions. Nothing is sampled and only centroids reach the driver.

Defined cases: vectors with another number of components, with a null or a value that isn't
finite, and null vectors are left out; a null id is kept and hashes like the empty text;
rows that repeat are vectors of their own; fewer vectors than centroids give fewer
centroids; a table without vectors gives no rows. Components of 2^17 or more would overflow
the distances: they raise an error that says so. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toponymic.llm import storage

#: Factor of a component before it is cut to an integer.
SCALE = 1024
#: Largest integer component, so that a squared distance of 64 components and more fits a long.
MOST = 1 << 27
#: Rows compared with all centroids at once.
ROWS = 4096
#: What a bound must be larger by: far more than the rounding of square roots.
SLACK = 1e-6

STATE = T.StructType([T.StructField("id", T.StringType()), T.StructField("vector", T.BinaryType()),
                      T.StructField("before", T.IntegerType()), T.StructField("cluster", T.IntegerType()),
                      T.StructField("distance", T.LongType()), T.StructField("low", T.BinaryType()),
                      T.StructField("scanned", T.IntegerType())])


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has ``size`` components, none null and all finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.size(vector) == size, F.lit(False)) & F.coalesce(~bad, F.lit(False))


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of every component, as 64-bit integers."""
    scaled = np.floor(np.asarray(vectors, dtype=np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() >= MOST:
        raise ValueError(f"a component of {MOST // SCALE} or more: its squared distances don't fit a long")
    return scaled.astype(np.int64)


def all_distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every centroid."""
    out = np.empty((len(vectors), len(centroids)), dtype=np.int64)
    for lo in range(0, len(vectors), ROWS):
        for j, c in enumerate(centroids):
            step = vectors[lo:lo + ROWS] - c
            out[lo:lo + ROWS, j] = np.einsum("ij,ij->i", step, step)
    return out


def nearer(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster i and centroid j: by how much vectors of i can have come nearer to j.

    ``radius``: the largest distance in each cluster (0 where it is empty) before the move.
    """
    old, new = old.astype(np.float64), new.astype(np.float64)
    step = new - old
    length = np.sqrt((step * step).sum(axis=1))
    middle = (old + new) / 2
    away = old[:, None, :] - middle[None, :, :]                     # from the midpoint of j to the centre of i
    distance = np.sqrt((away * away).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        along = np.clip((away * step[None]).sum(axis=2) / (distance * length[None]), -1, 1)
        tangent = np.arcsin(np.clip(radius[:, None] / distance, 0, 1))
    outside = (distance > radius[:, None] * (1 + 1e-9)) & (length[None] > 0)
    angle = np.where(outside, np.maximum(np.arccos(along) - tangent, 0), 0)
    share = np.maximum(np.cos(np.minimum(angle, np.pi / 2)), 0)
    return length[None] * np.where(outside, share, 1) * (1 + 1e-9)


def _scan(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, its exact squared distance, and the distances to all as bounds."""
    found = all_distances(vectors, centroids)
    best = found.argmin(axis=1).astype(np.int32)                    # the first of equal ones
    return best, found[np.arange(len(best)), best], np.sqrt(found.astype(np.float64))


def _rows(batch: pa.RecordBatch, name: str, size: int, kind: type) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), size)


def _state(ids: pa.Array, vectors: list[bytes] | pa.Array, before: np.ndarray, cluster: np.ndarray,
           distance: np.ndarray, low: np.ndarray, scanned: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(vectors, pa.binary()), pa.array(before, pa.int32()), pa.array(cluster, pa.int32()),
         pa.array(distance, pa.int64()), pa.array([x.tobytes() for x in low], pa.binary()),
         pa.array(scanned.astype(np.int32), pa.int32())], names=STATE.names)


def _first(centroids: np.ndarray) -> Callable:
    """The first assignment: every vector is compared with all centroids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = _rows(batch, "vector", centroids.shape[1], np.int32).astype(np.int64)
            cluster, distance, low = _scan(vectors, centroids)
            none = np.full(len(vectors), -1, dtype=np.int32)
            yield _state(batch.column(0), batch.column(1), none, cluster, distance, low, none * -1)
    return run


def _next(centroids: np.ndarray, loosen: np.ndarray) -> Callable:
    """The assignment after a move: only vectors that their bounds leave open are compared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = centroids.shape
        for batch in batches:
            if not len(batch):
                continue
            vectors = _rows(batch, "vector", size, np.int32).astype(np.int64)
            before = batch.column(batch.schema.get_field_index("cluster")).to_numpy()
            low = _rows(batch, "low", k, np.float64) - loosen[before]
            own = vectors - centroids[before]
            distance = np.einsum("ij,ij->i", own, own)
            cluster = before.copy()
            mine = np.arange(len(before))
            low[mine, before] = np.inf
            root = np.sqrt(distance.astype(np.float64))
            open_ = np.flatnonzero(root * (1 + 1e-9) + SLACK >= low.min(axis=1))
            low[mine, before] = root
            if len(open_):
                cluster[open_], distance[open_], low[open_] = _scan(vectors[open_], centroids)
            scanned = np.zeros(len(before), dtype=np.int32)
            scanned[open_] = 1
            yield _state(batch.column(0), batch.column(1), before, cluster, distance, low, scanned)
    return run


def _moves(size: int) -> Callable:
    """Per batch, and cluster left or entered: number and component sums of the vectors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = _rows(batch, "vector", size, np.int32).astype(np.int64)
            clusters, counts, sums = [], [], []
            for side, sign in ((1, -1), (2, 1)):
                label = batch.column(side).to_numpy()
                for c in np.unique(label[label >= 0]):
                    here = vectors[label == c]
                    clusters.append(int(c))
                    counts.append(sign * len(here))
                    sums.append(sign * here.sum(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(clusters, pa.int32()), pa.array(counts, pa.int64()),
                                              pa.array(sums, pa.list_(pa.int64()))], names=["cluster", "n", "sums"])
    return run


def _moved(state: DataFrame, size: int) -> dict[int, tuple[int, np.ndarray]]:
    """Change of every cluster's number and sums, added up by Spark."""
    parts = (state.where("before != cluster").select("vector", "before", "cluster")
                  .mapInArrow(_moves(size), "cluster int, n long, sums array<long>"))
    one = parts.select("cluster", F.posexplode(F.concat(F.array("n"), "sums")).alias("at", "x"))
    found: dict[int, np.ndarray] = {}
    for row in one.groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect():       # k * (size + 1) rows at most
        found.setdefault(row["cluster"], np.zeros(size + 1, dtype=object))[row["at"]] = row["x"]
    return {c: (x[0], x[1:]) for c, x in found.items()}


def kept(df: DataFrame, id_col: str, vector_col: str, size: int) -> DataFrame:
    """``id`` (as text), ``vector`` (32-bit integers, packed) of the usable rows."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), size)
                packed = [x.tobytes() for x in integers(values).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "vector"])

    return (rows.where(usable(F.col("v"), size)).select("id", F.col("v").cast("array<double>"))
                .mapInArrow(run, "id string, vector binary"))


def starts(rows: DataFrame, k: int, size: int, prefix: str) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of prefix and id, in hash order (ties: by vector)."""
    tag = F.sha2(F.concat(F.lit(prefix), F.coalesce("id", F.lit(""))), 256)
    best = rows.select(tag.alias("tag"), "vector").orderBy("tag", "vector").limit(k).collect()
    return np.array([np.frombuffer(bytes(r["vector"]), dtype=np.int32) for r in best], dtype=np.int64).reshape(-1, size)


class Clusters:
    """Result of a run: ``rows`` (the id, ``cluster``, ``distance``), final ``centroids``,
    ``counts`` and ``inertia`` of each cluster, and ``scans``: vectors compared in each pass."""

    def __init__(self, rows: DataFrame, centroids: np.ndarray, counts: list[int], inertia: list[int], scans: list[int]):
        self.rows, self.centroids, self.counts, self.inertia, self.scans = rows, centroids, counts, inertia, scans

    def table(self) -> DataFrame:
        """One row per centroid: cluster, cluster_inertia, inertia, centroid_sha256."""
        spark = self.rows.sparkSession
        digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in self.centroids]
        return spark.createDataFrame(
            [(i, self.inertia[i], sum(self.inertia), digest[i]) for i in range(len(digest))],
            "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, k: int = 8,
            rounds: int = 10, prefix: str = "3:") -> Clusters:
    """``rounds`` rounds of assignment and update, then one more assignment, all exact.

    Rounds end early only if no centroid moves, as no later round would change anything.
    The assignments are written to the shared folder, so nothing of the run stays in memory.
    """
    rows = kept(df, id_col, vector_col, size)
    centroids = starts(rows, k, size, prefix)
    counts, sums = [0] * len(centroids), [np.zeros(size, dtype=object) for _ in centroids]
    scans: list[int] = []
    state = rows.mapInArrow(_first(centroids), STATE) if len(centroids) else rows.sparkSession.createDataFrame([], STATE)
    held: list[DataFrame] = []
    stats: dict = {}
    try:
        for turn in range(rounds + 1):
            state = state.persist(StorageLevel.MEMORY_AND_DISK)
            held.append(state)
            stats = {r["cluster"]: r for r in state.groupBy("cluster").agg(
                F.max("distance").alias("far"), F.sum("distance").alias("inertia"), F.count("*").alias("n"),
                F.sum("scanned").alias("scanned")).collect()}
            scans.append(sum(r["scanned"] for r in stats.values()))
            if len(held) > 1:
                held.pop(0).unpersist()
            if turn == rounds or not len(centroids):
                break
            for c, (n, x) in _moved(state, size).items():
                counts[c], sums[c] = counts[c] + n, sums[c] + x
            moved = np.array([[x // n for x in s] if n else c for n, s, c in zip(counts, sums, centroids)], dtype=np.int64)
            if np.array_equal(moved, centroids):
                break
            radius = np.sqrt(np.array([stats[c]["far"] if c in stats else 0 for c in range(len(centroids))], dtype=np.float64))
            loosen = nearer(centroids, moved, radius * (1 + 1e-9))
            centroids = moved
            state = state.mapInArrow(_next(centroids, loosen), STATE)
        kind = df.schema[id_col].dataType
        out = storage.written(state.select(F.col("id").cast(kind).alias(id_col), "cluster", "distance"), "clusters")
    finally:
        for x in held:
            x.unpersist()
    n = range(len(centroids))
    return Clusters(out, centroids, [stats[c]["n"] if c in stats else 0 for c in n],
                    [stats[c]["inertia"] if c in stats else 0 for c in n], scans)
