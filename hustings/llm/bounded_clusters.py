"""Centroid clustering on integer vectors, exact, with bounds over the centroids' history.

Every vector keeps the distance to its own centroid and a lower bound on the distance to every
other one, each with the round in which it was last evaluated. All earlier centroids are kept, so
a bound of round s is loosened by the norm of the centroid's whole displacement since s; adding up
the steps of the rounds between would loosen it more wherever a centroid turns or comes back.
What a bound can't rule out is evaluated exactly in integers, ties included, so the result is that
of comparing all vectors with all centroids in every round.

A round is one pass over blocks of vectors, written to the shared folder with the sums of their
clusters; only the sums, k × (dimensions + 1) numbers, come to the driver.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hustings.llm.common import Scratch, table
from hustings.llm.registry import query

BLOCK = 4096  # vectors of a block
REACH = 1 << 27  # components at or beyond it leave no room for a squared distance in 64 bits
WIDER, NARROWER = 1 + 1e-9, 1 - 1e-6  # what rounding may cost a distance, and a stored 32-bit bound

STATE = (
    "ids array<long>, vectors binary, kind string, near binary, above binary, above_at binary, below binary, below_at binary, "
    "sums binary, evaluated long"
)
STATE_ARROW = pa.schema(
    [("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("kind", pa.string()), ("near", pa.binary()), ("above", pa.binary())]
    + [("above_at", pa.binary()), ("below", pa.binary()), ("below_at", pa.binary()), ("sums", pa.binary()), ("evaluated", pa.int64())]
)


# --- distances and bounds --------------------------------------------------------------


def all_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all vectors and all centroids."""
    most = max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0))
    if most < 1 << 22 and x.shape[1] <= 256:  # every sum is a whole number below 2^53
        products = (x.astype(np.float64) @ centroids.astype(np.float64).T).astype(np.int64)
    else:
        products = x @ centroids.T
    return (x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1)[None, :] - 2 * products


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances row by row."""
    gap = x - centroids
    return np.einsum("ij,ij->i", gap, gap)


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """[s, j]: how far centroid j is now from where it was in round s, from above."""
    now = history[-1].astype(np.float64)
    return np.stack([np.sqrt(((now - old) ** 2).sum(axis=1)) for old in history]) * WIDER


@dataclass
class Block:
    """Vectors of one block and what is known of their distances."""

    ids: pa.Array
    x: np.ndarray
    near: np.ndarray  # the centroid each belongs to
    above: np.ndarray  # its distance in round above_at, from above
    above_at: np.ndarray
    below: np.ndarray  # the distances of the others in rounds below_at, from below
    below_at: np.ndarray
    evaluated: int = 0

    @classmethod
    def first(cls, ids: pa.Array, x: np.ndarray, centroids: np.ndarray) -> "Block":
        found = all_distances(x, centroids)
        near = found.argmin(axis=1)  # the smallest number of equals
        roots = np.sqrt(found.astype(np.float64))
        n, k = found.shape
        above = roots[np.arange(n), near] * WIDER
        below = (roots * NARROWER).astype(np.float32)
        return cls(ids, x, near, above, np.zeros(n, np.uint8), below, np.zeros((n, k), np.uint8), n * k)

    def assign(self, history: list[np.ndarray]) -> None:
        """Move every vector to the nearest of the last centroids."""
        now, moved, at = history[-1], displacements(history), len(history) - 1
        k = len(now)
        above = self.above + moved[self.above_at, self.near]
        below = self.below - moved[self.below_at, np.arange(k)]
        below[np.arange(len(self.x)), self.near] = np.inf
        rows = np.flatnonzero((below <= above[:, None]).any(axis=1))
        self.evaluated = len(rows)
        if not len(rows):
            return
        # The own centroid first: its exact distance rules most of the others out.
        own = self.near[rows].copy()
        exact = distances(self.x[rows], now[own])
        least, best = exact.copy(), own.copy()
        roots = np.sqrt(exact.astype(np.float64))
        open_ = below[rows] <= (roots * WIDER)[:, None]
        for j in range(k):
            some = np.flatnonzero(open_[:, j])
            if not len(some):
                continue
            found = distances(self.x[rows[some]], now[j][None, :])
            self.evaluated += len(some)
            self.below[rows[some], j] = np.sqrt(found.astype(np.float64)) * NARROWER
            self.below_at[rows[some], j] = at
            better = (found < least[some]) | ((found == least[some]) & (j < best[some]))
            least[some[better]], best[some[better]] = found[better], j
        # The bound on a centroid that was left is its exact distance.
        self.below[rows, own] = roots * NARROWER
        self.below_at[rows, own] = at
        self.near[rows] = best
        self.above[rows] = np.sqrt(least.astype(np.float64)) * WIDER
        self.above_at[rows] = at

    def sums(self, k: int) -> np.ndarray:
        """Per cluster the sum of its vectors and, last, their number."""
        out = np.zeros((k, self.x.shape[1] + 1), np.int64)
        order = np.argsort(self.near, kind="stable")
        starts = np.flatnonzero(np.diff(self.near[order], prepend=-1))
        if len(starts):
            some = self.near[order][starts]
            out[some, :-1] = np.add.reduceat(self.x[order], starts, axis=0)
            out[some, -1] = np.diff(np.append(starts, len(order)))
        return out

    def row(self, k: int) -> pa.RecordBatch:
        kind = "<i2" if np.abs(self.x).max(initial=0) < 1 << 15 else "<i4"
        parts = (self.x.astype(kind), None, self.near.astype("<u2"), self.above.astype("<f8"), self.above_at, self.below, self.below_at)
        values = [[kind] if p is None else [p.tobytes()] for p in parts]
        ids = pa.ListArray.from_arrays(pa.array([0, len(self.ids)], pa.int32()), self.ids)
        return batch_row(ids, *values, [self.sums(k).tobytes()], [self.evaluated])

    @classmethod
    def of(cls, row: dict, k: int) -> "Block":
        n = len(row["near"]) // 2
        read = lambda name, kind, *shape: np.frombuffer(row[name], kind).reshape(n, *shape).copy()
        return cls(
            row["ids"], read("vectors", row["kind"], -1).astype(np.int64), read("near", "<u2").astype(np.int64), read("above", "<f8"),
            read("above_at", np.uint8), read("below", "<f4", k), read("below_at", np.uint8, k),
        )


def batch_row(ids: pa.Array, *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *(pa.array(v, f.type) for v, f in zip(values, list(STATE_ARROW)[1:]))], schema=STATE_ARROW)


def read_blocks(batch: pa.RecordBatch, k: int) -> Iterator[Block]:
    names = [n for n in batch.schema.names if n not in ("ids", "sums", "evaluated")]
    for i in range(batch.num_rows):
        yield Block.of({"ids": batch.column("ids")[i].values} | {n: batch.column(n)[i].as_py() for n in names}, k)


# --- on tables -------------------------------------------------------------------------


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """(id, v array<double>): the vectors that take part.

    Those have exactly `size` components, none null, NaN or infinite, nor so large (2^27 after scaling) that
    a squared distance would not fit 64 bits.
    """
    fits = F.forall(F.col("v"), lambda c: F.abs(c * scale) < REACH)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where((F.size("v") == size) & fits)


def integers(values: np.ndarray, size: int, scale: int) -> np.ndarray:
    return np.floor(scale * values.reshape(-1, size)).astype(np.int64)


def seeds(rows: DataFrame, k: int, salt: str, size: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest hash of salt and id; null ids come last, equal ids by their vectors."""
    order = F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    found = rows.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    return integers(np.array([r["v"] for r in found], np.float64), size, scale)


def _first(size: int, scale: int, centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                ids = pa.concat_arrays([part.column("id")])
                x = integers(part.column("v").flatten().to_numpy(zero_copy_only=False), size, scale)
                yield Block.first(ids, x, centroids).row(len(centroids))

    return run


def _next(history: list[np.ndarray]):
    k = len(history[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in read_blocks(batch, k):
                block.assign(history)
                yield block.row(k)

    return run


def _final(history: list[np.ndarray]):
    k = len(history[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in read_blocks(batch, k):
                block.assign(history)
                exact = distances(block.x, history[-1][block.near])
                yield pa.RecordBatch.from_arrays(
                    [block.ids, pa.array(block.near, pa.int32()), pa.array(exact)], names=["id", "cluster", "distance"]
                )

    return run


def cluster_sums(state: DataFrame, k: int, size: int) -> tuple[np.ndarray, int]:
    """Sums and numbers of all clusters, added up per task, then by key; and distances evaluated."""
    shape = (k, size + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, evaluated = np.zeros(shape, object), 0
        for batch in batches:
            for sums, n in zip(batch.column("sums").to_pylist(), batch.column("evaluated").to_pylist()):
                total = total + np.frombuffer(sums, np.int64).reshape(shape)
                evaluated += n
        values = [*total.ravel().tolist(), evaluated]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(values)), pa.int32()), pa.array([str(v) for v in values])], names=["at", "value"]
        )

    parts = state.select("sums", "evaluated").mapInArrow(run, "at int, value string")
    rows = parts.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    values = [0] * (k * (size + 1) + 1)
    for r in rows:
        values[r["at"]] = int(r["value"])
    return np.array(values[:-1], object).reshape(shape), values[-1]


@dataclass
class Clusters:
    """(id, cluster, distance) of every vector, the final centroids, and distances evaluated per round."""

    rows: DataFrame
    centroids: np.ndarray
    evaluated: list[int] = field(default_factory=list)


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5, size: int = 64,
    scale: int = 256, salt: str = "2:", scratch: Scratch | None = None,
) -> Clusters:
    """Lloyd's rounds from k seeds, then one more assignment; all in integers floor(scale × component).

    Vectors that `whole_vectors` leaves out have no row. Repeated rows count as often as they
    come; null ids stay null. Fewer vectors than k give fewer centroids, none an empty result.
    A centroid becomes the floored mean of its vectors, and stays where it has none. Columns
    other than the two named are not looked at. Rounds end early once no centroid moves.
    """
    scratch = scratch or Scratch(vectors.sparkSession, "clusters")
    rows = whole_vectors(vectors, id_col, vector_col, size, scale)
    history = [seeds(rows, k, salt, size, scale)]
    k = len(history[0])
    schema = "id long, cluster int, distance long"
    if not k:
        return Clusters(vectors.sparkSession.createDataFrame([], schema), history[0].reshape(0, size))
    state = scratch.save(rows.mapInArrow(_first(size, scale, history[0]), STATE), "state-0")
    spent: list[int] = []
    for t in range(rounds):
        if t:
            state = scratch.save(state.mapInArrow(_next(history), STATE), f"state-{t}")
            scratch.drop(f"state-{t - 1}")
        total, evaluated = cluster_sums(state, k, size)
        spent.append(evaluated)
        moved = history[-1].copy()
        some = total[:, -1] > 0
        moved[some] = (total[some, :-1] // total[some, -1:]).astype(np.int64)
        history.append(moved)
        if (moved == history[-2]).all():
            break
    found = scratch.save(state.mapInArrow(_final(history), schema), "rows")
    scratch.drop(f"state-{t}" if rounds else "state-0")
    return Clusters(found, history[-1], spent)


def with_totals(found: Clusters) -> DataFrame:
    """The rows with their cluster's sum of distances, that of all, and a hash of the centroid."""
    spark = found.rows.sparkSession
    hashes = [(j, sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(found.centroids.tolist())]
    sums = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"))
    by_cluster = {r["cluster"]: int(r["inertia"]) for r in sums.collect()}  # k rows
    known = [(j, by_cluster.get(j, 0), sum(by_cluster.values()), h) for j, h in hashes]
    totals = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(totals), "cluster")


@query("op13_bounded_clusters")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_totals(cluster(table(spark, sf_dir, "embeddings")))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
