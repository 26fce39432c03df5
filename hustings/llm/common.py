"""What several corpus operators share: scratch tables, files of tasks, components."""

import sys
import types
import uuid
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from hustings.session import shared_folder

WORDS = r"[^\x20\x09-\x0D]+"


class Scratch:
    """A folder of tables below the cluster's checkpoint folder.

    `save` writes a table and reads it back: that cuts the lineage, and a lost executor
    loses nothing that was written. `drop` removes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keeper(name: str, small: bool = False) -> dict:
    """A dict that lives as long as the Python worker, across the tasks it runs.

    A worker serves one operator after the other: what an earlier one kept is dropped, but
    for `small` things that several use.
    """
    holder = sys.modules.setdefault("_corpus_worker_state", types.ModuleType("_corpus_worker_state")).__dict__
    if small:
        return holder.setdefault(f"small_{name}", {})
    for other in [k for k in holder if k.startswith("kept_") and k != f"kept_{name}"]:
        del holder[other]
    return holder.setdefault(f"kept_{name}", {})


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a shared folder, as seen by a task."""
    if not urlsplit(uri).scheme:
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), urlsplit(uri).path
    return pafs.FileSystem.from_uri(uri)


def attempt_file(folder: str, stem: str, suffix: str) -> tuple[pafs.FileSystem, str, str]:
    """A file name that no other attempt of the task uses: (file system, path, uri).

    Spark commits the rows of one attempt only, and they carry the name, so what a lost or
    doubled attempt wrote is never read.
    """
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{suffix}"
    return fs, f"{path}/{name}", f"{folder}/{name}"


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, in UTF-8; null is empty."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def ascii_lower(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.append(starts[1:], len(keys))


# --- connected components -----------------------------------------------------------

PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def union_rows(pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[list[int], list[int]]:
    """Parallel lists (id, smallest id joined with it) for all ids of the pairs but the smallest."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for left, right in pairs:
        for x, y in zip(left.tolist(), right.tolist()):
            parent.setdefault(x, x)
            parent.setdefault(y, y)
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    ids = [x for x in parent if root(x) != x]
    return ids, [root(x) for x in ids]


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [pa.Table.from_batches([b]) for b in batches]
    if held:
        rows = pa.concat_tables(held)
        ids, roots = union_rows([(rows["a"].to_numpy(), rows["b"].to_numpy())])
        yield batch_of(PAIR, ids, roots)


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """The smallest id each id reaches: (id, component), for ids that have an edge.

    Every partition first shrinks its own edges to a forest of stars; then each round
    replaces edges by edges to smaller neighbours, from both ends (large and small star),
    until nothing moves. Aggregates are partial before their shuffle, and the joins carry
    one row per edge, which adaptive execution splits where an id is frequent. The result
    is a table of `scratch`.
    """
    name = uuid.uuid4().hex[:8]
    now = scratch.save(
        edges.select("a", "b").mapInArrow(_local_forest, "a long, b long").distinct(), f"edges-{name}-0"
    )
    state = _state(now)
    for k in range(1, rounds + 1):
        # Edges point from the larger id a to the smaller id b.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join shuffles both sides itself and can split a frequent id.
        least = scratch.save(both.groupBy("a").agg(F.min("b").alias("m")), f"least-{name}-{k}")
        large = both.join(least, "a").where("b > a").select(
            F.col("b").alias("a"), F.least("a", "m").alias("b")
        ).distinct()
        large = scratch.save(large, f"large-{name}-{k}")
        lower = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")), f"lower-{name}-{k}")
        small = large.join(lower, "a").select(
            F.explode(
                F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
            ).alias("e")
        ).select("e.a", "e.b").where("a <> b").distinct()
        old, now = now, scratch.save(small, f"edges-{name}-{k}")
        scratch.drop(*(f"{x}-{name}-{k}" for x in ("large", "least", "lower")), f"edges-{name}-{k - 1}")
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")
    ).first()
    return row["n"], row["h"]
