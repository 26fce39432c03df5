"""Near-duplicate embeddings by product quantisation.

Unit vectors are dealt to coarse inverted lists, and what a list's centre leaves over is coded
by one byte per subspace. A vector also visits every other list whose border is near it.
In a list, table look-ups give the distance from a vector to every code (asymmetric: the one
side is exact); with each code's own error that distance bounds the true one, so only
pairs that cannot be excluded are compared by their exact cosine.

The index is fitted on a bounded sample; every vector is indexed. The tables lose nothing; the
visits may: a pair is missed only if both its vectors lie further than `reach` from
the border of their lists. For a pair at the threshold that is a matter of the tails of one
component of their difference, for closer pairs less; the tests hold recall against
brute force.
"""

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hustings.llm.common import Scratch, batch_of, components, table
from hustings.llm.registry import query

COSINE = 0.93
SAMPLE = 32_768  # vectors the index is fitted on
LIST_SIZE = 1_024  # vectors a list holds on average
MAX_LISTS = 4_096
SUBSPACES = 8
REACH = 0.1
BLOCK = 4_096  # members of a list that one task compares at a time


# --- fitting ---------------------------------------------------------------------------


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None, :], 0.0)


def centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means from a seeded start; a centre that loses all its points keeps its place."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    found = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = squared(x, found).argmin(1)
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(found)
        np.add.at(total, own, x)
        found[size > 0] = total[size > 0] / size[size > 0, None]
    return found


@dataclass
class Index:
    """Centres of the lists and the code books: at most MAX_LISTS and SUBSPACES · 256 vectors."""

    lists: np.ndarray
    books: list[np.ndarray]
    spans: list[tuple[int, int]]

    def home(self, x: np.ndarray) -> np.ndarray:
        return squared(x, self.lists).argmin(1)

    def visits(self, x: np.ndarray, home: np.ndarray, reach: float) -> list[np.ndarray]:
        """The other lists whose border is at most `reach` away."""
        d = squared(x, self.lists)
        gap = np.sqrt(squared(self.lists, self.lists))[home]
        margin = (d - d[np.arange(len(x)), home][:, None]) / np.maximum(2 * gap, 1e-12)
        near = margin <= reach
        near[np.arange(len(x)), home] = False
        return [np.flatnonzero(row).astype("<i4") for row in near]

    def code(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the length of what they miss."""
        rest = x - self.lists[home]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        missed = np.zeros(len(x))
        for m, (a, b) in enumerate(self.spans):
            d = squared(rest[:, a:b], self.books[m])
            codes[:, m] = d.argmin(1)
            missed += ((rest[:, a:b] - self.books[m][codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(missed)

    def distances(self, x: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of exact vectors to codes of list `at`, by table look-up."""
        rest = x - self.lists[at]
        total = np.zeros((len(x), len(codes)))
        for m, (a, b) in enumerate(self.spans):
            total += squared(rest[:, a:b], self.books[m])[:, codes[:, m]]
        return total


def fit(sample: np.ndarray, lists: int) -> Index:
    lists_ = centres(sample, lists)
    rest = sample - lists_[squared(sample, lists_).argmin(1)]
    cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
    spans = [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]
    return Index(lists_, [centres(rest[:, a:b], 256) for a, b in spans], spans)


# --- points ----------------------------------------------------------------------------

POINT = pa.schema(
    [("vec_id", pa.int64()), ("label", pa.int32()), ("dim", pa.int32()), ("key", pa.binary()), ("vec", pa.binary())]
)


def points(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, key, vec) of all rows; key and vec are null where nothing can link."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, vecs, dims = [], [], []
            labels = batch.column("label").to_pylist()
            for label, vec in zip(labels, batch.column("embedding")):
                values = None
                if label is not None and vec.is_valid and vec.values.null_count == 0 and len(vec.values):
                    values = vec.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                    if not np.isfinite(values).all() or not values.any():
                        values = None
                dims.append(None if values is None else len(values))
                keys.append(None if values is None else hashlib.sha256(values.tobytes()).digest()[:16])
                vecs.append(None if values is None else values.tobytes())
            yield batch_of(POINT, batch.column("vec_id"), labels, dims, keys, vecs)

    wanted = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>")
    )
    return wanted.mapInArrow(read, "vec_id long, label int, dim int, key binary, vec binary")


def unit(vecs: list[bytes], width: int) -> np.ndarray:
    """Unit vectors, filled with zeros to `width`."""
    found = np.zeros((len(vecs), width))
    for i, v in enumerate(vecs):
        values = np.frombuffer(v, "<f8")
        values = values / np.abs(values).max()  # the squares of very large or small values stay finite
        found[i, : len(values)] = values / np.sqrt((values * values).sum())
    return found


# --- comparison ------------------------------------------------------------------------

ENTRY = pa.schema(
    [
        ("label", pa.int32()), ("dim", pa.int32()), ("list", pa.int32()), ("home", pa.int32()), ("id", pa.int64()),
        ("n", pa.int64()), ("vec", pa.binary()), ("code", pa.binary()), ("missed", pa.float64()), ("visits", pa.binary()),
    ]
)
ENTRY_SQL = (
    "label int, dim int, list int, home int, id long, n long, vec binary, code binary, missed double, visits binary"
)
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])


class Members:
    """The members of one block of a list, and what has been linked to them."""

    def __init__(self, rows: list[dict], index: Index, cosine: float):
        self.index, self.cosine, self.at = index, cosine, rows[0]["list"]
        self.reach = np.sqrt(2 - 2 * cosine)
        self.ids = np.array([r["id"] for r in rows], np.int64)
        self.n = np.array([r["n"] for r in rows], np.int64)
        self.x = unit([r["vec"] for r in rows], index.lists.shape[1])
        self.codes = np.array([np.frombuffer(r["code"], np.uint8) for r in rows])
        self.missed = np.array([r["missed"] for r in rows])
        self.visits = [np.frombuffer(r["visits"], "<i4") for r in rows]
        self.links = np.zeros(len(rows), np.int64)
        self.part = np.arange(len(rows))  # the lowest member each is connected to
        self.touched = np.zeros(len(rows), bool)

    def compare(self, x: np.ndarray, homes: np.ndarray, first: int | None = None) -> np.ndarray:
        """Which members each row of x is linked to, as a boolean matrix.

        A pair whose vectors visit each other's list counts in the lower list only; with `first`
        the rows are the members from there on, and each pair counts at the later one.
        """
        bound = (self.reach + self.missed + 1e-9) ** 2
        near = self.index.distances(x, self.at, self.codes) <= bound[None, :]
        if first is not None:
            near &= np.arange(len(self.ids))[None, :] < (first + np.arange(len(x)))[:, None]
        for home in np.unique(homes[homes < self.at]):
            twice = np.array([home in v for v in self.visits])
            near[np.ix_(homes == home, twice)] = False
        rows, cols = np.nonzero(near)
        for i in range(0, len(rows), 200_000):
            r, c = rows[i : i + 200_000], cols[i : i + 200_000]
            near[r, c] = np.einsum("ij,ij->i", x[r], self.x[c]) >= self.cosine
        return near

    def link(self, ids: np.ndarray, n: np.ndarray, near: np.ndarray, out: list) -> None:
        """Count the links of rows and members, and connect them."""
        self.links += n @ near
        counts = near @ self.n
        for i in np.flatnonzero(near.any(1)):
            parts = np.unique(self.part[near[i]])
            if len(parts) > 1:
                self.part[np.isin(self.part, parts[1:])] = parts[0]
            out.append((int(ids[i]), int(self.ids[parts[0]]), int(counts[i])))

    def among(self, out: list) -> None:
        """Link the members with each other."""
        for i in range(0, len(self.ids), 512):
            near = self.compare(self.x[i : i + 512], np.full(len(self.ids[i : i + 512]), self.at), i)
            self.links[i : i + 512] += near @ self.n
            self.links += self.n[i : i + 512] @ near
            for k in np.flatnonzero(near.any(1)):
                parts = np.unique(np.append(self.part[near[k]], self.part[i + k]))
                self.part[np.isin(self.part, parts[1:])] = parts[0]

    def rows(self) -> list[tuple[int, int, int]]:
        return [
            (int(i), int(self.ids[p]), int(k))
            for i, p, k in zip(self.ids, self.part, self.links)
            if k or self.ids[p] != i
        ]


def link_points(reps: DataFrame, index: Index, scratch: Scratch, cosine: float, reach: float, block: int) -> DataFrame:
    """(a, b, links): a has `links` links here and is connected with b; an id has many rows."""
    width = index.lists.shape[1]

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                vecs = part.column("vec").to_pylist()
                x = unit(vecs, width)
                home = index.home(x)
                codes, missed = index.code(x, home)
                visits = index.visits(x, home, reach)
                yield batch_of(
                    ENTRY, part.column("label"), part.column("dim"), home, home, part.column("id"), part.column("n"),
                    vecs, [c.tobytes() for c in codes], missed, [v.tobytes() for v in visits],
                )

    homes = scratch.save(reps.mapInArrow(enter, ENTRY_SQL), "lists")
    sizes = homes.groupBy("label", "dim", "list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = scratch.save(sizes, "list-sizes")
    placed = homes.join(sizes, ["label", "dim", "list"])
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # A member of block j is compared with its own block, and as a query with the blocks before.
    members = placed.withColumn("own", own).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("block")
    ).withColumn("role", (F.col("block") != F.col("own")).cast("int"))

    def visiting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            visits = [np.frombuffer(v, "<i4") for v in batch.column("visits").to_pylist()]
            rows = np.repeat(np.arange(len(visits)), [len(v) for v in visits])
            part = batch.take(pa.array(rows))
            lists = pa.array(np.concatenate(visits) if visits else [], pa.int32())
            empty = pa.array([b""] * len(rows), pa.binary())
            for i in range(0, len(rows), 10_000):
                cut = slice(i, i + 10_000)
                yield batch_of(
                    ENTRY, part.column("label")[cut], part.column("dim")[cut], lists[cut], part.column("home")[cut],
                    part.column("id")[cut], part.column("n")[cut], part.column("vec")[cut], empty[cut],
                    part.column("missed")[cut], empty[cut],
                )

    visitors = homes.mapInArrow(visiting, ENTRY_SQL).join(sizes, ["label", "dim", "list"]).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role")
    )
    columns = [f.name for f in ENTRY] + ["block", "role"]
    groups = ["label", "dim", "list", "block"]
    dealt = members.select(*columns).unionByName(visitors.select(*columns)).repartition(*groups)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, members_, queries, out = None, [], None, [], []

        def ask():
            if queries and members_ is not None:
                near = members_.compare(unit([q["vec"] for q in queries], width), np.array([q["home"] for q in queries]))
                members_.link(np.array([q["id"] for q in queries]), np.array([q["n"] for q in queries]), near, out)
            queries.clear()

        def settle():
            nonlocal members_, held
            if held:
                members_ = Members(held, index, cosine)
                members_.among(out)
                held = []

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["label"], row["dim"], row["list"], row["block"])
                if key != at:
                    settle()
                    ask()
                    if members_ is not None:
                        out.extend(members_.rows())
                    at, members_ = key, None
                if row["role"] == 0:
                    held.append(row)
                else:
                    settle()
                    queries.append(row)
                    if len(queries) == 512:
                        ask()
            if len(out) >= 10_000:
                yield batch_of(FOUND, *zip(*out))
                out.clear()
        settle()
        ask()
        if members_ is not None:
            out.extend(members_.rows())
        if out:
            yield batch_of(FOUND, *zip(*out))

    return dealt.sortWithinPartitions(*groups, "role", "id").mapInArrow(compare, "a long, b long, links long")


def near_duplicates(
    vectors: DataFrame,
    cosine: float = COSINE,
    reach: float = REACH,
    list_size: int = LIST_SIZE,
    sample: int = SAMPLE,
    block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of `vectors` (vec_id, embedding, label).

    Only vectors of one label and one length are compared. Rows that are null, zero or hold a
    null or non-finite component, or have no label, link with nothing and are kept. Equal
    vectors are one point with a count, so their pairs are never listed; links are counted where
    they are found, and only connecting links leave a task. A null vec_id is counted as a
    vector, but names no component and is not kept. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "quantise")
    every = scratch.save(points(vectors), "points")
    valid = every.where("key IS NOT NULL")
    # Points of null ids only still need an id to be linked by: one below all others of its own.
    group = valid.groupBy("label", "dim", "key").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("vec").alias("vec")
    )
    named = F.coalesce("least", -1 - F.pmod(F.xxhash64("label", "dim", "key"), F.lit(1 << 61)) - F.lit(1 << 61))
    reps = scratch.save(group.select("label", "dim", "key", named.alias("id"), "least", "n", "vec"), "reps")
    size = reps.agg(F.count("*").alias("n"), F.max("dim").alias("width")).first()
    if size["n"]:
        share = min(1.0, sample / size["n"])
        picked = reps.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
        rows = picked.orderBy("id").limit(2 * sample).select("vec").collect() or reps.limit(1).select("vec").collect()
        lists = min(MAX_LISTS, max(1, round(size["n"] / list_size)))
        index = fit(unit([r["vec"] for r in rows], size["width"]), lists)
        found = scratch.save(link_points(reps, index, scratch, cosine, reach, block), "found")
        scratch.drop("lists")
        label = components(found.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), scratch)
        counts = found.groupBy("a").agg(F.sum("links").alias("links"))
        # The smallest true id of a component, whatever its points without one are called.
        own = reps.join(label, "id", "left").withColumn("root", F.coalesce("component", "id"))
        least = own.groupBy("root").agg(F.min("least").alias("component_id"))
        by_point = own.join(least, "root").join(counts, F.col("id") == F.col("a"), "left")
        by_point = by_point.select("label", "dim", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    else:
        by_point = reps.select("label", "dim", "key", F.col("n").alias("n_links"), F.col("least").alias("component_id"))
    by_point = scratch.save(by_point, "by-point")
    result = every.select("vec_id", "label", "dim", "key").join(by_point, ["label", "dim", "key"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return result.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


@query("op5_embeddings")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
