"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; everything else a learner may see is
unlabelled and holds toxic documents as well. The risk of calling the unlabelled part clean
is therefore corrected by the class prior, and where the corrected part falls below zero
(the model begins to memorise the positives) its gradient is reversed (the non-negative
estimator). The model is linear over the presence of words and word beginnings.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hustings.llm.common import Scratch, batch_of, keeper, table
from hustings.llm.registry import query

PREFIXES = (3, 4, 5, 6, 7)
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„’"
THRESHOLD = 0.7
MEMO = 300_000  # words whose features a Python worker remembers


@dataclass
class Model:
    """Weights by feature; at most `max_features` of `train`, so it travels with the tasks."""

    weights: dict[int, float]
    bias: float
    prior: float
    name: int = 0

    def score(self, texts: list[str | None]) -> np.ndarray:
        known = keeper("toxicity").setdefault(self.name, {})
        found = np.empty(len(texts))
        for i, text in enumerate(texts):
            if len(known) > MEMO:
                known.clear()
            hits: set[int] = set()
            for word in set(text.split()) if text else ():
                own = known.get(word)
                if own is None:
                    own = known[word] = tuple(f for f in features(word) if f in self.weights)
                if own:
                    hits.update(own)
            # In a fixed order, so that equal texts get equal scores everywhere.
            found[i] = self.bias + sum(self.weights[f] for f in sorted(hits))
        return sigmoid(found)


def features(word: str) -> list[int]:
    """The word without marks and case, and its beginnings, as 32-bit hashes."""
    word = word.lower().strip(MARKS)
    if not word:
        return []
    return [zlib.crc32(word.encode("utf-8", "replace"))] + [
        zlib.crc32(word[:n].encode("utf-8", "replace") + b"*") for n in PREFIXES if len(word) > n
    ]


def features_of(text: str | None) -> set[int]:
    found: set[int] = set()
    for word in set(text.split()) if text else ():
        found.update(features(word))
    return found


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def nnpu(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    width: int,
    prior: float,
    epochs: int = 150,
    batches: int = 8,
    rate: float = 0.05,
    decay: float = 2e-5,
    seed: int = 7,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk with the logistic loss (Adam)."""
    rng = np.random.default_rng(seed)
    params = np.append(np.zeros(width), np.log(prior / (1 - prior)))
    first, second = np.zeros(width + 1), np.zeros(width + 1)

    def drawn(rows, order):
        picked = [rows[i] for i in order]
        sizes = [len(r) for r in picked]
        return np.concatenate(picked) if picked else np.zeros(0, int), np.repeat(np.arange(len(picked)), sizes)

    step = 0
    for _ in range(epochs):
        halves = zip(
            np.array_split(rng.permutation(len(positive)), batches),
            np.array_split(rng.permutation(len(unlabelled)), batches),
        )
        for p, u in halves:
            if not len(p) or not len(u):
                continue
            (cols_p, rows_p), (cols_u, rows_u) = drawn(positive, p), drawn(unlabelled, u)
            z_p = np.bincount(rows_p, params[cols_p], len(p)) + params[-1]
            z_u = np.bincount(rows_u, params[cols_u], len(u)) + params[-1]
            s_p, s_u = sigmoid(z_p) / len(p), sigmoid(z_u) / len(u)
            # Risk: prior · E_p[l(z, +1)] + max(0, E_u[l(z, -1)] - prior · E_p[l(z, -1)]).
            rest = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
            if rest >= 0:
                g_p, g_u = prior * (s_p - 1 / len(p)) - prior * s_p, s_u
            else:
                g_p, g_u = prior * s_p, -s_u
            grad = np.bincount(cols_p, g_p[rows_p], width) + np.bincount(cols_u, g_u[rows_u], width)
            grad = np.append(grad + decay * params[:-1], g_p.sum() + g_u.sum())
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            params -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return params[:-1], float(params[-1])


COUNTS = pa.schema([("feature", pa.int64()), ("p", pa.int64()), ("u", pa.int64())])
ROWS = pa.schema([("positive", pa.bool_()), ("unlabelled", pa.bool_()), ("features", pa.binary())])


def train(
    docs: DataFrame,
    positives: DataFrame,
    usable="true",
    prior: float = 0.1,
    max_positive: int = 12_000,
    max_unlabelled: int = 24_000,
    max_features: int = 20_000,
    significance: float = 4.0,
) -> Model | None:
    """Learn from `docs` (doc_id, text) whose `usable` holds and from `positives` (doc_id).

    The learner reads a sample: at most `max_positive` positives and about
    `max_unlabelled` usable documents (chosen by the hash of the id), so its cost does not grow
    with the corpus. Features are those that positives have more often than the unlabelled,
    by `significance` standard deviations. Without positives there is no model (None).
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    narrow = docs.select("doc_id", "text").where(usable)
    rows = narrow.count()
    share = min(1.0, max_unlabelled / rows) if rows else 0.0
    picked = (
        positives.select("doc_id").where("doc_id IS NOT NULL").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive)
    )
    ids = scratch.save(picked.withColumn("positive", F.lit(True)), "positives")
    sample = narrow.join(F.broadcast(ids), "doc_id", "left").select(
        F.coalesce("positive", F.lit(False)).alias("positive"),
        (F.pmod(F.xxhash64("doc_id", F.lit("unlabelled")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).alias(
            "unlabelled"
        ),
        "text",
    )
    sample = scratch.save(sample.where("positive OR unlabelled"), "sample")
    size = sample.agg(
        F.coalesce(F.sum(F.col("positive").cast("long")), F.lit(0)).alias("p"),
        F.coalesce(F.sum(F.col("unlabelled").cast("long")), F.lit(0)).alias("u"),
    ).first()
    n_p, n_u = size["p"], size["u"]
    if not n_p or not n_u:
        scratch.drop("positives", "sample")
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, u = batch.column("positive").to_pylist(), batch.column("unlabelled").to_pylist()
            found = [np.fromiter(features_of(t), np.int64) for t in batch.column("text").to_pylist()]
            if found:
                sizes = [len(x) for x in found]
                keys, at = np.unique(np.concatenate(found), return_inverse=True)
                yield batch_of(
                    COUNTS,
                    keys,
                    np.bincount(at, np.repeat(np.array(p, float), sizes), len(keys)).astype(np.int64),
                    np.bincount(at, np.repeat(np.array(u, float), sizes), len(keys)).astype(np.int64),
                )

    expected = F.col("u") * F.lit(n_p / n_u)
    strength = (F.col("p") - expected) / F.sqrt(expected + F.lit(0.25))
    strong = (
        sample.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)
        .mapInArrow(count, "feature long, p long, u long")
        .groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
        .where((F.col("p") >= 3) & (strength >= significance))
        .orderBy(F.desc(strength), "feature").limit(max_features)
    )
    chosen = np.array(sorted(r["feature"] for r in strong.collect()), np.int64)
    place = {int(f): k for k, f in enumerate(chosen)}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [
                np.array(sorted(place[f] for f in features_of(t) if f in place), "<i4").tobytes()
                for t in batch.column("text").to_pylist()
            ]
            yield batch_of(ROWS, batch.column("positive"), batch.column("unlabelled"), own)

    spread = sample.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism)
    projected = spread.mapInArrow(project, "positive boolean, unlabelled boolean, features binary").toArrow()
    # The order of rows depends on the shuffle; sorted, the same rows give the same model.
    rows = sorted(zip(*(projected[c].to_pylist() for c in ("features", "positive", "unlabelled"))))
    weights, bias = nnpu(
        [np.frombuffer(f, "<i4") for f, p, _ in rows if p],
        [np.frombuffer(f, "<i4") for f, _, u in rows if u],
        len(chosen),
        min(max(prior, 1e-4), 0.9),
    )
    scratch.drop("positives", "sample")
    model = Model({int(f): float(w) for f, w in zip(chosen, weights) if w}, bias, prior)
    model.name = zlib.crc32(repr((sorted(model.weights.items()), bias)).encode())
    return model


def scorer(model: Model | None):
    """The score of a text column (0 to 1); null and empty texts get that of a text without features.

    Without a model every score is 0.
    """

    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            rows = part.to_pylist()
            yield pa.array(model.score(rows) if model else np.zeros(len(rows)), pa.float64())

    return F.arrow_udf(scored, "double")


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score and predicted (1 from `threshold` up); no row leaves its place.

    Columns of `docs` with these names are replaced.
    """
    rest = [c for c in docs.columns if c not in ("score", "predicted")]
    return docs.select(*rest, scorer(model)("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def clean(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, as they are."""
    return docs.where(scorer(model)("text") < threshold)


def remainder(column="doc_id", by: int = 3):
    """crc32 of the id as text, modulo `by`; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def learn(spark: SparkSession, sf_dir: str, docs: DataFrame, **options) -> Model | None:
    """The model of the labels outside the held-out third, over the texts of `docs`."""
    labels = table(spark, sf_dir, "labels").where((remainder() != 1) & F.col("toxic").isNotNull())
    seen = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rate = seen.agg(F.avg("toxic").alias("rate")).first()["rate"]
    if not rate:
        return None
    return train(docs, seen.where("toxic = 1"), remainder() != 1, prior=rate, **options)


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(spark, sf_dir, docs)
    return score(docs, model).select(
        "doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", "predicted"
    )
