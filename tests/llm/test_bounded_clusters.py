"""Clusters with bounds against comparing everything with everything."""

from hashlib import sha256

import numpy as np
import pytest

import __spark_entry__ as contract
from hustings.llm import bounded_clusters as bc
from hustings.llm.common import Scratch

NAN, INF = float("nan"), float("inf")


def brute(rows, k=40, rounds=5, size=64, scale=256, salt="2:"):
    """{row number: (cluster, distance)} and the final centroids, by Python integers."""
    kept = [
        (i, vec_id, [int(np.floor(scale * float(c))) for c in v])
        for i, (vec_id, v) in enumerate(rows)
        if v is not None and len(v) == size and all(c is not None and np.isfinite(c) for c in v)
    ]
    order = sorted(kept, key=lambda r: (r[1] is None, sha256(f"{salt}{r[1]}".encode()).hexdigest() if r[1] is not None else "", r[2]))
    centroids = [list(v) for _, _, v in order[:k]]
    x = np.array([v for *_, v in kept], np.int64).reshape(-1, size)

    def assign():
        c = np.array(centroids, np.int64)
        found = np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)
        return found.argmin(axis=1), found.min(axis=1)

    for _ in range(rounds):
        near, _ = assign()
        for j in range(len(centroids)):
            own = x[near == j]
            if len(own):
                centroids[j] = [int(s) // len(own) for s in own.sum(axis=0)]
    near, distance = assign()
    return {r[0]: (int(a), int(d)) for r, a, d in zip(kept, near, distance)}, centroids


def test_the_query_against_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    expected, centroids = brute(rows)
    by_cluster = {}
    for j, d in expected.values():
        by_cluster[j] = by_cluster.get(j, 0) + d
    hashes = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    found = [tuple(r) for r in contract.queries()["op13_bounded_clusters"](spark, sf_dir).collect()]
    assert sorted(found) == sorted(
        (rows[i][0], j, d, by_cluster[j], sum(by_cluster.values()), hashes[j]) for i, (j, d) in expected.items()
    )


@pytest.mark.parametrize("seed", range(3))
def test_tight_groups_ties_and_repeats(spark, monkeypatch, seed):
    monkeypatch.setattr(bc, "BLOCK", 37)
    rng = np.random.default_rng(seed)
    centres = rng.integers(-3, 4, (6, 4)) / 4
    data = [(i, (centres[rng.integers(6)] + rng.integers(-2, 3, 4) / 256).tolist()) for i in range(600)]
    data += data[:50] + [(5, data[9][1]), (None, data[3][1]), (None, data[4][1])]
    docs = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<double>, cluster int").repartition(5)
    found = bc.cluster(docs, k=9, rounds=7, size=4, scratch=Scratch(spark, "test"))
    expected, centroids = brute(data, k=9, rounds=7, size=4)
    assert found.centroids.tolist() == centroids
    want = sorted((str(data[i][0]), j, d) for i, (j, d) in expected.items())
    assert sorted((str(r["id"]), r["cluster"], r["distance"]) for r in found.rows.collect()) == want


def test_bounds_save_work(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    data = [(i, (centres[i % 12] + rng.normal(scale=0.05, size=16)).tolist()) for i in range(3000)]
    docs = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = bc.cluster(docs, k=12, rounds=6, size=16)
    assert found.centroids.tolist() == brute(data, k=12, rounds=6, size=16)[1]
    assert found.evaluated[0] == 12 * 3000 and max(found.evaluated[2:], default=0) < 12 * 3000 / 3


def test_bounds_follow_the_whole_displacement_not_the_steps():
    here, there = np.array([[0, 0], [100, 0]]), np.array([[0, 0], [40, 0]])
    assert bc.displacements([here, there, here])[0].max() == 0
    assert bc.displacements([here, there])[0].tolist() == pytest.approx([0, 60])
    import pyarrow as pa

    block = bc.Block.first(pa.array([1]), np.array([[3, 0]]), here)
    block.assign([here, there, here])  # summed steps of 120 would ask for a new look
    assert block.evaluated == 0 and block.near.tolist() == [0]
    block.assign([here, there, here, np.array([[90, 0], [4, 0]])])
    assert block.evaluated > 0 and block.near.tolist() == [1]


def test_large_components_are_exact():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-bc.REACH + 1, bc.REACH, (50, 64)), rng.integers(-bc.REACH + 1, bc.REACH, (5, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
    assert bc.all_distances(x, c).tolist() == want
    small_x, small_c = x >> 8, c >> 8
    assert bc.all_distances(small_x, small_c).tolist() == [[int(((p - q) ** 2).sum()) for q in small_c] for p in small_x]


def test_odd_vectors_have_no_row(spark):
    ok = [0.5, -0.25]
    data = [(1, ok), (2, None), (3, []), (4, [0.5]), (5, [0.5, None]), (6, [NAN, 1.0]), (7, [INF, 1.0]), (8, [1.0, -INF]), (9, ok + [1.0])]
    data += [(10, [1e300, 0.0]), (11, [524288.0, 0.0]), (None, [0.0, 0.0]), (1, ok)]
    docs = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    found = bc.cluster(docs, k=40, size=2)
    rows = bc.with_totals(found).collect()
    assert sorted((str(r["id"]), r["cluster"], r["distance"], r["inertia"]) for r in rows) == [("1", 0, 0, 0), ("1", 0, 0, 0), ("None", 2, 0, 0)]
    assert found.centroids.tolist() == [[128, -64], [128, -64], [0, 0]]
    for empty in (docs.limit(0), docs.where("vec_id = 2")):
        assert bc.with_totals(bc.cluster(empty, size=2)).collect() == []
    assert bc.cluster(docs, k=1, rounds=0, size=2).rows.count() == 3
