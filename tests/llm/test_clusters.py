import hashlib
import math
import random

import numpy as np

from hybridlake.llm import centroid_clusters, queries
from hybridlake.llm.centroid_clusters import ClusterParams, History


def brute(rows, params):
    """Lloyd's rounds in Python's integers: a row for each kept vector."""
    kept = []
    for vec, values in rows:
        if values is not None and len(values) == params.dim and all(v is not None and math.isfinite(v) for v in values):
            kept.append((vec, [math.floor(params.scale * v) for v in values]))
    name = lambda v: hashlib.sha256(f"{params.seed}:{v}".encode()).hexdigest()
    order = sorted(kept, key=lambda r: (r[0] is None, name(r[0]), r[1]))
    centers = [list(v) for _, v in order[:params.clusters]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(centers)), key=lambda c: (square(v, centers[c]), c))
    for _ in range(params.rounds):
        own = [nearest(v) for _, v in kept]
        for c in range(len(centers)):
            members = [v for (_, v), o in zip(kept, own) if o == c]
            if members:
                centers[c] = [sum(col) // len(members) for col in zip(*members)]
    out = []
    for vec, v in kept:
        c = nearest(v)
        out.append((vec, c, square(v, centers[c]), tuple(centers[c])))
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, vector long, cluster long, bounds string").repartition(3)


def sample(rng, n, dim, spread):
    middles = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for i in range(n):
        m = rng.choice(middles)
        rows.append((i, [float(np.float32(x + rng.gauss(0, spread))) for x in m]))
    return rows


def both(spark, rows, params):
    found = centroid_clusters.cluster(vectors(spark, [(i, v, 1, 2, "x") for i, v in rows]), params).collect()
    got = sorted(((r["vec_id"], r["cluster"], r["distance"], tuple(r["centroid"])) for r in found), key=repr)
    return got, sorted(brute(rows, params), key=repr)


def test_clusters_are_those_of_exact_rounds(spark):
    rng = random.Random(4)
    for n, dim, spread, k, rounds in ((300, 4, .1, 8, 10), (200, 3, .6, 5, 4), (40, 2, 0.0, 8, 10)):
        got, expected = both(spark, sample(rng, n, dim, spread), ClusterParams(clusters=k, rounds=rounds, dim=dim))
        assert got == expected


def test_odd_vectors(spark):
    params = ClusterParams(clusters=3, rounds=3, dim=2)
    rows = [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [float("nan"), 0.0]),
            (6, [float("inf"), 0.0]), (None, [0.25, -0.25]), (7, [-0.0001, 0.0]), (8, [1e5, -3e5]), (9, [1.0, 2.0, 3.0])]
    got, expected = both(spark, rows, params)
    assert got == expected and len(got) == 5
    got, expected = both(spark, rows[:2], params)  # fewer vectors than clusters, and ties
    assert got == expected
    assert centroid_clusters.cluster(vectors(spark, [])).count() == 0
    wide = [(i, [float(i) * 1e7, 1e15]) for i in range(5)]  # differences that 64 bits don't hold once squared
    found = centroid_clusters.cluster(vectors(spark, [(i, v, 1, 2, "x") for i, v in wide]), params).collect()
    assert {r["vec_id"]: r["cluster"] for r in found} == {r[0]: r[1] for r in brute([(i, list(map(float, np.float32(v)))) for i, v in wide], params)}


def test_bounds_use_the_total_displacement():
    # a centroid goes away and comes back: summed drifts would be 200, the displacement is 0
    rounds = [[[0, 0], [50, 0]], [[0, 0], [150, 0]], [[0, 0], [50, 0]]]
    history = History(rounds)
    assert history.moved[0, 1] == 0 and abs(history.moved[1, 1] - 100) < 1e-3
    measured = []
    history.distances = lambda v, c, own=history.distances: measured.append((c, len(v))) or own(v, c)
    bounds, stamps = np.array([[3.0, 47.0]]), np.zeros((1, 2), np.int64)
    cluster, square = history.assign(np.array([[3, 0]]), np.array([0]), bounds, stamps)
    assert cluster.tolist() == [0] and square.tolist() == [9]
    assert measured == [(0, 1)]  # the other centroid's bound still decides
    assert stamps.tolist() == [[2, 0]]


def test_the_query(spark, tmp_path):
    rng = random.Random(9)
    rows = sample(rng, 150, 64, .3)
    vectors(spark, [(i, v, 1, 2, "x") for i, v in rows]).write.parquet(str(tmp_path / "embeddings.parquet"))
    expected = brute(rows, ClusterParams())
    total = sum(r[2] for r in expected)
    by = {c: sum(r[2] for r in expected if r[1] == c) for c in range(8)}
    sha = lambda v: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()
    got = queries.op11_centroid_clusters(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted((v, c, d, by[c], total, sha(m)) for v, c, d, m in expected)
