import math

import numpy as np
from oracle import same_as_sql

from lakeline.llm import clusters


def test_op11_equals_its_sql(spark):
    assert same_as_sql(spark, clusters.op11_clusters, clusters.ORACLE, "/root/testdata/sf0.01", ["embeddings"]) == 500


def test_loosening_bounds_every_point_of_a_sphere_and_is_below_the_drift():
    rng = np.random.default_rng(3)
    saved = 0
    for _ in range(200):
        k, dim = 6, int(rng.integers(2, 6))
        old = rng.normal(size=(k, dim)) * 10
        new = old + rng.normal(size=(k, dim)) * rng.choice([0, 0.1, 3], size=(k, 1))
        radius = np.abs(rng.normal(size=k)) * 4
        most = clusters.loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        for i in range(k):
            x = rng.normal(size=(300, dim))
            x = old[i] + x / np.sqrt((x**2).sum(1))[:, None] * radius[i] * rng.choice([0.3, 1], size=(300, 1))
            nearer = [(np.sqrt(((x - old[j]) ** 2).sum(1)) - np.sqrt(((x - new[j]) ** 2).sum(1))).max() for j in range(k) if j != i]
            assert max(nearer) <= most[i] + 1e-9
            full = max(drift[j] for j in range(k) if j != i)
            assert most[i] <= full * (1 + 1e-6) + 1e-6
            saved += most[i] < 0.9 * full
    assert saved > 200


def brute(rows, k, rounds, scale=256, seed=2):
    import hashlib

    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [c for _, c in first]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda x: min((far(x, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        cs = [[sum(v) // len(v) for v in zip(*m)] if (m := [x for (_, x), o in zip(kept, own) if o == j]) else c for j, c in enumerate(cs)]
    return sorted((i, near(x)[1], near(x)[0]) for i, x in kept)


def test_clumped_vectors_and_bounds_that_spare_comparisons(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 3)) * 20
    rows = [(i, (centres[i % 8] + rng.normal(size=3) * 0.3).tolist()) for i in range(400)] + [(1000 + i, [0.5, 0.5, 0.5]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    for k in (1, 7, 30):
        got = clusters.cluster(df, k=k, rounds=4, dim=3).collect()
        assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == brute(rows, k, 4)
        assert {r.inertia for r in got} == {sum(r.distance for r in got)}
        assert k == 1 or sum(r.compared for r in got) < len(got)


def test_large_components_use_whole_numbers(spark):
    rows = [(i, [float((i * 7919) % 65536 - 32768) * 256, float(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = clusters.cluster(df, k=4, rounds=2, dim=2, scale=1).collect()
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got) == brute(rows, 4, 2, scale=1)


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, cluster string, q int, n int"
    rows = [(1, [1.0, 2.0], "x", 1, 1), (2, [1.0], "x", 1, 1), (3, None, "x", 1, 1), (4, [1.0, None], "x", 1, 1), (5, [float("nan"), 1.0], "x", 1, 1), (6, [float("-inf"), 1.0], "x", 1, 1), (None, [3.0, 3.0], "x", 1, 1), (1, [1.0, 2.0], "x", 1, 1), (7, [], "x", 1, 1)]
    got = clusters.cluster(spark.createDataFrame(rows, schema), k=40, dim=2).collect()
    assert sorted((r.vec_id or 0, r.distance) for r in got) == [(0, 0), (1, 0), (1, 0)]
    assert {r.cluster for r in got if r.vec_id == 1} == {0} and {r.cluster for r in got if r.vec_id is None} == {2}
    assert clusters.cluster(spark.createDataFrame([], schema), dim=2).count() == 0
