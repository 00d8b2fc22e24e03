"""Centroid clustering: exact Lloyd rounds on integer vectors with geometrically tightened bounds.

Every vector carries a lower bound of its distance to all centroids but its own. When centroids move, the bound must be
loosened by what another centroid can have come closer. The full length of its move (drift) is always enough; here the
vectors of a cluster are known to lie in a sphere around the old centroid, and seen from the middle ``m`` of a move
``c -> c'`` of length ``d`` a point ``x`` has come closer by at most ``d cos(angle between x - m and the move)``:
``|x-c| - |x-c'| = (|x-c|^2 - |x-c'|^2) / (|x-c| + |x-c'|)``, whose numerator is ``2 d`` times the part of ``x - m`` along
the move and whose denominator is at least ``2 |x - m|``. In the plane of the sphere's centre, ``c`` and ``c'`` the
smallest angle of any point of the sphere is the centre's angle less the half-angle under which ``m`` sees the sphere;
spheres beside or behind a move are hardly loosened or not at all. A vector whose own distance is below its bound, or
below half the gap to the next centroid, keeps its cluster; all others are ambiguous and compared with every centroid
in whole numbers. Floating point only decides who is compared, with a margin; distances, sums and ties are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import batch, map_batches, read_table, settle

#: Larger components are an error: squared distances must fit in a long. 2^26 stands for vectors of length 2^18.
MOST = 1 << 26
#: Up to here the sums of products stay below 2^53, so that float matrix products are exact (dim * (2 * FLOAT_SAFE)^2).
FLOAT_SAFE = 1 << 21
EPS = 1e-9


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """``(vec_id, q)`` of the vectors with exactly ``dim`` finite components; ``q`` holds floor(scale * component)."""
    v = F.col(vec_col)
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    kept = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == dim) & F.forall("v", finite))
    return kept.select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("q"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``seed:vec_id``, in that order; rows without id come last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(key.asc_nulls_last(), "q").limit(k).collect()  # k rows
    return np.array([r.q for r in rows], dtype=np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``x`` to every row of ``c``."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) * max(1, x.shape[1] // 64) <= FLOAT_SAFE:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster the most that another centroid can have come closer to any point of its sphere.

    ``radius`` bounds the distance of a cluster's points to its ``old`` centroid.
    """
    move = new - old
    length = np.sqrt((move**2).sum(1))
    sight = old[:, None, :] - ((old + new) / 2)[None]  # from the middle of move j to the centre of sphere i
    far = np.sqrt((sight**2).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip((sight * move[None]).sum(2) / (far * length[None]), -1, 1))
        half = np.arcsin(np.clip(radius[:, None] / far, 0, 1))
        least = np.clip(angle - half - EPS, 0, np.pi / 2)
        near = np.where(radius[:, None] < far, np.cos(least), 1.0) * length[None]
    near = np.where(length[None] == 0, 0.0, np.where(np.isfinite(near), near, length[None]))
    np.fill_diagonal(near, 0)
    return near.max(1, initial=0) * (1 + EPS) + EPS


def half_gaps(c: np.ndarray) -> np.ndarray:
    """Half the distance of each centroid to its nearest other."""
    gap = np.sqrt(squares(c, c).astype(np.float64))
    np.fill_diagonal(gap, np.inf)
    return gap.min(1, initial=np.inf) / 2


STATE = pa.schema([("kind", pa.int32()), ("vec_id", pa.int64()), ("q", pa.list_(pa.int64())), ("cluster", pa.int32()), ("distance", pa.int64()), ("lower", pa.float64()), ("n", pa.int64())])
STATE_DDL = "kind int, vec_id long, q array<long>, cluster int, distance long, lower double, n long"
VECTORS, SUMS, FARTHEST = 0, 1, 2


def lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] or 1, dtype=np.int32)), pa.array(x.reshape(-1)))


def assign(state: DataFrame, centres: np.ndarray, loosen: np.ndarray | None) -> DataFrame:
    """One pass: each vector with its nearest centroid, and at the end of each task one row of sums a cluster.

    ``loosen`` is None in the first round, where nothing is known. The ``n`` of a vector's row is 1 if it was compared
    with all centroids. Rows of kind SUMS hold sums of components, of squared distances and the number of vectors of a
    cluster, rows of kind FARTHEST its largest squared distance.
    """
    shared = state.sparkSession.sparkContext.broadcast((centres, loosen, half_gaps(centres)))  # k x dim numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, loose, half = shared.value
        k, dim = c.shape
        sums, members, inertia, far = np.zeros((k, dim), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.full(k, -1, np.int64)
        for b in batches:
            x = np.asarray(b.column("q").flatten()).reshape(-1, dim)
            if not len(x):
                continue
            if max(x.max(), -x.min()) > MOST:
                raise ValueError(f"a component is beyond {MOST}: squared distances do not fit in a long")
            if loose is None:
                own, low = np.zeros(len(x), np.int32), np.full(len(x), -1.0)
                unsure = np.ones(len(x), dtype=bool)
            else:
                own = np.array(b.column("cluster"), dtype=np.int32)
                low = np.asarray(b.column("lower")) - loose[own]
            dist = ((x - c[own]) ** 2).sum(1)
            if loose is not None:
                unsure = ~(np.sqrt(dist.astype(np.float64)) * (1 + EPS) + EPS < np.maximum(low, half[own]))
            at = np.flatnonzero(unsure)
            if len(at):
                all_of = squares(x[at], c)
                own[at] = all_of.argmin(1)  # the first of equals: the smaller number
                dist[at] = all_of[np.arange(len(at)), own[at]]
                all_of[np.arange(len(at)), own[at]] = np.iinfo(np.int64).max
                low[at] = np.sqrt(all_of.min(1).astype(np.float64)) * (1 - EPS)
            np.add.at(sums, own, x)
            members += np.bincount(own, minlength=k)
            np.add.at(inertia, own, dist)
            np.maximum.at(far, own, dist)
            yield batch(STATE, kind=np.zeros(len(x), np.int32), vec_id=b.column("vec_id"), q=b.column("q"), cluster=own, distance=dist, lower=low, n=unsure.astype(np.int64))
        seen = np.flatnonzero(members)
        for kind, of in ((SUMS, inertia), (FARTHEST, far)):
            rows = sums[seen] if kind == SUMS else np.zeros((len(seen), 0), np.int64)
            q = lists(rows) if kind == SUMS else pa.array([[]] * len(seen), pa.list_(pa.int64()))
            yield batch(STATE, kind=np.full(len(seen), kind, np.int32), vec_id=pa.nulls(len(seen), pa.int64()), q=q, cluster=seen.astype(np.int32), distance=of[seen], lower=np.zeros(len(seen)), n=members[seen])

    return map_batches(state, run, STATE_DDL)


def moved(done: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroids after a round and the radius of every cluster around its centroid before; k x dim rows come back."""
    k, dim = centres.shape
    new, radius = centres.copy(), np.zeros(k)
    sums = done.where(F.col("kind") == SUMS).select("cluster", "n", F.posexplode("q").alias("i", "x"))
    for r in sums.groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
        new[r.cluster, r.i] = r.x // r.n
    for r in done.where(F.col("kind") == FARTHEST).groupBy("cluster").agg(F.max("distance").alias("d")).collect():
        radius[r.cluster] = np.sqrt(float(r.d)) * (1 + EPS)
    return new, radius


def cluster(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared`` for each kept vector.

    ``compared`` tells whether the last pass had to compare the vector with all centroids. Vectors that are null, of
    another length or with a null or non-finite component are left out. Repeated rows each count and get a row; ties go
    to the smaller number; fewer than ``k`` vectors make as many centroids, none an empty table. A null id is kept, and
    is the last to become a centroid. Components beyond MOST (after scaling) are an error. Other columns aren't read.
    """
    spark = df.sparkSession
    vectors = settle(integer_vectors(df, id_col, vec_col, dim, scale))
    centres, loosen = first_centroids(vectors, k, seed), None
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, compared boolean"
    if not len(centres):
        return spark.createDataFrame([], out)
    state = vectors
    for left in range(rounds, -1, -1):
        done = settle(assign(state, centres, loosen), "kind")
        state = done.where(F.col("kind") == VECTORS).select("vec_id", "q", "cluster", "lower")
        if left:
            new, radius = moved(done, centres)
            loosen, centres = loosening(centres.astype(float), new.astype(float), radius), new
    each = {r.cluster: r.d for r in done.where(F.col("kind") == SUMS).groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    table = spark.createDataFrame([(j, each.get(j, 0), sum(each.values()), names[j]) for j in range(len(names))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    last = done.where(F.col("kind") == VECTORS).select("vec_id", "cluster", "distance", (F.col("n") == 1).alias("compared"))
    return last.join(F.broadcast(table), "cluster").select(*(x.split()[0] for x in out.split(", ")))  # k rows


def oracle(k: int = 40, rounds: int = 5) -> str:
    """DuckDB SQL: every vector against every centroid in every round."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS j, q FROM (SELECT sha256('2:' || vec_id) AS h, q FROM kept ORDER BY h, q LIMIT {k}))",
    ]
    for t in range(rounds + 1):
        steps.append(
            f"a{t} AS MATERIALIZED (SELECT id, vec_id, any_value(q) AS q, min({{'d': d, 'j': j}}) AS best FROM (SELECT k.id, k.vec_id, k.q, c.j, "
            f"CAST(list_sum(list_transform(list_zip(k.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept k CROSS JOIN c{t} c) GROUP BY id, vec_id)"
        )
        if t < rounds:
            steps.append(
                f"m{t} AS MATERIALIZED (SELECT j, list(x ORDER BY i) AS q FROM (SELECT best.j AS j, i, CAST(floor_div AS BIGINT) AS x FROM (SELECT best.j AS jj, i, any_value(best) AS best, "
                f"(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div FROM (SELECT best, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{t}) GROUP BY jj, i)) GROUP BY j)"
            )
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.q, c.q) AS q FROM c{t} c LEFT JOIN m{t} m USING (j))")
    return (
        f"WITH {', '.join(steps)} SELECT a.vec_id, CAST(a.best.j AS INTEGER) AS cluster, a.best.d AS distance, "
        "CAST(sum(a.best.d) OVER (PARTITION BY a.best.j) AS BIGINT) AS cluster_inertia, CAST(sum(a.best.d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c.q, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.j = a.best.j"
    )


ORACLE = oracle()


def op11_clusters(spark, sf_dir: str) -> DataFrame:
    """``cluster`` with the contract's parameters on the whole table ``embeddings``; see there for odd rows."""
    return cluster(read_table(spark, sf_dir, "embeddings")).drop("compared")
