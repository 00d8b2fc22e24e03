"""Vector arithmetic on array columns."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 for null, empty, unequally long or zero vectors."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    fine = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.coalesce(F.when(fine, dot(a, b) / norm), F.lit(0.0))


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


#: Vectors in a pack, directions that packs are kept together by, and tasks that share the items of one scope.
PACK, PIVOTS, SPREAD = 1024, 8, 32
#: Packs of queries whose best a task remembers, 8 bytes times PACK times ``top`` each.
HELD = 8
BATCH_BYTES = 16 << 20


def packs(df: DataFrame, id_col: str, vec: str, scope: str | None, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``scope, dim, hand, ids, data, low, high``: packs of up to PACK unit vectors of one scope, length and nearest pivot.

    ``low`` and ``high`` are the smallest and largest angle to each pivot of that length. Packs are filled within a task,
    without a shuffle. Vectors that are null, empty or zero, and rows with a null scope, are in none.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    scoped = F.col(scope) if scope else F.lit(0)
    rows = df.select(scoped.alias("scope"), F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v")).where("size(v) > 0 AND scope IS NOT NULL")
    schema = rows.select("scope", F.lit(0).alias("dim"), F.lit(0).alias("hand"), F.array("id").alias("ids"), F.lit(b"").alias("data"), F.array(F.lit(0.0)).alias("low"), F.array(F.lit(0.0)).alias("high")).schema
    arrow = to_arrow_schema(schema)
    shared = df.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_packs: dict[tuple, list] = {}

        def close(key: tuple, held: list) -> pa.RecordBatch:
            m = unit(np.array([v for _, v in held]))
            towards = shared.value.get(key[1])
            angle = np.arccos(np.clip(m @ towards.T, -1, 1)) if towards is not None else np.zeros((len(m), 0))
            hand = zlib.crc32(repr(held[0][0]).encode()) % SPREAD
            row = {"scope": key[0], "dim": key[1], "hand": hand, "ids": [i for i, _ in held], "data": m.tobytes(), "low": angle.min(0).tolist(), "high": angle.max(0).tolist()}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for b in batches:
            for s, i, v in zip(b.column("scope").to_pylist(), b.column("id").to_pylist(), b.column("v").to_pylist()):
                if None in v or not any(v):
                    continue
                towards = shared.value.get(len(v))
                key = (s, len(v), int(np.argmax(towards @ v)) if towards is not None else 0)
                held = open_packs.setdefault(key, [])
                held.append((i, v))
                if len(held) == PACK:
                    yield close(key, open_packs.pop(key))
        for key, held in open_packs.items():
            yield close(key, held)

    return rows.mapInArrow(run, schema)


def choose_pivots(items: DataFrame, item_id: str, vec: str) -> dict[int, np.ndarray]:
    """Up to PIVOTS vectors of the items by length; any will do, they only decide which packs are compared."""
    rows = items.where(F.size(vec) > 0).orderBy(F.xxhash64(item_id)).limit(PIVOTS).select(F.col(vec).cast("array<double>").alias("v")).collect()
    out: dict[int, list] = {}
    for r in rows:
        if None not in r.v and any(r.v):
            out.setdefault(len(r.v), []).append(r.v)
    return {n: unit(np.array(v)) for n, v in out.items()}


def similarity_join(queries: DataFrame, q_id: str, q_vec: str, items: DataFrame, item_id: str, vec: str, top: int | None = None, least: float | None = None, scope: str | None = None) -> DataFrame:
    """``q_id, item_id, sim``: for each query the ``top`` most similar items (adds ``rank``; ties by item_id), or all with
    a cosine of ``least`` or more; with ``scope`` only items whose column of that name equals the query's.

    Both tables are packed into blocks by scope; every block of queries meets every block of items of its scope, dealt
    out over SPREAD tasks a scope, so no scope lands in one task and nothing passes the driver. With ``least`` blocks
    whose angles to some pivot lie farther apart than the angle allowed are not compared: two vectors within an angle
    differ by no more than it in their angles to any third. With ``top`` a pair of blocks passes on
    what is among the best that its task has seen for a query.
    Vectors that are null, empty, zero or of another length match nothing, nor do null scopes.
    """
    spark = queries.sparkSession
    limit = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not (limit.isdigit() and 0 < int(limit) <= BATCH_BYTES):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # rows hold whole blocks
    pivots = choose_pivots(items, item_id, vec) if least is not None else {}
    q = packs(queries, q_id, q_vec, scope, pivots).withColumn("hand", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    i = packs(items, item_id, vec, scope, pivots).select("scope", "dim", "hand", F.col("ids").alias("i_ids"), F.col("data").alias("i_data"), F.col("low").alias("i_low"), F.col("high").alias("i_high"))
    pairs = q.join(i, ["scope", "dim", "hand"])
    if least is not None:
        far = F.zip_with(F.arrays_zip("low", "high"), F.arrays_zip("i_low", "i_high"), lambda a, b: F.greatest(a["low"] - b["i_high"], b["i_low"] - a["high"]))
        pairs = pairs.where(~F.exists(far, lambda x: x > float(np.arccos(np.clip(least, -1, 1))) + 1e-7))
    from pyspark.sql.pandas.types import to_arrow_type

    q_type, i_type = queries.schema[q_id].dataType, items.schema[item_id].dataType
    schema = pa.schema([("q_id", to_arrow_type(q_type)), ("item_id", to_arrow_type(i_type)), ("sim", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, np.ndarray] = {}  # the best of each query of the last packs
        for b in batches:
            for dim, ids, data, i_ids, i_data in zip(*(b.column(n).to_pylist() for n in ("dim", "ids", "data", "i_ids", "i_data"))):
                sims = np.frombuffer(data).reshape(-1, dim) @ np.frombuffer(i_data).reshape(-1, dim).T
                edge = least
                if top is not None:
                    key = (tuple(ids), data)
                    best = sims if key not in seen else np.concatenate([seen.pop(key), sims], axis=1)
                    if best.shape[1] > top:
                        best = np.partition(best, -top, axis=1)[:, -top:]
                    edge = best.min(axis=1, keepdims=True) - 1e-9 if best.shape[1] == top else -2
                    seen[key] = best.copy()
                    if len(seen) > HELD:
                        seen.pop(next(iter(seen)))
                at, col = np.nonzero(sims >= edge)
                yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type).take(pa.array(at)), pa.array(i_ids, schema.field(1).type).take(pa.array(col)), pa.array(sims[at, col])], schema=schema)

    out = pairs.select("dim", "ids", "data", "i_ids", "i_data").mapInArrow(run, f"q_id {q_type.simpleString()}, item_id {i_type.simpleString()}, sim double")
    if top is None:
        return out
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.round("sim", 9).desc(), "item_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top)
