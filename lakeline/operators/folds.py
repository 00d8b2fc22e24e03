"""Sequential passes over the ordered items of a document.

Rows are dealt out by document, sorted, and stream through a task that carries only the current number and sum, so a
document of any length needs no more room than a batch and linear time. Passes that stop or restart at a budget can't
be written as window frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def number_runs(df: DataFrame, key: str, order: str | list[str], fields: dict, begin: tuple, step: Callable, out: str, carry: list[str] | None = None) -> DataFrame:
    """``key, order, out``: the number of each item, with the columns named by ``carry``. ``step(state, *fields)`` returns the next state, a tuple whose first
    value is the number; each key starts from ``begin``. ``order`` may name several columns. Items of equal order follow
    the order of their fields; null keys are one document; an empty table gives an empty one."""
    order = [order] if isinstance(order, str) else order
    places, names = [f"_order{i}" for i in range(len(order))], [f"_field{i}" for i in range(len(fields))]
    carry = carry or []
    loads = [f"_carry{i}" for i in range(len(carry))]
    d = df.select(F.col(key).alias("_key"), *(F.col(o).alias(n) for o, n in zip(order, places)), *(c.alias(n) for n, c in zip(names, fields.values())), *(F.col(c).alias(n) for c, n in zip(carry, loads)))
    schema = d.select("_key", *places, *loads, F.lit(0).alias("_number")).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), begin
        for b in batches:
            numbers = []
            for k, *row in zip(*(b.column(n).to_pylist() for n in ("_key", *names))):
                if k != now:
                    now, state = k, begin
                state = step(state, *row)
                numbers.append(state[0])
            kept = [b.column(n).cast(arrow.field(n).type) for n in ("_key", *places, *loads)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(numbers, pa.int32())], schema=arrow)

    sortable = [n for n, c in d.dtypes if n in names and not c.startswith("map")]
    dealt = d.repartition("_key").sortWithinPartitions("_key", *places, *sortable)
    return dealt.mapInArrow(run, schema).select(F.col("_key").alias(key), *(F.col(n).alias(o) for o, n in zip(order, places)), *(F.col(n).alias(c) for c, n in zip(carry, loads)), F.col("_number").alias(out))


def pack_budget(df: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """Number of the batch of each item: a new batch begins when the next item would exceed ``budget`` and the current
    batch is not empty; an item above the budget is a batch of its own; a null cost counts as 0."""

    def step(s, c):
        no, used = s
        return (no + 1, c) if used > 0 and used + c > budget else (no, used + c)

    return number_runs(df, key, order, {"cost": F.coalesce(F.col(cost).cast("long"), F.lit(0))}, (0, 0), step, "group_no")


def coalesce_small(df: DataFrame, key: str, order: str, cost: str, small: int = 80, most: int = 400) -> DataFrame:
    """Runs of items below ``small`` whose sum stays within ``most`` share a number; others stand alone; a null cost
    counts as 0."""

    def step(s, c):
        no, used = s  # used: sum of the open run, -1 behind an item that stands alone
        if c < small and used >= 0 and used + c <= most:
            return no, used + c
        return no + 1, (c if c < small else -1)

    return number_runs(df, key, order, {"cost": F.coalesce(F.col(cost).cast("long"), F.lit(0))}, (-1, -1), step, "group_no")
