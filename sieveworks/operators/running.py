"""Numbers and running sums over a whole table in order, in two passes over range partitions.

Rows are dealt by ranges of the order and sorted within, so a row's place is its place within
its range and the sizes of the ranges before it, and likewise for sums. What goes over all ranges
is one row a range; no window holds more than that, whatever the ids look like.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut

#: The bits of `monotonically_increasing_id` that count rows within a partition.
_ROW_BITS = 33


def _ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *order).sortWithinPartitions(*order)


def _unlike(name: str, columns: list[str]) -> str:
    """A name that no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def _before(held: DataFrame, part: str, sums: dict[str, str]) -> DataFrame:
    """``part`` and, for each of ``sums``, its total over all parts before it: a row a part."""
    totals = held.groupBy(part).agg(*[F.expr(x).alias(c) for c, x in sums.items()])
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return totals.select(part, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in sums])


def number_rows(rows: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """``rows`` with ``name``, a number from 0 on in the order of ``order`` (nulls first; ties in any order), without gaps.

    The columns of the order may be of any kind that can be sorted. An empty table gives no rows.
    """
    rows = rows.drop(name)
    at, part, row, before = (_unlike(x, [*rows.columns, name]) for x in ("_at", "_part", "_row", "_before"))
    held = cut(_ranged(rows, list(order)).withColumn(at, F.monotonically_increasing_id()))
    held = held.select(*rows.columns, F.shiftright(at, _ROW_BITS).alias(part), F.col(at).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias(row))
    placed = held.join(F.broadcast(_before(held, part, {before: "count(*)"})), part)
    return placed.select(*rows.columns, (F.col(before) + F.col(row)).cast("long").alias(name))


def running_sums(rows: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``rows`` with a column for each of ``sums`` (name: numeric column): its sum up to this row, this one included.

    Nulls count as 0. Rows of equal order are summed in some order. An empty table gives no rows.
    """
    names = list(sums)
    part = _unlike("_part", [*rows.columns, *names])
    own, before = ({c: _unlike(f"_{kind}_{c}", [*rows.columns, *names]) for c in names} for kind in ("sum", "before"))
    schema = T.StructType([*rows.schema.fields, T.StructField(part, T.IntegerType()), *[T.StructField(own[c], T.DoubleType()) for c in names]])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, so_far = TaskContext.get().partitionId(), {c: 0.0 for c in names}
        for batch in batches:
            added = [pa.array(np.full(batch.num_rows, place, dtype=np.int32))]
            for c in names:
                values = np.nan_to_num(np.asarray(batch.column(sums[c]).to_pandas(), dtype=np.float64))
                summed = so_far[c] + np.cumsum(values)
                so_far[c] = float(summed[-1]) if len(summed) else so_far[c]
                added.append(pa.array(summed))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, part, *own.values()])

    held = cut(_ranged(rows, order).mapInArrow(within, schema))
    offsets = _before(held, part, {before[c]: f"coalesce(sum(`{sums[c]}`), 0)" for c in names})
    placed = held.join(F.broadcast(offsets), part)
    return placed.select(*rows.columns, *[(F.col(own[c]) + F.col(before[c])).alias(c) for c in names])


def running_accuracy(judged: DataFrame, order: list[str], correct: str = "correct") -> DataFrame:
    """``judged`` with ``done`` and ``right``, the rows and the correct ones so far, and ``accuracy``, their share."""
    one, right = (_unlike(x, judged.columns) for x in ("_one", "_right"))
    out = running_sums(judged.withColumn(one, F.lit(1)).withColumn(right, F.col(correct).cast("int")), order, {"done": one, "right": right})
    out = out.withColumns({"done": F.col("done").cast("long"), "right": F.col("right").cast("long")}).drop(one, right)
    return out.withColumn("accuracy", F.col("right") / F.col("done"))
