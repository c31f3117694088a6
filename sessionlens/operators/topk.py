"""Exact top-k keys by count, without a shuffle of every key.

1. Each task keeps a mergeable heavy-hitter summary of its rows: at most
   ``capacity`` keys with counts; when there are more, the largest count that does
   not fit is taken off all of them and added to the task's error.  So a summed
   count is too low by at most the sum of the errors.
2. The summaries (tasks x capacity rows) are added up per key.  A key whose count
   plus the error falls short of the k-th largest count of its group cannot be
   among the first k; the others are candidates, few of them where counts differ.
3. The candidates are counted exactly, and ranked by the caller.

Where that cannot prove the answer (a k-th largest count no larger than the error, so
that keys of no summary might be among the first; fewer than k keys of a group left in
the summaries; more than ``most_candidates`` candidates) every key is counted: the
result is the same, only the shuffle larger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

#: Keys that a task's summary holds, and candidates that are sent to all tasks (about 20 MB of paths).
CAPACITY, CANDIDATES = 20_000, 20_000


def summaries(rows: DataFrame, keys: list[str], weight: str | None, capacity: int = CAPACITY) -> DataFrame:
    """Per task: its keys with ``n`` (at most the true count), and one row with ``is_error``, where ``n`` is its error."""
    src = rows.select(*keys, *([F.col(weight).cast("long").alias("n")] if weight else [F.lit(1).cast("long").alias("n")]))
    fields = [StructField(f.name, f.dataType) for f in src.select(*keys).schema.fields]  # nullable: the error's row has no key
    schema = StructType([*fields, StructField("n", LongType()), StructField("is_error", BooleanType())])
    arrow = to_arrow_schema(StructType(schema.fields[:-1]))

    def run(batches):
        held, error = pa.Table.from_batches([], arrow), 0
        for batch in batches:
            both = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(arrow)])
            held = both.group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"]).cast(arrow)
            if held.num_rows > 2 * capacity:
                held, off = pruned(held, capacity)
                error += off
        if held.num_rows > capacity:
            held, off = pruned(held, capacity)
            error += off
        for part in held.combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.zeros(part.num_rows, bool))], names=schema.names)
        none = [pa.nulls(1, t) for t in arrow.types[:-1]]
        yield pa.RecordBatch.from_arrays([*none, pa.array([error], pa.int64()), pa.array([True])], names=schema.names)

    return src.mapInArrow(run, schema)


def pruned(table: pa.Table, capacity: int) -> tuple[pa.Table, int]:
    """The ``capacity`` largest counts less the largest of the rest, which is the error."""
    n = table["n"].to_numpy()
    off = int(np.partition(n, len(n) - capacity - 1)[len(n) - capacity - 1])
    left = table.filter(pc.greater(table["n"], off))
    return left.set_column(left.num_columns - 1, "n", pc.subtract(left["n"], off)), off


def candidates(rows: DataFrame, keys: list[str], group: list[str], k: int, weight: str | None = None,
               capacity: int = CAPACITY, most_candidates: int = CANDIDATES) -> DataFrame | None:
    """The keys (``keys`` includes ``group``) that may be among the ``k`` of largest count of their group.

    None where the summaries cannot prove which: the caller counts every key.
    """
    spark = rows.sparkSession
    found = summaries(rows, keys, weight, capacity).groupBy("is_error", *keys).agg(F.sum("n").alias("n")).persist()
    try:
        error = found.where("is_error").agg(F.sum("n")).first()[0] or 0
        kept = found.where("not is_error")
        by_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
        first = kept.withColumn("_rk", F.row_number().over(by_group.orderBy(F.col("n").desc()))).where(F.col("_rk") <= k)
        kth = first.groupBy(*group).agg(F.min("n").alias("_kth"), F.count("n").alias("_n"))
        unseen = (F.col("_n") < k) | (F.col("_kth") <= error)  # a key that no summary holds may count up to the error
        if error and kth.where(unseen).limit(1).count():
            return None
        near = kept.withColumn("_one", F.lit(1)).join(F.broadcast(kth.withColumn("_one", F.lit(1))), ["_one", *group])
        near = near.where(F.col("n") + F.lit(error) >= F.col("_kth")).select(*keys)
        chosen = near.limit(most_candidates + 1).collect()  # bounded: they are sent to all tasks
        if len(chosen) > most_candidates:
            return None
        return spark.createDataFrame(chosen, near.schema)
    finally:
        found.unpersist()


def only(rows: DataFrame, keys: list[str], chosen: DataFrame | None) -> DataFrame:
    """The rows of the chosen keys (all rows where none are chosen); null keys match each other."""
    if chosen is None:
        return rows
    right = F.broadcast(chosen.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)]))
    match = [rows[k].eqNullSafe(F.col(f"_c{i}")) for i, k in enumerate(keys)]
    condition = match[0]
    for m in match[1:]:
        condition = condition & m
    return rows.join(right, condition, "left_semi")
