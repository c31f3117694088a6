"""Row numbers over a whole table without a window in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionlens.session import written


def numbered(df: DataFrame, order: list[str], name: str = "row") -> tuple[DataFrame, int]:
    """``df`` with ``name``: 0, 1, ... in the order of the columns (which must tell all rows apart); and how many rows.

    The table is range-sorted and written once; each part has consecutive numbers
    within itself, and the parts' sizes (one pair of numbers per part on the
    driver) shift them to one sequence.
    """
    key, part = f"{name}_key", f"{name}_part"
    ordered = written(df.orderBy(*order).withColumn(key, F.monotonically_increasing_id()), "numbered")
    ordered = ordered.withColumn(part, F.shiftright(key, 33))
    counts = sorted((r[0], r.n, r.low) for r in ordered.groupBy(part).agg(F.count(key).alias("n"), F.min(key).alias("low")).collect())
    shifts, total = [], 0
    for own, n, low in counts:
        shifts.append((own, total - low))
        total += n
    shift = df.sparkSession.createDataFrame(shifts, f"{part} long, _shift long")
    return ordered.join(shift, part).select(*df.columns, (F.col(key) + F.col("_shift")).alias(name)), total
