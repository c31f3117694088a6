"""Exact grouped medians with bounded per-task memory.

Spark's exact ``median`` keeps every distinct value of a group in one task.
A segment can hold a large share of all users, so instead:

1. one grouped pass: per group and column the non-null count ``n`` and an
   approximate bracket [lo, hi] around the middle from ``percentile_approx``
   (a bounded sketch whose rank error is at most n/accuracy; the bracket is
   ``margin`` times wider, so it always holds both middle ranks).  Extra
   aggregates (e.g. means) ride along in the same pass;
2. a second pass joins the one-row-per-group brackets back and keeps, per
   column, only values inside the bracket, plus one bucket counting the
   values below it; a grouped count turns that into a small histogram;
3. cumulative counts over the histogram find the two middle values, which
   are averaged (linear interpolation, as pandas/DuckDB median).

Nulls and NaN are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _clean(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def grouped_median(
    df: DataFrame,
    group_cols: list[str],
    value_cols: list[str],
    suffix: str = "_median",
    accuracy: int = 10000,
    margin: int = 20,
    extra_aggs: list[Column] | None = None,
) -> DataFrame:
    """One row per group with ``<col><suffix>`` (and any ``extra_aggs``).

    The bracket comes from a sketch; the plan itself checks that it holds the
    middle ranks (counts below it and up to its end) and raises if not.
    """
    extra_aggs = list(extra_aggs or [])
    if not value_cols:
        return df.groupBy(*group_cols).agg(*extra_aggs) if extra_aggs else df.select(*group_cols).distinct()
    delta = min(0.5, margin / accuracy)
    stats = df.groupBy(*group_cols).agg(
        *extra_aggs,
        *[F.count(_clean(c)).alias(f"_n{i}") for i, c in enumerate(value_cols)],
        *[F.percentile_approx(_clean(c), [0.5 - delta, 0.5 + delta], accuracy).alias(f"_q{i}")
          for i, c in enumerate(value_cols)],
    )
    brackets = stats.select(*group_cols, *[f"_q{i}" for i in range(len(value_cols))])
    # per row and column: the value if inside the bracket, a null "below" marker, or nothing
    items = []
    for i, c in enumerate(value_cols):
        v, lo, hi = _clean(c), F.col(f"_q{i}")[0], F.col(f"_q{i}")[1]
        keep = v.isNotNull() & (v <= hi)
        items.append(F.when(keep, F.struct(F.lit(i).alias("_f"), F.when(v >= lo, v).alias("_v"))))
    kept = (
        df.select(*group_cols, *value_cols)
        .join(brackets, group_cols)
        .select(*group_cols, F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("_x"))
        .select(*group_cols, "_x._f", "_x._v")
    )
    keys = list(group_cols) + ["_f"]
    hist = kept.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    # the null bucket (values below the bracket) sorts first
    cum = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
                           .rowsBetween(Window.unboundedPreceding, 0))
    counts = stats.select(
        *group_cols,
        F.explode(F.array(*[F.struct(F.lit(i).alias("_f"), F.col(f"_n{i}").alias("_n"))
                            for i in range(len(value_cols))])).alias("_y"),
    ).select(*group_cols, "_y._f", "_y._n")
    r_lo = F.floor((F.col("_n") - 1) / 2)
    r_hi = F.ceil((F.col("_n") - 1) / 2)
    picked = (
        hist.withColumn("_cum", cum)
        .join(counts, keys)
        .groupBy(*keys)
        .agg(
            F.min(F.when(F.col("_cum") > r_lo, F.col("_v"))).alias("_a"),
            F.min(F.when(F.col("_cum") > r_hi, F.col("_v"))).alias("_b"),
            F.bool_and(F.when(F.col("_v").isNull(), F.col("_cum") <= r_lo).otherwise(F.lit(True))).alias("_low_ok"),
            F.bool_or(F.col("_cum") > r_hi).alias("_high_ok"),
        )
        .where(F.when(F.col("_low_ok") & F.col("_high_ok"), F.lit(True)).otherwise(
            F.raise_error(F.lit("median: the sketch bracket misses the middle ranks; raise margin"))))
    )
    medians = picked.groupBy(*group_cols).agg(
        *[F.max(F.when(F.col("_f") == i, (F.col("_a") + F.col("_b")) / 2.0)).alias(f"{c}{suffix}")
          for i, c in enumerate(value_cols)]
    )
    keep_stats = stats.drop(*[f"_n{i}" for i in range(len(value_cols))], *[f"_q{i}" for i in range(len(value_cols))])
    return keep_stats.join(medians, group_cols, "left")
