"""Embedding whitening: principal components of the distinct vectors, by distributed block matrices.

Vectors are taken to integers (``floor(scale * c)``).  The distinct ones are the fit
list; their count, sums and deviations are exact integers.  Centred rows, indexed
by row number, become a block matrix; the transpose times the matrix is the scatter
of the fit list, summed over many tasks (the inner dimension is split); the driver
holds only that square and its eigenvectors; a block matrix of all centred rows times
the whitening matrix projects every row.

Vectors, row numbers and projections never pass the driver: it gets the number of
rows of each partition, the sums, one square matrix and, for each block of rows, a pair
of numbers (MLlib plans a multiplication by the places of the blocks).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from sessionlens.session import remove_written, written

#: Vectors of more dimensions are refused: the driver holds a square of them.
MAX_DIMENSIONS = 8192
#: Doubles of a block of rows (8 MB), columns of a block.
BLOCK_DOUBLES, BLOCK_COLUMNS = 1 << 20, 1024
#: Row blocks that one task of the scatter multiplies.
BLOCKS_PER_TASK = 4
#: A component of less than this part of the largest eigenvalue has no variance.
NO_VARIANCE = 1e-12


def usable(vector: Column) -> Column:
    """Whether a vector and all its entries are there and finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def numbered_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """The usable rows as ``row`` (numbered without gaps from 0), ``vec_id`` and ``x``; how many; their dimensions.

    The commonest length (of equally common ones the largest) is that of the fit.
    """
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).filter(usable(F.col("v")))
    src = written(src.select(F.monotonically_increasing_id().alias("key"), "vec_id", integers(F.col("v"), scale).alias("x")), "vectors")
    length = src.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    if length is None or length.d == 0:
        return src.select(F.lit(0).cast("long").alias("row"), "vec_id", "x").filter("false"), 0, 0
    if length.d > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {length.d} dimensions; the driver solves squares of up to {MAX_DIMENSIONS}")
    same = src.filter(F.size("x") == length.d)
    part = F.shiftright("key", 33)
    counts = sorted((r.part, r.n, r.low) for r in same.groupBy(part.alias("part")).agg(F.count("key").alias("n"), F.min("key").alias("low")).collect())
    if sum(n for _, n, _ in counts) != length["count"]:
        raise RuntimeError("the written vectors changed")
    if length["count"] != src.count():  # rows of other lengths leave gaps: number the rest on its own
        same = written(same.select(F.monotonically_increasing_id().alias("key"), "vec_id", "x"), "vectors-of-a-length")
        counts = sorted((r.part, r.n, r.low) for r in same.groupBy(part.alias("part")).agg(F.count("key").alias("n"), F.min("key").alias("low")).collect())
    offsets, total = [], 0
    for own, n, low in counts:
        offsets.append((own, total - low))
        total += n
    shift = vectors.sparkSession.createDataFrame(offsets, "part long, shift long")
    rows = same.withColumn("part", part).join(shift, "part").select((F.col("key") + F.col("shift")).alias("row"), "vec_id", "x")
    return rows, total, length.d


def column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension, added up per task first."""

    def run(batches):
        n, sums = 0, np.zeros(d, object)  # sums beyond 64 bits stay exact
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            n += len(x)
            high = x >> 32
            sums += [(int(h) << 32) + int(low) for h, low in zip(high.sum(0), (x - (high << 32)).sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([str(v) for v in (n, *sums)])], names=["dim", "total"])

    out = [0] * (d + 1)
    rows = fit.select("x").mapInArrow(run, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    for row in rows.collect():
        out[row.dim + 1] = int(row.total)
    return out[0], out[1:]


def block_matrix(rows: DataFrame, n: int, sums: list[int], n_rows: int) -> BlockMatrix:
    """Centred rows (``row``, ``x``) as a block matrix of ``n_rows`` rows; rows that are not given are zero."""
    d = len(sums)
    means = [s / n for s in sums]
    centred = F.zip_with("x", F.lit(means), lambda v, mean: v - mean)
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("row", array_to_vector(centred).alias("v")), "v")
    per_block = max(1, BLOCK_DOUBLES // d)
    return IndexedRowMatrix(vectors, n_rows, d).toBlockMatrix(per_block, min(d, BLOCK_COLUMNS))


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix; the products of different rows are made by different tasks.

    PySpark's ``multiply`` leaves out the second argument of the JVM's, into how
    many parts the inner dimension is split; without it one task would get every row.
    """
    blocks = -(-matrix.numRows() // matrix.rowsPerBlock)
    own = matrix._java_matrix_wrapper
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", own._java_model, -(-blocks // BLOCKS_PER_TASK))
    square = BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()
    return (square + square.T) / 2


def whitening_matrix(square: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns that project a centred row to unit variance, by falling eigenvalue, and each one's part of the variance."""
    values, axes = np.linalg.eigh(square / n)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(0.0, NO_VARIANCE * values.max())]
    return axes[:, order] / np.sqrt(values[order]), values[order] / np.trace(square / n)


def projected(spark: SparkSession, matrix: BlockMatrix, whitening: np.ndarray) -> DataFrame:
    """``row`` and ``w`` (its whitened components) of every row of the matrix."""
    d, c = whitening.shape
    step = matrix.colsPerBlock
    own = [((k // step, 0), DenseMatrix(len(part), c, part.ravel(order="F"))) for k in range(0, d, step) for part in [whitening[k : k + step]]]
    product = matrix.multiply(BlockMatrix(spark.sparkContext.parallelize(own, 1), step, c, d, c))
    per_block = matrix.rowsPerBlock

    def rows(block):
        (place, _), values = block
        return [(place * per_block + k, w) for k, w in enumerate(values.toArray().tolist())]

    return spark.createDataFrame(product.blocks.flatMap(rows), StructType([StructField("row", LongType()), StructField("w", ArrayType(DoubleType()))]))


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, or holds null or non-finite entries, go; so do vectors
    of another than the commonest length.  Entries become ``x = floor(scale * c)``.
    The fit list is each distinct ``x`` once (``n`` of them, sums ``S``).  Components
    are the unit eigenvectors of its covariance (divisor n), numbered from 1 by
    falling eigenvalue, up to ``components``; those without variance are left out, so
    one distinct vector gives no rows.  ``deviation`` is the exact sum over
    dimensions of ``(n x - S)^2`` (null where it exceeds 64 bits), ``whitened`` the
    centred row on the component in standard deviations, ``explained`` its part of
    the variance and ``identity_error`` the largest absolute entry of the covariance
    of ``whitened`` over the fit list minus the identity, as measured on the results.

    Repeated rows, null and repeated ids are rows of their own; an empty table
    gives an empty one; other columns are not read, whatever their names.
    """
    fields = [vectors.select(F.col(id_col).alias("vec_id")).schema["vec_id"], StructField("component", IntegerType())]
    fields += [StructField(k, LongType()) for k in ("n", "deviation")] + [StructField(k, DoubleType()) for k in ("whitened", "explained", "identity_error")]
    rows, n_rows, d = numbered_vectors(vectors, scale, id_col, vector_col)
    nothing = vectors.sparkSession.createDataFrame([], StructType(fields))
    if not n_rows:
        return nothing
    fit = written(rows.groupBy("x").agg(F.min("row").alias("row")), "distinct-vectors")  # a vector of many copies is one row per task
    n, sums = column_sums(fit, d)
    whitening, explained = whitening_matrix(scatter(block_matrix(fit, n, sums, n_rows)), n, components)
    c = len(explained)
    if not c:
        return nothing
    rows_w = written(projected(vectors.sparkSession, block_matrix(rows, n, sums, n_rows), whitening), "whitened")
    error = identity_error(rows_w.join(fit.select("row"), "row"), c)
    remove_written(fit)
    one = lambda total, v: F.try_add(total, F.try_multiply(v, v))
    off = F.zip_with("x", F.lit(sums) if max(map(abs, sums)) < 1 << 63 else F.lit([None] * d).cast("array<long>"), lambda v, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), v), s))
    deviation = rows.select("row", "vec_id", F.aggregate(off, F.lit(0).cast("long"), one).alias("deviation"))
    whole = deviation.join(rows_w, "row").select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened"))
    parts = F.element_at(F.lit(explained.tolist()), F.col("place") + 1)
    return whole.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        parts.alias("explained"), F.lit(error).alias("identity_error"),
    )


def identity_error(rows: DataFrame, c: int) -> float:
    """The largest absolute entry of the covariance of ``w`` minus the identity."""
    pairs = [(i, j) for i in range(c) for j in range(i, c)]
    got = rows.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
