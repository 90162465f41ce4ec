"""Embeddings centred, rotated to their principal components and scaled to unit variance.

Entries become whole numbers first, so sums and squared deviations are exact. Centred rows get a
dense index and go into MLlib's ``BlockMatrix``: blocks of some ``BLOCK_ENTRIES`` numbers, spread
over the executors. The transposed matrix times the matrix is the scatter; its middle dimension
is split, so that many tasks each add up the products of some blocks and send one small matrix on,
and no task sees all rows. The scatter, whose size depends on the dimension alone, is decomposed
on the driver with ``eigh``. A second block product with the whitening matrix projects all rows.

Defined results: rows whose vector is null, empty, or holds a null or non-finite entry are
dropped. Vectors of several lengths: the most frequent length (of equally frequent ones the
larger) is the dimension, and rows of another are dropped as well. A row is known by its index,
so repeated rows and null or repeated ids each get their own result. Components of equal
eigenvalues come in the order that ``eigh`` gives, and each component's largest entry is
positive. A component whose eigenvalue is zero (to rounding) has no whitened value (null) and
does not count in ``identity_error``; with no variance at all ``explained`` and
``identity_error`` are null. ``deviation`` is null where it does not fit a long. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orgweft.llm.stages import stored

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
BLOCK_ENTRIES = 1 << 18
BLOCK_COLUMNS = 1024
_PLACE_MASK = (1 << 33) - 1


def _numbers(docs: DataFrame) -> DataFrame:
    """``vec_id, x`` of the rows that take part, written once with a dense ``index``."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    entries = F.col("embedding").cast("array<double>")
    whole = F.transform(entries, lambda c: F.floor(c * F.lit(float(SCALE))).cast("bigint") + F.lit(SHIFT))
    valid = docs.select("vec_id", "embedding").where(
        F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(entries, finite)
    )
    placed = stored(
        valid.select(
            "vec_id",
            whole.alias("x"),
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE_MASK)).alias("place"),
        ),
        "numbers",
    )
    lengths = placed.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("d")).limit(2).collect()
    if len(first) > 1:
        # The places of rows of other lengths would be gaps: they are numbered anew without them.
        return _numbers(docs.where(F.size("embedding") == first[0]["d"]))
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    return placed.join(offsets, "part").select((F.col("offset") + F.col("place")).alias("index"), "vec_id", "x")


def _sums(numbers: DataFrame) -> tuple[int, list[int]]:
    """Rows, and the sum of each dimension."""
    n = numbers.count()
    each = numbers.select(F.posexplode("x").alias("d", "c")).groupBy("d").agg(F.sum("c").alias("s"))
    return n, [row["s"] for row in each.orderBy("d").collect()]


def _centred(n: int, sums: list[int]) -> Column:
    """``n * x - S`` of each dimension, exact."""
    return F.zip_with("x", F.array(*[F.lit(s) for s in sums]), lambda a, s: a * F.lit(n) - s)


def _deviation(centred: Column) -> Column:
    total = F.aggregate(
        centred,
        F.lit(0).cast("decimal(38,0)"),
        lambda done, c: (done + c.cast("decimal(19,0)") * c.cast("decimal(19,0)")).cast("decimal(38,0)"),
    )
    return F.when(total <= F.lit((1 << 63) - 1).cast("decimal(38,0)"), total.cast("bigint"))


def block_matrix(numbers: DataFrame, n: int, sums: list[int]) -> BlockMatrix:
    """The centred rows as distributed blocks."""
    rows = numbers.select(
        "index",
        array_to_vector(F.transform(_centred(n, sums), lambda c: c.cast("double") / F.lit(float(n)))).alias("vector"),
    )
    columns = min(BLOCK_COLUMNS, len(sums))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(rows, "vector"), n, len(sums)).toBlockMatrix(
        max(1, BLOCK_ENTRIES // columns), columns
    )


def product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left`` times ``right`` with the middle dimension in ``splits`` parts.

    Python's ``multiply`` lacks the argument, without which every block of a tall matrix's
    scatter would meet in one task.
    """
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transposed matrix times the matrix, as a local array of the dimension's size."""
    partitions = int(callMLlibFunc("getMatrixBlocks", matrix._java_matrix_wrapper._java_model).rdd.getNumPartitions())
    splits = max(1, min(matrix.numRowBlocks, partitions))
    return product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray()


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values[order], vectors * np.where(signs == 0, 1, signs)


def _block_of(matrix: BlockMatrix, local: np.ndarray) -> BlockMatrix:
    """A small local matrix in blocks that fit the right side of ``matrix``."""
    height = matrix.colsPerBlock
    context = matrix.blocks.context
    parts = [
        ((i, 0), Matrices.dense(len(p), p.shape[1], p.T.ravel().tolist()))
        for i, p in enumerate(local[at : at + height] for at in range(0, len(local), height))
    ]
    return BlockMatrix(context.parallelize(parts, 1), height, local.shape[1], *local.shape)


def project(matrix: BlockMatrix, local: np.ndarray) -> DataFrame:
    """``index, vector`` (array of doubles): the rows of the matrix times a local one."""
    rows = product(matrix, _block_of(matrix, local), 1).toIndexedRowMatrix()
    frame = callMLlibFunc("getIndexedRows", rows._java_matrix_wrapper._java_model)
    frame = MLUtils.convertVectorColumnsToML(frame, "vector")
    return frame.select("index", vector_to_array("vector").alias("vector"))


def _identity_error(projected: DataFrame, kept: list[int]) -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity; one stable pass."""
    if not kept:
        return None
    pairs = [(i, j) for i in kept for j in kept if i <= j]
    entry = lambda i: F.get("vector", F.lit(i))
    row = projected.agg(*[F.covar_pop(entry(i), entry(j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


SCHEMA = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``, one row per
    remaining row and component.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    numbers = stored(_numbers(embeddings), "indexed")
    n, sums = _sums(numbers)
    if not n:
        return spark.createDataFrame([], f"vec_id {kind}, {SCHEMA}")
    matrix = block_matrix(numbers, n, sums)
    covariance = scatter(matrix) / n
    values, vectors = principal(covariance, components)
    trace = float(np.trace(covariance))
    kept = [i for i, e in enumerate(values) if e > len(sums) * np.finfo(float).eps * max(values[0], 0)]
    scale = np.array([1 / np.sqrt(e) if i in kept else 0.0 for i, e in enumerate(values)])
    projected = stored(project(matrix, vectors * scale), "projected")
    error = F.lit(_identity_error(projected, kept)).cast("double")
    per_component = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("component"),
                (F.get("vector", F.lit(i)) if i in kept else F.lit(None).cast("double")).alias("whitened"),
                F.lit(max(float(e), 0.0) / trace if trace > 0 else None).cast("double").alias("explained"),
            )
            for i, e in enumerate(values)
        ]
    )
    rows = numbers.select("index", "vec_id", _deviation(_centred(n, sums)).alias("deviation"))
    return (
        rows.join(projected, "index")
        .withColumn("c", F.explode(per_component))
        .select(
            "vec_id",
            "c.component",
            F.lit(n).cast("bigint").alias("n"),
            "deviation",
            "c.whitened",
            "c.explained",
            error.alias("identity_error"),
        )
    )
