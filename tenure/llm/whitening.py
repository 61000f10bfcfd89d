"""Embedding whitening (operator 13) with Spark MLlib's distributed matrices.

Every entry c of a vector becomes the whole number floor(64 c) + 1,000,000, so
that sums and deviations are exact.  The fit list holds each distinct vector
once.  Its centred rows are indexed into a BlockMatrix; the transpose times
the matrix is the scatter, whose eigenvectors a local ``eigh`` finds (a matrix as
wide as a vector).  The whitening matrix (eigenvectors over the square roots
of their eigenvalues) is a BlockMatrix again, and multiplying by it projects
the rows.

Scale: rows are numbered by the sizes of the written table's parts, without a
sort.  Blocks hold ``BLOCK_ROWS`` rows; the scatter's sum over row blocks is cut
into as many parts as there are tasks (``numMidDimSplits``), so that no task
multiplies all of them.  All rows, copies included, are projected in blocks of
their own and meet their ids again by row number, a key that no two rows share,
so a vector that very many rows hold is no hot key.  Only sums, the scatter and
the whitening matrix pass through the driver, a vector's width in size.

Defined results: rows whose vector is null, empty, or holds a null or
non-finite entry (or one of 2 to the power of 56) are left out, as are vectors of another width than most
(ties: the wider); repeated rows and ids are each projected; directions
without variance (an eigenvalue at most ``RANK`` times the largest) have no
component, so an empty table, one vector or copies of one give no rows; a
deviation too large for a long is null; other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.session import stage_shared

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
BLOCK_ROWS, BLOCK_COLUMNS = 1024, 1024
RANK = 1e-12
LARGEST = 2.0**56       # of an entry: what is larger (an infinity, and NaN, which Spark holds to be larger) is left out


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x) of the rows that remain, written once: x holds whole numbers."""
    c = F.col(f"`{vector_col}`").cast("array<double>")
    good = rows.where(c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & (F.abs(v) < LARGEST))).select(
        F.col(f"`{id_col}`").alias("id"), F.transform(c, lambda v: (F.floor(v * SCALE) + SHIFT).cast("bigint")).alias("x"))
    written = stage_shared(good.withColumn("width", F.size("x")), "vectors")
    widths = written.groupBy("width").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), F.desc("width")).first()
    return written.where(F.col("width") == (widths["width"] if widths else 0)).drop("width")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, written, with ``row``: numbers from 0 without gaps, by the parts they were written in."""
    marked = stage_shared(rows.withColumn("mark", F.monotonically_increasing_id()), name)
    part = F.shiftright("mark", 33)
    sizes = marked.groupBy(part.alias("part")).agg(F.max("mark").alias("last"), F.count(F.lit(1)).alias("n")).collect()
    # A number for each task that wrote: its rows' marks count up from the part's own start.
    starts, total = [], 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        starts.append((r["part"], total - (r["part"] << 33)))
        total += r["n"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "part bigint, offset bigint"))
    return marked.withColumn("part", part).join(offsets, "part").withColumn("row", F.col("mark") + F.col("offset")).drop(
        "part", "mark", "offset")


def block_matrix(rows: DataFrame, mean: np.ndarray, width: int, n: int) -> BlockMatrix:
    """The vectors of ``rows`` (row, x), less ``mean``, as a distributed matrix."""
    centre = F.array(*[F.lit(float(m)) for m in mean])
    vectors = rows.select("row", array_to_vector(F.zip_with("x", centre, lambda a, b: a.cast("double") - b)).alias("vector"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, width)
    return indexed.toBlockMatrix(BLOCK_ROWS, BLOCK_COLUMNS)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transpose times the matrix.  The sum over row blocks is cut into parts that are multiplied apart."""
    spark = matrix.blocks.ctx
    parts = max(1, min(matrix.numRows() // BLOCK_ROWS + 1, spark.defaultParallelism))
    made = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, parts)
    return BlockMatrix(made, BLOCK_COLUMNS, BLOCK_COLUMNS).toLocalMatrix().toArray()


def local_blocks(spark, matrix: np.ndarray) -> BlockMatrix:
    """A small matrix as a distributed one."""
    height, width = matrix.shape
    blocks = [((i // BLOCK_COLUMNS, j // BLOCK_COLUMNS), DenseMatrix(*part.shape, part.ravel(order="F").tolist()))
              for i in range(0, height, BLOCK_COLUMNS) for j in range(0, width, BLOCK_COLUMNS)
              for part in [matrix[i:i + BLOCK_COLUMNS, j:j + BLOCK_COLUMNS]]]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, 1), BLOCK_COLUMNS, BLOCK_COLUMNS, height, width)


def rows_of(matrix: BlockMatrix, name: str) -> DataFrame:
    """(row, values) of a distributed matrix."""
    indexed = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return indexed.select(F.col("index").alias("row"), vector_to_array("vector").alias(name))


class Whitening:
    """What the fit list determines: ``n``, ``sums`` (exact), eigenvalues, the whitening matrix, and how far the
    whitened fit list's covariance is from the identity."""

    def __init__(self, vectors: DataFrame, components: int = COMPONENTS):
        spark = vectors.sparkSession
        fit = numbered(vectors.select("x").distinct(), "fit_list")
        sums = fit.select(F.posexplode("x").alias("place", "value")).groupBy("place").agg(
            F.sum(F.col("value").cast("decimal(38,0)")).alias("sum")).collect()         # a row for each dimension
        self.n = fit.count()
        self.sums = [int(r["sum"]) for r in sorted(sums, key=lambda r: r["place"])]
        self.width, self.components, self.explained, self.identity_error = len(self.sums), 0, [], None
        if not self.n:
            return
        # The mean to the nearest double: sum and number are whole.
        self.mean = np.array([s // self.n + (s % self.n) / self.n for s in self.sums])
        matrix = block_matrix(fit, self.mean, self.width, self.n)
        covariance = scatter(matrix) / self.n
        values, vectors_ = np.linalg.eigh((covariance + covariance.T) / 2)
        order = np.argsort(-values)
        values, vectors_ = values[order], vectors_[:, order]
        self.components = int((values[:components] > RANK * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
        if not self.components:
            return
        self.explained = (values[:self.components] / values.sum()).tolist()
        self.matrix = vectors_[:, :self.components] / np.sqrt(values[:self.components])
        whitened = scatter(matrix.multiply(local_blocks(spark, self.matrix))) / self.n
        self.identity_error = float(np.abs(whitened - np.eye(self.components)).max())

    def project(self, vectors: DataFrame) -> DataFrame:
        """(id, x, whitened) of all rows."""
        rows = numbered(vectors, "numbered_vectors")
        matrix = block_matrix(rows, self.mean, self.width, vectors.count())
        return rows.join(rows_of(matrix.multiply(local_blocks(vectors.sparkSession, self.matrix)), "whitened"), "row")


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each remaining vector and component: ``n``, the vector's exact ``deviation``, its ``whitened``
    coordinate, the component's ``explained`` share of the variance and the fit's ``identity_error``."""
    vectors = whole_vectors(rows, id_col, vector_col)
    fit = Whitening(vectors, components)
    kind = rows.schema[id_col].dataType.simpleString()
    if not fit.components:
        return rows.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n bigint, deviation bigint,"
                                                     " whitened double, explained double, identity_error double")
    wide = "decimal(38,0)"
    sums = F.array(*[F.lit(s).cast(wide) for s in fit.sums])
    parts = F.zip_with(
        "x", sums, lambda a, s: (F.lit(fit.n).cast("decimal(19,0)") * a.cast("decimal(19,0)")).cast(wide) - s)
    total = F.aggregate(F.transform(parts, lambda d: d.try_cast("decimal(19,0)") * d.try_cast("decimal(19,0)")), F.lit(0).cast(wide),
                        lambda a, b: (a + b).cast(wide))
    explained = F.array(*[F.lit(e) for e in fit.explained])
    made = fit.project(vectors).select("id", total.try_cast("bigint").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return made.select(F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"),
                       F.lit(fit.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"),
                       F.lit(fit.identity_error).alias("identity_error"))
