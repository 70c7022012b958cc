"""Whitening of vectors by distributed block matrices.

Vectors hold whole numbers (`fixed_point` makes them from fractions), so counts, sums and deviations are
exact. The rows are numbered and centred, which happens before anything is multiplied, and cut into blocks
of a `BlockMatrix`. Its transpose times itself is the scatter matrix: partial products of row blocks are
added up with splits of the common dimension, so no task meets all blocks. Only this square matrix, whose
size hangs on the dimension alone, goes to the driver, where its eigenvectors are worked out. The centred
blocks times the matrix of scaled eigenvectors are the whitened rows, joined back to their rows by number.

Components are numbered from 1 by falling eigenvalue; the entry of largest size of each eigenvector is
positive. Directions without variance (eigenvalue below `LEAST` of the total) cannot be scaled to one and are
left out, so a table of one row, or of equal rows, gives rows without components.

Rows whose vector is null or holds nulls take no part and give no row. Should vectors differ in length, those
of the most frequent length (the greater on ties) are taken and the others left out likewise, as are vectors
of length zero. Repeated rows and null or repeated ids are rows like any other. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylattice.llm.common import cut, fresh

BLOCK_ROWS = 1024  # of a block, at least
MOST_BLOCKS = 500_000  # their places are planned on the driver, so blocks grow beyond
BLOCKS_PER_TASK = 64
MOST_COLUMNS = 4096  # the scatter matrix is then 128 MB
LEAST = 1e-12
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition number above these bits


def fixed_point(vector: Column, scale: int = 64, shift: int = 0) -> Column:
    """floor(scale * c) + shift per entry; null if the vector is null, or if an entry is null, not finite, or
    2^52 or more after scaling, where doubles no longer hold whole numbers apart."""
    parts = F.transform(vector, lambda c: c.cast("double") * scale)
    unfit = F.exists(parts, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 52)))
    return F.when(~F.coalesce(unfit, F.lit(True)), F.transform(parts, lambda c: F.floor(c) + shift))


def _numbered(rows: DataFrame, number: str) -> DataFrame:
    """The rows written down and numbered 0..n-1 as they stand, without a sort: one offset per written part."""
    part = F.shiftright(number, _LOCAL_BITS)
    stored = cut(rows.withColumn(number, F.monotonically_increasing_id()), "numbered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # as many rows as parts were written
        stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    local = F.col(number).bitwiseAND((1 << _LOCAL_BITS) - 1)
    return (
        stored.join(F.broadcast(offsets), part == F.col("_part"))
        .withColumn(number, (F.col("_offset") + local).cast("long")).select(*stored.columns)
    )


def _blocks(rows: DataFrame, number: str, values: Column, shape: tuple[int, int]) -> BlockMatrix:
    """Block matrix whose row `number` is `values`."""
    indexed = rows.select(F.col(number).alias("index"), array_to_vector(values).alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(indexed, "vector"), *shape)
    return matrix.toBlockMatrix(max(BLOCK_ROWS, -(-shape[0] // MOST_BLOCKS)), max(shape[1], 1))


def _scatter(blocks: BlockMatrix) -> np.ndarray:
    """transpose(blocks) * blocks. The product has one block only, so its common dimension is split among tasks;
    Python's `multiply` has no such argument, the class behind it has."""
    left = blocks.transpose()
    splits = max(1, -(-blocks.numRowBlocks // BLOCKS_PER_TASK))
    product = left._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def _rows_of(blocks: BlockMatrix) -> DataFrame:
    """index and vector of every row, without a detour through Python objects."""
    return callMLlibFunc("getIndexedRows", blocks.toIndexedRowMatrix()._java_matrix_wrapper._java_model)


def principal_axes(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) by falling eigenvalue, those without variance left out."""
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")
    keep = [i for i in order[:components] if values[i] > LEAST * max(values.sum(), 0.0)]
    axes = axes[:, keep]
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(keep))])
    return values[keep], axes * signs


def whiten(rows: DataFrame, vector: str = "vector", components: int = 32, out: str = "whitening") -> DataFrame:
    """The rows that take part, with a struct column `out` (replaced if there): n (rows), deviation (sum of
    (n * x - S)^2 over the entries x with sums S; exact, null beyond 2^63), whitened (array of up to `components`
    numbers), explained (share of each component) and identity_error (largest absolute entry of the whitened
    rows' covariance minus the identity; null without components). `vector` is an array of long."""
    session = rows.sparkSession
    rest = [c for c in rows.columns if c.lower() != out.lower()]
    number, centred, exact, index, found = fresh(rows, "number", "centred", "exact", "index", "found")
    x = F.col(vector)
    fit = rows.select(rest).filter(x.isNotNull() & ~F.coalesce(F.exists(x, F.isnull), F.lit(True)))
    usual = fit.groupBy(F.size(x).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    n, d = (usual["count"], usual["size"]) if usual else (0, 0)
    if d > MOST_COLUMNS:
        raise ValueError(f"vectors of {d} entries: the scatter matrix is held on the driver, at most {MOST_COLUMNS}")
    stored = _numbered(fit.filter(F.size(x) == max(d, 1)), number)
    sums = [0] * d
    for place, total in (
        stored.select(F.posexplode(x).alias("place", "x")).groupBy("place").agg(F.sum(F.col("x").cast("decimal(20,0)"))).collect()
    ):
        sums[place] = int(total)
    n = n if d else 0
    # x - S/n = (x - q) - r/n and n * x - S = n * (x - q) - r, where q and r are quotient and rest of S / n
    means = F.lit([s // n for s in sums] if n else []).cast("array<long>")
    rests = F.lit([s % n for s in sums] if n else []).cast("array<long>")
    away = F.transform(
        F.arrays_zip(x.alias("x"), means.alias("q"), rests.alias("r")), lambda v: F.struct((v["x"] - v["q"]).alias("a"), v["r"].alias("r"))
    )
    rough = F.aggregate(away, F.lit(0.0), lambda t, v: t + F.pow(v["a"].cast("double") * n - v["r"], 2))
    whole = F.aggregate(
        away, F.lit(0).cast("long"), lambda t, v: t + (v["a"] * F.lit(n).cast("long") - v["r"]) * (v["a"] * F.lit(n).cast("long") - v["r"])
    )
    table = stored.withColumns({
        centred: F.transform(away, lambda v: v["a"].cast("double") - v["r"].cast("double") / F.lit(float(n or 1))),
        exact: F.when(rough < 9.2e18, whole),
    })

    blocks = _blocks(table, number, F.col(centred), (n, d)) if n else None
    values, axes, total = np.empty(0), np.empty((d, 0)), 1.0
    if n:
        covariance = _scatter(blocks) / n
        total = float(np.trace(covariance))
        values, axes = principal_axes(covariance, components)
    k = len(values)
    error = None
    if k:
        scale = axes / np.sqrt(values)
        local = Matrices.dense(d, k, scale.ravel(order="F").tolist())
        whitening = BlockMatrix(session.sparkContext.parallelize([((0, 0), local)], 1), d, k, d, k)
        projected = cut(
            _rows_of(blocks.multiply(whitening)).select(F.col("index").alias(index), vector_to_array("vector").alias(found)), "whitened"
        )
        means = projected.select([F.avg(F.col(found)[i]) for i in range(k)]).first()
        off = F.transform(F.arrays_zip(F.col(found).alias("w"), F.lit(list(means)).alias("m")), lambda v: v["w"] - v["m"])
        again = _scatter(_blocks(projected, index, off, (n, k))) / n
        error = float(np.abs(again - np.eye(k)).max())
        table = table.join(projected, F.col(number) == F.col(index))
    else:
        table = table.withColumn(found, F.array().cast("array<double>"))
    return table.select(
        *rest,
        F.struct(
            F.lit(n).cast("long").alias("n"), F.col(exact).alias("deviation"), F.col(found).alias("whitened"),
            F.lit((values / total).tolist()).cast("array<double>").alias("explained"),
            F.lit(error).cast("double").alias("identity_error"),
        ).alias(out),
    )
