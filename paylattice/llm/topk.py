"""Exact top-k by inner product with block-at-a-time pruning.

Vectors are sorted by a coarse code and cut into blocks of consecutive rows. A block keeps its rows
(forward index) and the largest and smallest value of every component. For a query the sum over
components of the larger of q * max and q * min bounds every score in the block. Blocks are visited in
falling order of that bound and scored whole, until the bound is below the query's k-th score.

Blocks are grouped into stripes; a task holds one stripe and one batch of queries, and gives k rows per
query. Queries are repeated per stripe, never per row. Equal scores rank the smaller id first, so a block
whose bound equals the k-th score is still visited. Components are integers; arithmetic is exact.

Vectors that are null, or hold null or non-finite components, take no part. Shorter vectors count as padded
with zeros. Repeated rows are rows of their own: each is a candidate for the others. Fewer than k
candidates give fewer rows, an empty table gives none. A null id takes part and ranks first among ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylattice.llm.common import cut, ship_package
from paylattice.plans.ordering import with_position

BLOCK_ROWS = 128
# A stripe has so many blocks at most; with few rows it has fewer, so that all tasks get a part.
STRIPE_BLOCKS = 256
QUERY_ROWS = 32768
_CODE_BITS = 16


def integer_vector(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) per component; null where the vector takes no part."""
    parts = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(parts, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(parts, lambda x: F.floor(x * scale).cast("long")))


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "vector"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every row where `is_query` holds.

    `vector` is an array of long; rows where it is null are left out.
    """
    ship_package(vectors.sparkSession)
    rows = cut(
        vectors.filter(F.col(vector).isNotNull()).select(
            F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"),
            F.coalesce(is_query, F.lit(False)).alias("q"),
        )
    )
    # rows of like sign patterns stand together, which keeps the bounds of a block tight
    ordered = cut(with_position(rows.withColumn("code", _code(F.col("v"))), ["code", "id", F.hash("v"), "v", "q"]))
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = -(-ordered.count() // BLOCK_ROWS)
    blocks = max(1, min(STRIPE_BLOCKS, n_blocks // width))
    stripe = F.floor(F.col("position") / (BLOCK_ROWS * blocks)).cast("int")
    stored = ordered.select(stripe.alias("stripe"), F.lit(-1).alias("batch"), "position", "id", "v")
    queries = ordered.filter("q").select(
        F.pmod(F.xxhash64("position"), F.lit(2**31 - 1)).alias("h"), "position", "id", "v"
    )
    n_stripes = -(-n_blocks // blocks)
    n_batches = max(1, -(-queries.count() // QUERY_ROWS))
    batches = F.sequence(F.lit(0), F.lit(n_batches - 1))
    stripes = F.sequence(F.lit(0), F.lit(max(0, n_stripes - 1)))
    cells = (
        stored.select("stripe", F.explode(batches).alias("batch"), F.lit(False).alias("q"), "position", "id", "v")
        .unionByName(
            queries.select(
                F.explode(stripes).alias("stripe"), (F.col("h") % n_batches).cast("int").alias("batch"),
                F.lit(True).alias("q"), "position", "id", "v",
            )
        )
    )
    def search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _search(table, k)

    found = cells.repartition(max(width, n_stripes * n_batches), "stripe", "batch").groupBy("stripe", "batch").applyInArrow(
        search, "query_position long, query_id long, vec_id long, score long"
    )
    best = Window.partitionBy("query_position").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_first())
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def _code(v: Column) -> Column:
    """Signs of the first components, the strongest ones first, as one number."""
    signs = F.transform(F.slice(v, 1, _CODE_BITS), lambda x: (x >= 0).cast("int"))
    return F.aggregate(signs, F.lit(0), lambda acc, b: acc * 2 + b)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.asarray(lists.value_lengths())
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _search(table: pa.Table, k: int) -> pa.Table:
    is_query = table["q"].to_numpy(zero_copy_only=False).astype(bool)
    lengths = np.asarray(table["v"].combine_chunks().value_lengths())
    data = _matrix(table["v"], int(lengths.max(initial=0)))
    ids = table["id"].to_pandas().fillna(np.iinfo(np.int64).min).to_numpy(dtype=np.int64) if table["id"].null_count else table["id"].to_numpy()
    position = table["position"].to_numpy()
    if float(np.abs(data).max(initial=0)) ** 2 * max(1, data.shape[1]) >= 2.0**53:
        data = data.astype(object)  # exact, if slow: components far outside the usual range
    else:
        data = data.astype(np.float64)  # whole numbers below 2^53: products and sums are exact
    rows = np.flatnonzero(~is_query)
    rows = rows[np.argsort(position[rows], kind="stable")]
    stored, stored_ids, stored_at = data[rows], ids[rows], position[rows]
    starts = np.arange(0, len(rows), BLOCK_ROWS)
    out: list[tuple] = []
    if len(rows):
        high, low = np.maximum.reduceat(stored, starts), np.minimum.reduceat(stored, starts)
    for q in np.flatnonzero(is_query) if len(rows) else []:
        query = data[q]
        up = np.where(query > 0, query, 0)
        bounds = high @ up + low @ (query - up)
        best_scores = best_ids = None
        for b in np.argsort(-bounds, kind="stable"):
            if best_scores is not None and len(best_scores) == k and bounds[b] < best_scores[-1]:
                break
            cells = slice(starts[b], starts[b] + BLOCK_ROWS)
            other = stored_at[cells] != position[q]
            scores, names = (stored[cells] @ query)[other], stored_ids[cells][other]
            if best_scores is not None:
                if len(best_scores) == k and len(scores) and scores.max() < best_scores[-1]:
                    continue
                scores, names = np.concatenate([best_scores, scores]), np.concatenate([best_ids, names])
            order = np.lexsort((names, -scores))[:k]
            best_scores, best_ids = scores[order], names[order]
        out += [(int(position[q]), int(ids[q]), int(i), int(s)) for s, i in zip(best_scores, best_ids)]
    least = np.iinfo(np.int64).min
    limit = 2**63 - 1
    return pa.table({
        "query_position": pa.array([o[0] for o in out], pa.int64()),
        "query_id": pa.array([None if o[1] == least else o[1] for o in out], pa.int64()),
        "vec_id": pa.array([None if o[2] == least else o[2] for o in out], pa.int64()),
        "score": pa.array([max(-limit, min(limit, o[3])) for o in out], pa.int64()),
    })
