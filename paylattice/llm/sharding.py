"""Global shuffle into shards by two passes over external storage.

Pass 1 scatters rows uniformly into buckets that fit in a task's memory, by a seeded hash of the row.
Pass 2 shuffles each bucket with Fisher-Yates (Spark's `shuffle` on the array of its rows). Buckets one
after another are the shuffled table; position p goes to shard p mod n at slot p div n, so row counts of
the shards differ by one at most and slots have no gaps.

Only DataFrame functions are used. The number of buckets follows the bytes of the text, so a bucket stays
near `bucket_bytes` whatever the table holds: documents of one source, id or text length are scattered
by the hash of all their columns. Only rows equal in every column share a bucket. Null text counts as
empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylattice.llm.common import cut, fresh, total_text_bytes

BUCKET_BYTES = 16 << 20
# Offsets of so many buckets (16 bytes each) are broadcast; beyond that they are joined.
BROADCAST_BUCKETS = 1_000_000


def scatter_and_shuffle(
    docs: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, text: str = "text",
    out: str = "place",
) -> DataFrame:
    """All rows and columns of `docs`, with a struct column `out`: shard and slot. A column of that name is replaced."""
    size = total_text_bytes(docs, text)
    buckets = max(1, -(-size // bucket_bytes))
    bucket, row, index = fresh(docs, "bucket", "row", "index")
    drawn = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in docs.columns]), F.lit(buckets)).cast("int")
    scattered = docs.select(drawn.alias(bucket), F.struct(*docs.columns).alias(row)).repartitionById(
        buckets, F.col(bucket)
    )
    # sorted before the shuffle, so that the order in which blocks arrive does not matter
    gathered = scattered.groupBy(bucket).agg(
        F.sort_array(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 1), row).alias("h"), F.col(row).alias("r")))).alias(row)
    )
    shuffled = cut(
        gathered.select(bucket, F.posexplode(F.shuffle(row, seed)).alias(index, row)).select(
            bucket, index, F.col(f"{row}.r").alias(row)
        )
    )
    # one row per bucket
    counts = shuffled.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)
    position = F.col("_offset") + F.col(index)
    return shuffled.join(offsets, bucket).select(
        *[F.col(row)[c].alias(c) for c in docs.columns if c.lower() != out.lower()],
        F.struct(
            (position % shards).cast("int").alias("shard"), F.floor(position / shards).cast("long").alias("slot")
        ).alias(out),
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder per shard, the files of a shard in slot order."""
    spark: SparkSession = placed.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (
        placed.select("*", F.col("place.shard").alias("shard"))
        .repartitionByRange(width, "place.shard", "place.slot")
        .sortWithinPartitions("place.shard", "place.slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
