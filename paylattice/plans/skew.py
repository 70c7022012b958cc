"""Equi-joins of a large fact table with a keyed table when some keys are very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fact rows of one key that a single task is expected to join without trouble.
ROWS_PER_TASK = 1_000_000

# Tasks over which fact rows without a key are spread.
_NULL_SALTS = 1024


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    """Current automatic broadcast threshold in bytes, -1 when broadcasting is switched off."""
    return int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def join_on_key(
    facts: DataFrame,
    keyed: DataFrame,
    on: str | list[str],
    how: str = "inner",
    count_in: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    salt: bool | None = None,
) -> DataFrame:
    """Join `facts` to `keyed` on equal keys; `how` is inner, left, left_semi or left_anti.

    A keyed side below the broadcast threshold is left to Catalyst, which broadcasts it, so
    fact rows never move. Otherwise keys with more than `rows_per_task` fact rows are spread:
    their fact rows get a salt and their keyed rows are repeated once per salt. There can be
    at most |facts| / rows_per_task such keys, which bounds the list that is broadcast.

    Frequent keys are counted in `count_in` where given: a cheaper table that holds every fact
    row's keys at least as often, such as the scan that earlier inner joins have since filtered.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if salt is None:
        salt = estimated_bytes(keyed) > broadcast_limit(keyed)
    if not salt:
        return facts.join(keyed, keys, how)

    hot = (
        (facts if count_in is None else count_in)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > rows_per_task)
        .select(*keys, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("_salts"))
    )
    row_hash = F.xxhash64(*facts.columns)
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    salt_of_row = (
        F.when(no_key, F.pmod(row_hash, F.lit(_NULL_SALTS)))  # matches nothing, so any task will do
        .when(F.col("_salts").isNotNull(), F.pmod(row_hash, F.col("_salts")))
        .otherwise(F.lit(0))
    )
    spread = (
        facts.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", salt_of_row.cast("int"))
        .drop("_salts")
    )
    repeated = (
        keyed.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")
