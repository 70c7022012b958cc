"""Held-out truth and top-k ranking metrics.

Truth and predictions are rows, `(user, item)` and `(user, rank, item)`, never one array per
user: a payee may have millions of payers.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paylattice.config import entity, other
from paylattice.plans.skew import join_on_key
from paylattice.session import cut_lineage

METRICS = ("MAP", "Recall", "Precision", "NDCG")


def truth_sets(
    test: DataFrame, indexed_dt: DataFrame, indexed_kt: DataFrame, side: str, min_rows: int
) -> DataFrame:
    """Distinct partners in the test window of every entity with at least `min_rows` test rows.

    Entities not seen in training drop out before counting. `cnt` counts interaction rows,
    not partners, and repeats on each of the entity's rows.
    """
    own, partner = f"{entity(side)}_index", f"{entity(other(side))}_index"
    # rows of one pair are counted before anything is joined
    pairs = test.groupBy("inn_dt", "inn_kt").agg(F.count(F.lit(1)).alias("rows"))
    known = join_on_key(pairs, indexed_dt.select("inn_dt", "inn_dt_index"), "inn_dt")
    known = cut_lineage(join_on_key(known, indexed_kt.select("inn_kt", "inn_kt_index"), "inn_kt", count_in=pairs))
    totals = known.groupBy(own).agg(F.sum("rows").alias("cnt")).filter(F.col("cnt") >= min_rows)
    return join_on_key(known, totals, own).select(own, partner, "cnt")


def truth_rows(truth: DataFrame, side: str) -> DataFrame:
    """Truth sets under the neutral names the metrics use."""
    return truth.select(
        F.col(f"{entity(side)}_index").alias("user"), F.col(f"{entity(other(side))}_index").alias("item")
    )


def set_sizes(truth: DataFrame) -> DataFrame:
    return truth.groupBy("user").agg(F.count("item").alias("n_truth"))


def truth_set_size(truth: DataFrame) -> DataFrame:
    """Median and mean number of partners in the truth sets."""
    return set_sizes(truth).agg(
        F.count("user").alias("users"),
        F.percentile("n_truth", 0.5).alias("median_size"),
        (F.sum("n_truth") / F.count("n_truth")).alias("mean_size"),
    )


def top_active_users(truth: DataFrame, n: int = 3500) -> DataFrame:
    """Users with the largest truth sets; equal sizes by user id."""
    return set_sizes(truth).orderBy(F.desc("n_truth"), "user").limit(n)


def user_metrics(
    truth: DataFrame, predictions: DataFrame, ks: Iterable[int], users: DataFrame | None = None
) -> DataFrame:
    """AP, recall, precision and NDCG at every k for every truth user, as `(user, k, MAP, ...)`.

    A truth row with a null item says that the truth of this user is unknown: AP and recall are
    then 1. Users given in `users` that have no truth row have an empty truth and score 0.
    Precision divides by k however short the prediction is. A repeated prediction counts once,
    at its first rank, except in NDCG, which counts every occurrence.
    """
    cuts = sorted({int(k) for k in ks})
    deepest = cuts[-1]
    truth = truth.select("user", "item").distinct()
    sizes = truth.groupBy("user").agg(
        F.count("item").alias("n_truth"), F.max(F.col("item").isNull()).alias("unknown")
    )
    if users is not None:
        sizes = (
            users.select("user").distinct().join(sizes, "user", "full")
            .select("user", F.coalesce("n_truth", F.lit(0)).alias("n_truth"), F.coalesce("unknown", F.lit(False)).alias("unknown"))
        )
    # at most `deepest` rows per user from here on
    shown = predictions.filter(F.col("rank") <= deepest).select("user", "item", "rank")
    hits = shown.join(truth, ["user", "item"])
    repeat = Window.partitionBy("user", "item").orderBy("rank")
    upto = Window.partitionBy("user").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        hits.withColumn("fresh", (F.row_number().over(repeat) == 1).cast("int"))
        .withColumn("found", F.sum("fresh").over(upto))
        .withColumn("gain", F.lit(1.0) / F.log2(F.col("rank") + 1))
    )
    # every step up to here is grouped by user, so neither the join nor the sums shuffle again
    inside = F.col("rank") <= F.col("k")
    scored = (
        sizes.join(hits.select("user", "rank", "fresh", "found", "gain"), "user", "left")
        .withColumn("k", F.explode(F.array(*[F.lit(k) for k in cuts])))
        .groupBy("user", "k", "n_truth", "unknown")
        .agg(
            F.coalesce(F.sum(F.when(inside & (F.col("fresh") == 1), F.col("found") / F.col("rank"))), F.lit(0.0)).alias("ap"),
            F.coalesce(F.sum(F.when(inside, F.col("fresh"))), F.lit(0)).alias("hits"),
            F.coalesce(F.sum(F.when(inside, F.col("gain"))), F.lit(0.0)).alias("dcg"),
        )
    )
    # ideal gain of 1..deepest items: a constant list, no per-row work
    gains = accumulate(1.0 / math.log2(i + 1) for i in range(1, deepest + 1))
    ideal = F.array(*[F.lit(g) for g in gains])
    best = F.least("n_truth", "k")

    def value(known, name: str, unknown: float = 0.0):
        return F.when(F.col("unknown"), unknown).when(best > 0, known).otherwise(0.0).alias(name)

    return scored.select(
        "user",
        "k",
        value(F.col("ap") / best, "MAP", unknown=1.0),
        value(F.col("hits") / F.col("n_truth"), "Recall", unknown=1.0),
        (F.col("hits") / F.col("k")).alias("Precision"),
        value(F.col("dcg") / F.get(ideal, (best - 1).cast("int")), "NDCG"),
    )


def ranking_metrics(
    truth: DataFrame, predictions: DataFrame, ks: Iterable[int], users: DataFrame | None = None
) -> DataFrame:
    """Means over all truth users as `(metric, k, value)`; users without a prediction count as 0.

    Values are added as decimals, so the report does not depend on the order of the users.
    """
    means = (
        user_metrics(truth, predictions, ks, users)
        .groupBy("k")
        .agg(*[(F.sum(F.col(m).cast("decimal(18,12)")).cast("double") / F.count(m)).alias(m) for m in METRICS])
    )
    return means.unpivot("k", list(METRICS), "metric", "value").select("metric", "k", "value")


def restrict_users(rows: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of the given users only."""
    return join_on_key(rows, users.select("user"), "user", "left_semi")
