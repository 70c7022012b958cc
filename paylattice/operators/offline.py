"""Offline evaluation: vectors, nearest items and ranking metrics, each step written and reused."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from paylattice.operators.forest import forest_topk
from paylattice.operators.ranking import ranking_metrics
from paylattice.operators.retrieval import ann_topk, exact_topk
from paylattice.sources.tables import reuse, write_json


def fingerprint(**configuration) -> str:
    """Short digest of a configuration; artifacts made under another one are rebuilt."""
    return hashlib.sha256(json.dumps(configuration, sort_keys=True, default=str).encode()).hexdigest()[:16]


def evaluate_offline(
    spark: SparkSession,
    root: str,
    users: Callable[[], DataFrame],
    items: Callable[[], DataFrame],
    truth: DataFrame,
    k: int,
    ks: Iterable[int],
    configuration: dict,
    search: str = "exact",
    metric: str = "cosine",
) -> DataFrame:
    """`(metric, k, value)` of the k nearest items of every user against the truth.

    `users` and `items` build `(user, embedding)` and `(item, embedding)` when their tables under
    `root` are absent or were made under another configuration. Metrics also go to JSON.
    """
    ks = sorted(set(ks))
    vectors_mark = fingerprint(**configuration)
    user_vectors = reuse(spark, f"{root}/user_embeddings", vectors_mark, users)
    item_vectors = reuse(spark, f"{root}/item_embeddings", vectors_mark, items)

    def nearest() -> DataFrame:
        if search in ("forest", "clusters"):
            return (forest_topk if search == "forest" else ann_topk)(user_vectors, item_vectors, k)
        return exact_topk(user_vectors, item_vectors, k, metric)

    recs_mark = fingerprint(**configuration, k=k, search=search, metric=metric)
    recommendations = reuse(spark, f"{root}/recommendations", recs_mark, nearest)
    report = ranking_metrics(truth, recommendations, ks)
    write_json(report, f"{root}/metrics")
    return spark.read.schema(report.schema).json(f"{root}/metrics")
