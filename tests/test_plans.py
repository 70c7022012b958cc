from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paylattice.operators.retrieval import ClusterIndex, ann_topk, exact_topk, recall_report
from paylattice.plans import blocks, skew
from paylattice.plans.blocks import _top, best_in_buckets, best_probed, merge_top
from paylattice.plans.ordering import with_position, with_prefix
from paylattice.plans.skew import join_on_key


def as_sets(df):
    columns = sorted(df.columns)
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("narrow", [False, True])
def test_salted_join_equals_plain(spark, how, narrow):
    # one key holds half of all rows, some rows have no key, some keys have no partner
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 37}", i) for i in range(400)] + [(None, i) for i in range(100)]
    facts = spark.createDataFrame(rows, "k string, v int")
    keyed = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k36", 4), ("other", 5)], "k string, w int")
    plain = facts.join(keyed, "k", how)
    salted = join_on_key(facts, keyed, "k", how, count_in=facts.select("k") if narrow else None, rows_per_task=50, salt=True)
    assert as_sets(salted) == as_sets(plain)
    assert set(salted.columns) == set(plain.columns)


def test_salting_spreads_the_hot_key(spark):
    facts = spark.range(4000).select(F.lit("hot").alias("k"), "id")
    keyed = spark.createDataFrame([("hot", 1)], "k string, w int")
    salted = join_on_key(facts, keyed, "k", rows_per_task=100, salt=True).hint("rebalance")
    assert salted.count() == 4000
    plan = join_on_key(facts, keyed, "k", rows_per_task=100, salt=True)._jdf.queryExecution().toString()
    assert "_salt" in plan


def test_small_keyed_side_is_left_to_catalyst(spark):
    facts = spark.range(10).withColumnRenamed("id", "k")
    keyed = spark.range(3).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    assert skew.estimated_bytes(keyed) < skew.broadcast_limit(keyed)
    assert "_salt" not in join_on_key(facts, keyed, "k")._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "_salt" in join_on_key(facts, keyed, "k")._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_position_and_prefix_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # keep several ranges
    try:
        rng = random.Random(7)
        values = rng.sample(range(10_000), 3000)
        df = spark.createDataFrame([(v, v % 13) for v in values], "v int, w int").repartition(5)
        placed = with_prefix(df, ["v"], {"position": F.lit(1), "below": F.col("w")})
        got = {r["v"]: (r["position"], r["below"]) for r in placed.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = 0
    for i, v in enumerate(sorted(values)):
        assert got[v] == (i, total)
        total += v % 13


def test_position_descending_strings_and_empty(spark):
    df = spark.createDataFrame([("b", 1), ("a", 1), ("c", 5)], "s string, n int")
    got = {r["s"]: r["position"] for r in with_position(df, [F.desc("n"), "s"]).collect()}
    assert got == {"c": 0, "a": 1, "b": 2}
    assert with_position(df.filter("n > 9"), ["s"]).count() == 0


def brute(users, items, k, metric):
    out = set()
    for u, uv in users:
        scores = []
        for i, iv in items:
            a, b = np.array(uv, float), np.array(iv, float)
            if metric == "cosine":
                a = a / (np.linalg.norm(a) or 1.0)
                b = b / (np.linalg.norm(b) or 1.0)
            scores.append((-round(float(a @ b), 9), i))
        out |= {(u, r + 1, i) for r, (_, i) in enumerate(sorted(scores)[:k])}
    return out


def frames(spark, users, items):
    return (
        spark.createDataFrame(users, "user long, embedding array<float>"),
        spark.createDataFrame(items, "item long, embedding array<float>"),
    )


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize("k", [3, 50])
def test_exact_topk_in_many_blocks(spark, metric, k):
    rng = np.random.default_rng(3)
    grid = lambda n: [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(n)]  # many ties, zero vectors
    users, items = grid(23), grid(40)
    found = exact_topk(*frames(spark, users, items), k, metric, user_block=5, item_block=7).collect()
    assert {(r["user"], r["rank"], r["item"]) for r in found} == brute(users, items, min(k, 40), metric)


def test_scaling_keeps_cosine_order(spark):
    rng = np.random.default_rng(4)
    users = [(i, rng.normal(size=6).tolist()) for i in range(10)]
    items = [(i, rng.normal(size=6).tolist()) for i in range(30)]
    scaled = [(i, (np.array(v) * (i + 1)).tolist()) for i, v in items]
    a = exact_topk(*frames(spark, users, items), 5).select("user", "rank", "item")
    b = exact_topk(*frames(spark, users, scaled), 5).select("user", "rank", "item")
    assert as_sets(a) == as_sets(b)


def test_ann_lists_are_whole_and_close_to_exact(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 16))
    users = [(i, (centres[i % 8] + 0.1 * rng.normal(size=16)).tolist()) for i in range(40)]
    # a third of the catalogue are copies of one vector: one bucket holds them all
    items = [(i, (centres[0] if i % 3 == 0 else centres[i % 8] + 0.1 * rng.normal(size=16)).tolist()) for i in range(300)]
    u, i = frames(spark, users, items)
    near = ann_topk(u, i, 10, user_block=8, item_block=16).collect()
    assert len(near) == 40 * 10
    exact = {(r["user"], r["item"]) for r in exact_topk(u, i, 10).collect()}
    assert len({(r["user"], r["item"]) for r in near} & exact) / len(exact) >= 0.85


def test_ann_with_all_probes_is_exact(spark):
    rng = np.random.default_rng(6)
    users = [(i, rng.normal(size=8).tolist()) for i in range(12)]
    items = [(i, rng.normal(size=8).tolist()) for i in range(20)]
    u, i = frames(spark, users, items)
    near = ann_topk(u, i, 20, recall=1.0)
    assert as_sets(near.select("user", "rank", "item")) == as_sets(exact_topk(u, i, 20).select("user", "rank", "item"))


def test_clustered_items_are_pruned(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(25, 16))
    users = [(i, (centres[i % 25] + 0.05 * rng.normal(size=16)).tolist()) for i in range(50)]
    items = [(i, (centres[i % 25] + 0.05 * rng.normal(size=16)).tolist()) for i in range(625)]
    report = {r["metric"]: r["value"] for r in recall_report(*frames(spark, users, items), 10).collect()}
    assert report["recall"] >= 0.9 and report["scored_share"] <= 0.1 and report["full_lists"] == 1.0


def test_ann_lists_are_whole_beside_small_clusters(spark):
    rng = np.random.default_rng(8)
    centres = np.eye(12)
    # two clusters hold nearly all items and users, ten hold three items each
    crowd = [i % 2 for i in range(300)] + [2 + i % 10 for i in range(30)]
    items = [(i, (centres[c] + 0.02 * rng.normal(size=12)).tolist()) for i, c in enumerate(crowd)]
    users = [(i, (centres[i % 2 if i < 190 else 2 + i % 10] + 0.02 * rng.normal(size=12)).tolist()) for i in range(200)]
    u, i = frames(spark, users, items)
    index = ClusterIndex(centres, 1)
    assert {r["n"] for r in ann_topk(u, i, 20, index=index).groupBy("user").agg(F.count("*").alias("n")).collect()} == {20}
    every = ann_topk(u.limit(3), i, 1000, index=index).groupBy("user").agg(F.count("*").alias("n"))
    assert {r["n"] for r in every.collect()} == {330}
    report = {r["metric"]: r["value"] for r in recall_report(u, i, 20).collect()}
    assert report["full_lists"] == 1.0 and report["recall"] >= 0.9


def test_lists_of_many_probes_come_back_once_per_stripe(spark):
    rng = np.random.default_rng(9)
    sizes = np.array([7, 0, 30, 1, 12, 90])
    users = [(i, rng.integers(-2, 3, 5).astype(float).tolist(), [2, 4, 1] if i % 2 else [5, 3, 0, 1, 2, 4]) for i in range(30)]
    items = [(i, rng.integers(-2, 3, 5).astype(float).tolist(), int(b)) for i, b in enumerate(np.repeat(np.arange(6), sizes))]
    u = spark.createDataFrame(users, "user long, vec array<double>, probes array<int>")
    i = spark.createDataFrame(items, "item long, vec array<double>, bucket int")
    asked = u.select("user", "vec", F.explode(F.col("probes").cast("array<string>")).alias("bucket"))
    whole = merge_top(best_in_buckets(asked, i.withColumn("bucket", F.col("bucket").cast("string")), 8, "cosine"), 8)
    assert best_probed(u, i, sizes, 8).count() == 30 * 8  # once per probed bucket before
    for blocks in ({}, {"user_block": 7, "item_block": 20}):
        found = merge_top(best_probed(u, i, sizes, 8, **blocks), 8)
        assert as_sets(found.select("user", "rank", "item")) == as_sets(whole.select("user", "rank", "item"))


def test_top_breaks_ties_by_column():
    scores = np.array([[1.0, 2.0, 2.0, 2.0, 0.0], [0.0, 0.0, 0.0, 0.0, 5.0]])
    assert _top(scores, 2).tolist() == [[1, 2], [0, 4]]


def test_items_stream_past_their_users(spark, monkeypatch):
    """Stripes do not multiply with the user chunks, so neither do users and lists; results stay exact."""
    monkeypatch.setattr(blocks, "_TASKS", 8)
    users, items = [(i, [float(i % 7), 1.0]) for i in range(120)], [(i, [float(i % 11), float(i % 5)]) for i in range(300)]
    u, i = (f.withColumnRenamed("embedding", "vec") for f in frames(spark, users, items))
    partial = blocks.best_overall(u, i, 4, "dot", user_block=10, item_block=10).collect()
    assert len(partial) == 120 * 4  # once 120 * 30 * 4: a list for every chunk of items
    found = blocks.merge_top(spark.createDataFrame(partial, "user long, item long, score double"), 4)
    assert {(r["user"], r["rank"], r["item"]) for r in found.collect()} == brute(users, items, 4, "dot")


@pytest.mark.parametrize("k", [3, 40])
def test_scored_in_small_batches(k):
    rng = np.random.default_rng(9)
    users, items = rng.integers(-2, 3, (90, 4)).astype(float), rng.integers(-2, 3, (150, 4)).astype(float)
    table = lambda v, ids: pa.table({"id": pa.array(ids), "vec": pa.array(v.tolist())})
    best, ids = blocks._Best(table(users, np.arange(90)), k, "dot"), rng.permutation(150)
    for at in range(0, 150, 11):
        best.meet(table(items[ids[at:at + 11]], ids[at:at + 11]))
    wanted = np.lexsort((np.broadcast_to(np.arange(150), (90, 150)), -(users @ items.T)), axis=1)[:, :k]
    assert np.array_equal(best.items, wanted) and sum(b.num_rows for b in best.lists()) == 90 * k


def test_exact_lists_leave_their_tasks_ranked(spark):
    """Few items made one task for up to 32,768 users before, and lists went through a second shuffle to be ranked."""
    rng = np.random.default_rng(21)
    users = [(i, rng.integers(-3, 4, 3).astype(float).tolist()) for i in range(5000)]
    items = [(i, rng.integers(-3, 4, 3).astype(float).tolist()) for i in range(60)]
    found = exact_topk(*frames(spark, users, items), 4, "dot")
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    tasks = found.select("user", F.spark_partition_id().alias("task")).groupBy("task").agg(F.count_distinct("user").alias("n")).collect()
    assert len(tasks) > 1 and max(r["n"] for r in tasks) < 2500
    assert {(r["user"], r["rank"], r["item"]) for r in found.filter("user < 40").collect()} == brute(users[:40], items, 4, "dot")


@pytest.mark.parametrize("size", [1.0, 1e3, 1e30])
@pytest.mark.parametrize("k", [1, 20])
def test_single_precision_decides_nothing_close(size, k):
    rng = np.random.default_rng(22)
    users, items = rng.normal(size=(300, 6)), np.tile(rng.normal(size=(1, 6)), (5000, 1))
    users[7] = 0  # all items equal
    items += rng.normal(size=items.shape) * 1e-7  # closer than single precision tells
    items[4000:] *= rng.uniform(0.1, 1.5, (1000, 1))
    users *= size
    table = lambda v, ids: pa.table({"id": pa.array(ids), "vec": pa.array(v.tolist())})
    best, ids = blocks._Best(table(users, np.arange(300)), k, "dot"), rng.permutation(5000)
    for at in range(0, 5000, 1700):
        best.meet(table(items[ids[at:at + 1700]], ids[at:at + 1700]))
    scores = np.round(np.einsum("ij,kj->ik", users, items), 9)
    wanted = np.lexsort((np.broadcast_to(np.arange(5000), scores.shape), -scores), axis=1)[:, :k]
    np.testing.assert_allclose(best.scores, np.take_along_axis(scores, wanted, axis=1), rtol=1e-13, atol=2e-9)
    assert (best.items == wanted).mean() > 0.99  # last bits may differ by the order of a sum
    assert np.array_equal(best.items[7], np.arange(k))


def test_repeated_users_share_their_ranks(spark):
    rng = np.random.default_rng(23)
    users = [(i % 17, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(40)]
    items = [(i % 25, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(30)]
    u, i = frames(spark, users, items)
    named = u.withColumnRenamed("embedding", "vec"), i.withColumnRenamed("embedding", "vec")
    merged = merge_top(blocks.best_overall(*named, 6, "dot"), 6)
    rows = lambda df: sorted(map(tuple, df.select("user", "rank", "item", "score").collect()))
    assert rows(exact_topk(u, i, 6, "dot")) == rows(merged)
    assert {r["n"] for r in merged.groupBy("user").agg(F.count("*").alias("n")).collect()} == {6}
