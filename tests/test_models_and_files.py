from __future__ import annotations

import json
import os
import subprocess
import sys

import numpy as np
import pytest
from conftest import ROOT, SMALL
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from paylattice.config import index_features, numeric_features
from paylattice.operators import learning, offline, recommend, topics, towers
from paylattice.registry import QUERIES
from paylattice.session import cut_lineage, shared_dir
from paylattice.sources import tables
from paylattice.sources.demo import Demo


def test_vocabulary_equals_count_vectorizer(spark):
    docs = {"a": "x x x y y z".split(), "b": "x y q".split(), "c": "x z z z z".split(), "d": [None]}
    words = spark.createDataFrame([(k, w) for k, ws in docs.items() for w in ws], "inn_kt string, word_v2 string")
    bags = topics.entity_documents(words, "inn_kt")
    assert {r["inn_kt"] for r in bags.collect()} == {"a", "b", "c"}  # d has no word
    vocab = topics.vocabulary(bags, 3, 2)
    ours = [r["word_v2"] for r in vocab.orderBy("word_id").collect()]
    listed = spark.createDataFrame([(k, [w for w in ws if w]) for k, ws in docs.items() if k != "d"], "k string, words array<string>")
    model = CountVectorizer(inputCol="words", outputCol="f", vocabSize=3, minDF=2).fit(listed)
    assert set(ours) == set(model.vocabulary)
    vectors = topics.count_vectors(topics.word_counts(bags, vocab, "inn_kt"), "inn_kt", 3)
    got = {r["inn_kt"]: dict(zip(ours, r["features"].toArray())) for r in vectors.collect()}
    for row in model.transform(listed).collect():
        assert got[row["k"]] == dict(zip(model.vocabulary, row["f"].toArray()))


def test_topic_weights_sum_to_one(spark):
    rows = QUERIES["topic_weights"](spark, SMALL).collect()
    for row in rows:
        weights = [row[f"dt_topic_weight_{i}"] for i in range(50)]
        assert sum(weights) == pytest.approx(1.0) and min(weights) >= 0


def test_topic_vectors_are_indexed(spark):
    rows = QUERIES["topic_indexed"](spark, SMALL).collect()
    assert len({r["inn_dt_index"] for r in rows}) == len(rows) > 0
    assert all(len(r["topic"]) == 50 for r in rows)


def tower_fixture(spark):
    sizes = {f: 9 for f in index_features("kt")}
    tower = towers.seeded_tower(sizes, "kt", 4, 2, 3, 1)
    labels = spark.createDataFrame(
        [(f[: -len("_index")], str(i), i) for f in sizes for i in range(9)], "column string, label string, index int"
    )
    return sizes, tower, cut_lineage(towers.seeded_tables(labels, sizes, 4, 1))


def test_tower_equals_one_entity_at_a_time(spark):
    sizes, tower, weights = tower_fixture(spark)
    names, numbers = index_features("kt"), numeric_features("kt")
    rows = [tuple([i] + [(i + j) % 9 for j in range(12)] + [0.5 * i + j for j in range(7)]) for i in range(9)]
    features = spark.createDataFrame(rows, ", ".join([f"{n} int" for n in names] + [f"{n} double" for n in numbers]))
    emb = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(0, 9, 2)], "index int, embedding array<float>")
    topic = spark.createDataFrame([(1, [0.2, 0.3, 0.5])], "index int, topic array<float>")
    ids = spark.createDataFrame([(i,) for i in (*range(9), 77)], "id int")
    got = {
        r["id"]: r
        for r in towers.tower_embeddings(ids, features, weights, tower, "kt", 4, {"emb": (emb, 2), "topic": (topic, 3)}).collect()
    }
    assert len(got) == 10
    table = {(r["feature"], r["index"]): np.array(r["vec"]) for r in weights.collect()}
    by_id = {r[0]: r for r in rows}

    def block(b, x):
        x = (x - b.mean_in) / np.sqrt(b.var_in + 1e-5)
        x = b.weight @ x + b.bias
        return np.maximum((x - b.mean_out) / np.sqrt(b.var_out + 1e-5) * b.scale + b.shift, 0)

    for i in (*range(9), 77):
        row = by_id.get(i, tuple([0] * 20))
        tokens = [tower.projections[n][0] @ table[(n, row[j])] + tower.projections[n][1] for j, n in enumerate(names)]
        tokens.append(block(tower.nums, np.array(row[13:], float)))
        tokens.append(block(tower.emb, np.array([float(i), 1.0] if i % 2 == 0 and i < 9 else [0.0, 0.0])))
        tokens.append(block(tower.topic, np.array([0.2, 0.3, 0.5] if i == 1 else [0.0] * 3)))
        x = np.array(tokens)
        q, k, v = x @ tower.query.T, x @ tower.key.T, x @ tower.value.T
        z = np.zeros_like(v)
        for a in range(len(x)):
            e = np.exp([q[a] @ k[b] / 2.0 for b in range(len(x))])
            z[a] = (e / e.sum()) @ v
        e = np.exp(z @ tower.pool)
        w = e / e.sum()
        u = w @ z
        u = (u - u.mean()) / np.sqrt(u.var() + 1e-5)
        assert np.allclose(got[i]["embedding"], u, atol=1e-4)
        assert np.allclose(got[i]["weights"], w, atol=1e-5) and len(got[i]["weights"]) == 16


def test_weight_store_round_trip(spark, tmp_path, monkeypatch):
    sizes, tower, weights = tower_fixture(spark)
    path = str(tmp_path / "store")
    towers.write_tower(tower, weights).write.parquet(path)
    store = spark.read.parquet(path)
    again, tables = towers.read_tower(store, sizes, "kt", 4, 2, 3)
    names, numbers = index_features("kt"), numeric_features("kt")
    rows = [tuple([i] + [0] * 6 + [(i + j) % 9 for j in range(6)] + [0.5 * i + j for j in range(7)]) for i in range(9)]
    features = spark.createDataFrame(rows, ", ".join([f"{n} int" for n in names] + [f"{n} double" for n in numbers]))
    ids = spark.createDataFrame([(i,) for i in range(9)], "id int")
    lists = lambda df: {r["id"]: (r["embedding"], r["weights"]) for r in df.collect()}
    first = lists(towers.tower_embeddings(ids, features, weights, tower, "kt", 4))
    assert first == lists(towers.tower_embeddings(ids, features, tables, again, "kt", 4))
    # beyond the broadcast limit: one salted join, the same result
    monkeypatch.setattr(towers, "BROADCAST_BYTES", 0)
    assert first == lists(towers.tower_embeddings(ids, features, tables, again, "kt", 4))


def test_weight_store_must_fit(spark):
    sizes, tower, weights = tower_fixture(spark)
    store = cut_lineage(towers.write_tower(tower, weights))
    shape = (sizes, "kt", 4, 2, 3)
    towers.check_store(store, towers.store_shapes(*shape))
    some = store.filter("name = 'attention.key' and row = 1")
    broken = {
        "attention.pool: missing": store.filter("name <> 'attention.pool'"),
        "attention.key: 3 rows": store.filter("not (name = 'attention.key' and row = 1)"),
        "attention.key: 5 rows": store.unionByName(some),
        "attention.query: unknown|attention.other: unknown": store.unionByName(some.withColumn("name", F.lit("attention.other"))),
        "attention.key: vectors of 3": store.filter("not (name = 'attention.key' and row = 1)").unionByName(
            some.withColumn("vec", F.slice("vec", 1, 3))
        ),
        "attention.key: vectors of -1": store.filter("not (name = 'attention.key' and row = 1)").unionByName(
            some.withColumn("vec", F.lit(None).cast("array<double>"))
        ),
        "table.inn_kt_index: 8 rows": store.filter("not (name = 'table.inn_kt_index' and row = 8)"),
    }
    for fault, bad in broken.items():
        with pytest.raises(ValueError, match=fault):
            towers.read_tower(bad, *shape)
    with pytest.raises(ValueError, match="topic.weight: unknown"):
        towers.read_tower(store, sizes, "kt", 4, 2)


def test_embedding_dim_rule():
    assert [towers.embedding_dim(n, 32) for n in (1, 3, 4, 99, 10_000)] == [1, 1, 2, 9, 32]


def test_als_is_reproducible_and_learns(spark):
    counts = spark.createDataFrame(
        [(u, i, 5.0) for u in range(20) for i in range(10) if (u < 10) == (i < 5)],
        "inn_dt_index int, inn_kt_index int, n float",
    )
    users, items = learning.als_vectors(counts, "dt", rank=4, iterations=5)
    again, _ = learning.als_vectors(counts, "dt", rank=4, iterations=5)
    a = {r["user"]: r["embedding"] for r in users.collect()}
    assert a == {r["user"]: r["embedding"] for r in again.collect()}
    b = {r["item"]: r["embedding"] for r in items.collect()}
    assert np.dot(a[0], b[0]) > np.dot(a[0], b[7])


def test_learned_vectors_are_evaluated(spark):
    rows = QUERIES["offline_evaluation_als"](spark, SMALL).collect()
    assert {(r["metric"], r["k"]) for r in rows} == {(m, k) for m in ("MAP", "NDCG", "Precision", "Recall") for k in (10, 50, 100)}
    assert all(0 <= r["value"] <= 1 for r in rows) and max(r["value"] for r in rows) > 0


def test_learned_lists_are_true_scores_in_order(spark):
    rows = QUERIES["als_candidates"](spark, SMALL).orderBy("user", "rank").collect()
    for a, b in zip(rows, rows[1:]):
        if a["user"] == b["user"]:
            assert b["rank"] == a["rank"] + 1 and (a["score"], -a["item"]) > (b["score"], -b["item"])


def test_pair_model_scores_every_pair(spark):
    scored = QUERIES["fm_pair_scores"](spark, SMALL)
    row = scored.agg(F.count("*"), F.min("probability"), F.max("probability"),
                     F.sum(F.col("logit").isNull().cast("int"))).first()
    assert row[0] == QUERIES["pairs_forward"](spark, SMALL).count()
    assert 0 <= row[1] <= row[2] <= 1 and row[3] == 0


def test_python_tasks_find_the_package(tmp_path):
    """A session that starts in another folder, with the package on the driver's path only."""
    script = tmp_path / "run.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from paylattice.session import tune
from paylattice.operators.towers import embedding_dim
tune(spark)
assert spark.range(3).select(F.udf(lambda n: embedding_dim(n, 8), "int")("id")).count() == 3
print(spark.range(3).select(F.sum(F.udf(lambda n: embedding_dim(n, 8), "int")("id"))).first()[0])
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]


def test_word_map_csv_keeps_the_schema(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text('word,map_weight,cat1,cat2\nlamp,2,"Home, light",Lamps\n007,,A,\n')
    rows = [tuple(r) for r in tables.read_word_map(spark, str(path)).collect()]
    assert rows == [("lamp", 2.0, "Home, light", "Lamps"), ("007", None, "A", None)]


def test_partition_is_pruned(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-11-30"), (2, "2024-12-31")], "v int, mon string")
    tables.write_table(df, str(tmp_path / "t"), "mon")
    one = tables.scan_partition(spark, str(tmp_path / "t"), "mon", "2024-12-31")
    assert [r["v"] for r in one.collect()] == [2] and one.columns == ["v"]
    assert "PartitionFilters: [isnotnull(mon" in one._jdf.queryExecution().executedPlan().toString()


def test_scan_by_name_and_path(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("some_table")
    assert tables.scan(spark, "some_table").count() == 3
    tables.write_table(spark.range(4), str(tmp_path / "t"))
    assert tables.scan(spark, str(tmp_path / "t")).count() == 4


def test_reuse_follows_the_fingerprint(spark, tmp_path):
    path, built = str(tmp_path / "t"), []

    def build(n):
        built.append(n)
        return spark.range(n)

    assert tables.reuse(spark, path, "a", lambda: build(3)).count() == 3
    assert tables.reuse(spark, path, "a", lambda: build(4)).count() == 3
    assert tables.reuse(spark, path, "b", lambda: build(5)).count() == 5
    assert built == [3, 5]
    assert offline.fingerprint(a=1, b=2) == offline.fingerprint(b=2, a=1) != offline.fingerprint(a=1, b=3)


def test_offline_evaluation_reuses_and_writes_json(spark, tmp_path):
    calls = []

    def vectors(name, rows):
        def build():
            calls.append(name)
            return spark.createDataFrame(rows, f"{name} long, embedding array<float>")
        return build

    users, items = vectors("user", [(0, [1.0, 0.0]), (1, [0.0, 1.0])]), vectors("item", [(0, [1.0, 0.1]), (1, [0.1, 1.0])])
    truth = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "user long, item long")
    for search in ("exact", "ann", "exact"):
        found = offline.evaluate_offline(spark, str(tmp_path / "run"), users, items, truth, 5, [1, 1], {"v": 1}, search)
        assert {(r["metric"], r["k"]): round(r["value"], 6) for r in found.collect()} == {
            (m, 1): 0.666667 for m in ("MAP", "Recall", "Precision", "NDCG")
        }
    assert calls == ["user", "item"]
    files = list((tmp_path / "run" / "metrics").glob("*.json"))
    assert len(files) == 1 and json.loads(files[0].read_text().splitlines()[0])["k"] == 1


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return "/shared/folder/" if key == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert shared_dir(Session()) == "/shared/folder"

    class Cluster:
        class conf:
            @staticmethod
            def get(key, default=None):
                return default

        class sparkContext:
            master = "yarn"
            applicationId = "app"

    with pytest.raises(RuntimeError):
        shared_dir(Cluster())


def test_demo_stage_is_written_once(spark):
    demo, calls = Demo(spark, SMALL), []

    def build():
        calls.append(1)
        return spark.range(2)

    assert demo.stage("twice", build).count() == demo.stage("twice", build).count() == 2
    assert calls == [1]
    assert demo.cfg.top_k == 100


def test_ids_that_share_a_list_are_dealt(spark):
    cold = spark.range(60_000).select(F.concat(F.lit("X"), "id").alias("inn_dt")).coalesce(1)
    none = spark.createDataFrame([], "inn_dt string, inn_kt string, rank int")
    shared = [(f"S{i}", i) for i in range(1, 101)]
    got = recommend.with_cold(none, cold, shared)
    assert got.count() == 60_000 * 100 and got.distinct().count() == 60_000 * 100
    largest = got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 1_500_000


def test_topics_are_inferred_in_many_tasks(spark):
    vectors = spark.range(30_000).select(F.col("id").cast("string").alias("inn_dt"), F.col("id").alias("features")).coalesce(1)

    class Model:  # gives every vector the same topics, whatever it holds
        def transform(self, rows):
            return rows.withColumn("topicDistribution", array_to_vector(F.array(F.lit(0.25), F.lit(0.75))))

    got = topics.topic_weights(Model(), vectors, "dt", 2)
    assert got.rdd.getNumPartitions() == 15
    assert {tuple(r) for r in got.select("dt_topic_weight_0", "dt_topic_weight_1").distinct().collect()} == {(0.25, 0.75)}
    assert got.select("inn_dt").distinct().count() == 30_000
