"""Small literal cases."""

from __future__ import annotations

import math
from decimal import Decimal

import pytest
from pyspark.ml.evaluation import RankingEvaluator
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from paylattice.config import Settings, indexed_columns
from paylattice.operators import indexing, interactions, profiles, quality, ranking, recommend, words
from paylattice.plans.partitions import dealt


def settings(**changes) -> Settings:
    base = dict(
        report_dt="2024-09-30", segments=("s",), kinds=("t",), purpose="contract", train=("2024-01-01", "2024-06-30"),
        test=("2024-07-01", "2024-12-31"), words_since="2024-03-01",
    )
    return Settings(**{**base, **changes})


def money(spark, rows):
    return spark.createDataFrame(
        [(d, k, day, Decimal(str(x))) for d, k, day, x in rows],
        "inn_dt string, inn_kt string, short_dt string, c_sum_fin decimal(14,2)",
    )


def test_stats_of_small_groups(spark):
    df = money(spark, [("a", "one", "2024-01-01", 5)]
               + [(f"p{i}", "constant", "2024-01-01", 3) for i in range(2)]
               + [(p, "skewed", "2024-01-01", x) for p, x in (("a", 1), ("a", 2), ("b", 10))])
    got = {r["inn_kt"]: r for r in profiles.entity_stats(df, "kt").collect()}
    assert (got["one"]["kt_stddev_sum"], got["one"]["kt_skewness_sum"], got["one"]["kt_median_sum"]) == (200000.0, 2.5, 5.0)
    assert (got["constant"]["kt_stddev_sum"], got["constant"]["kt_skewness_sum"]) == (0.0, 2.5)
    # 1, 2, 10: deviations -10/3, -7/3, 17/3; mean cube over mean square to the power 1.5
    expected = ((-1000 - 343 + 4913) / 81) / ((100 + 49 + 289) / 27) ** 1.5
    assert got["skewed"]["kt_skewness_sum"] == pytest.approx(expected, abs=1e-12)
    assert got["skewed"]["kt_buyers_count"] == 2


def test_median_takes_the_lower_middle(spark):
    df = money(spark, [("a", "x", "2024-01-01", v) for v in (1, 2, 3, 9)])
    assert profiles.entity_stats(df, "kt").first()["kt_median_sum"] == 2.0


def test_log_of_minus_one_is_null(spark):
    stats = spark.createDataFrame([("x", -1.0, 1.0, 0.0, 3.0, 1.0, -0.5, 2)],
                                  "inn_kt string, kt_avg_sum double, kt_stddev_sum double, kt_min_sum double, "
                                  "kt_max_sum double, kt_median_sum double, kt_skewness_sum double, kt_buyers_count int")
    row = profiles.log_stats(stats, "kt").first()
    assert row["kt_avg_sum"] is None and row["kt_skewness_sum"] == -0.5
    assert row["kt_max_sum"] == pytest.approx(math.log(4))


def test_code_levels(spark):
    df = spark.createDataFrame([("01.2",), (None,), ("1.2.3.4.5",)], "okved_cd_kt string")
    got = [tuple(r)[1:] for r in profiles.with_code_levels(df, ("kt",)).collect()]
    assert got == [("01", "2", "-1", "-1"), ("-1",) * 4, ("1", "2", "3", "4")]


def test_bank_parts_and_window(spark):
    df = spark.createDataFrame(
        [("044525225", "40702810900000000001", "044525225", None, "2024-01-31", "p"),
         ("044525225", None, None, None, "2024-02-01", "p")],
        "c_bic_kt string, c_num_kt string, c_bic_dt string, c_num_dt string, short_dt string, predicted_value_last string",
    )
    row = interactions.with_bank_parts(df).first()
    assert (row["bic_kt_34"], row["bic_kt_56"], row["bic_kt_79"]) == ("45", "25", "22")
    assert (row["num_kt_13"], row["num_kt_45"], row["num_kt_68"]) == ("407", "02", "810")
    assert row["num_dt_13"] is None
    assert interactions.in_window(df, ("2024-01-01", "2024-01-31"), "p").count() == 1


def test_base_keeps_flag_zero_of_one_snapshot(spark):
    rows = [("2024-09-30", "a", "s", "t", 0), ("2024-09-30", "b", "s", "t", 1), ("2024-06-30", "c", "s", "t", 0),
            ("2024-09-30", "d", "other", "t", 0)]
    df = spark.createDataFrame(rows, "report_dt string, inn string, org_segment string, type string, active_flg int")
    cfg = settings(segments=("s",), kinds=("t",))
    assert [r["inn"] for r in interactions.base_clients(df, cfg).collect()] == ["a"]
    assert interactions.base_clients(df, cfg, live_only=False).count() == 2
    assert [r["inn"] for r in interactions.first_clients(df, 2).collect()] == ["a", "b"]


def passport_like(spark, values):
    columns = indexed_columns("kt")
    rows = [(f"e{i}", v, *["x"] * (len(columns) - 2)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))


def test_label_order_and_unknown(spark):
    df = passport_like(spark, ["z", "a", "a", "m", None])
    labels = indexing.label_table(df, "kt").cache()
    got = {r["label"]: r["index"] for r in labels.filter("column = 'okved_cd_kt'").collect()}
    assert got == {"a": 0, "m": 1, "z": 2}
    numbers = {f"kt_{n}": F.lit(1.0) for n in
               ("avg_sum", "stddev_sum", "min_sum", "max_sum", "median_sum", "skewness_sum", "buyers_count")}
    seen = indexing.indexed_passport(df.withColumns(numbers), labels, "kt")
    assert {r["inn_kt"]: r["okved_cd_kt_index"] for r in seen.collect()} == {"e0": 2, "e1": 0, "e2": 0, "e3": 1, "e4": 3}


def test_labels_equal_string_indexer(spark):
    df = passport_like(spark, ["b", "b", "c", "a", "c", "d", None, "q", "q", "q"])
    columns = indexed_columns("kt")
    model = StringIndexer(inputCols=columns, outputCols=[f"{c}_i" for c in columns], handleInvalid="keep").fit(df)
    labels = indexing.label_table(df, "kt")
    for column, expected in zip(columns, model.labelsArray):
        got = [r["label"] for r in labels.filter(F.col("column") == column).orderBy("index").collect()]
        assert got == list(expected)


def test_feature_size_check_raises(spark):
    indexed = spark.createDataFrame([tuple([5] + [0] * 12)], ", ".join(f"{c}_index int" for c in indexed_columns("kt")))
    names = [f"{c}_index" for c in indexed_columns("kt")]
    sizes = spark.createDataFrame([(n, 1) for n in names], "feature string, size long")
    with pytest.raises(ValueError, match="inn_kt_index: too small"):
        indexing.require_valid_features(indexed, sizes, names, "kt")
    fitting = spark.createDataFrame([(n, 6) for n in names], "feature string, size long")
    indexing.require_valid_features(indexed, fitting, names, "kt")


def predictions(spark, lists):
    return spark.createDataFrame([(u, r + 1, i) for u, items in lists.items() for r, i in enumerate(items)],
                                 "user int, rank int, item int")


def truth(spark, lists):
    return spark.createDataFrame([(u, i) for u, items in lists.items() for i in items], "user int, item int")


def by_metric(df, k):
    return {r["metric"]: r["value"] for r in df.filter(F.col("k") == k).collect()}


def test_ranking_metrics_literal(spark):
    found = ranking.ranking_metrics(truth(spark, {1: [1, 2], 2: [1]}), predictions(spark, {1: [3, 1, 9]}), [3, 3])
    assert found.count() == 4
    got = by_metric(found, 3)
    assert got["MAP"] == pytest.approx(0.125)
    assert got["Precision"] == pytest.approx(1 / 6)
    assert got["NDCG"] == pytest.approx(0.19343, abs=1e-5)
    assert got["Recall"] == pytest.approx(0.25)


def test_repeated_predictions(spark):
    got = by_metric(ranking.ranking_metrics(truth(spark, {1: [7, 8]}), predictions(spark, {1: [7, 7, 8]}), [3]), 3)
    assert got["MAP"] == pytest.approx((1 + 2 / 3) / 2)
    assert got["Recall"] == 1.0
    assert got["Precision"] == pytest.approx(2 / 3)
    assert got["NDCG"] == pytest.approx((1 + 1 / math.log2(3) + 0.5) / (1 + 1 / math.log2(3)))


def test_unknown_and_empty_truth(spark):
    t = spark.createDataFrame([(1, None), (2, 5)], "user int, item int")
    users = spark.createDataFrame([(1,), (2,), (3,)], "user int")
    rows = {r["user"]: r for r in ranking.user_metrics(t, predictions(spark, {1: [4], 2: [5], 3: [6]}), [1], users).collect()}
    assert (rows[1]["MAP"], rows[1]["Recall"], rows[1]["Precision"], rows[1]["NDCG"]) == (1.0, 1.0, 0.0, 0.0)
    assert (rows[2]["MAP"], rows[2]["Recall"], rows[2]["Precision"], rows[2]["NDCG"]) == (1.0, 1.0, 1.0, 1.0)
    assert (rows[3]["MAP"], rows[3]["Recall"], rows[3]["Precision"], rows[3]["NDCG"]) == (0.0, 0.0, 0.0, 0.0)


def test_metrics_agree_with_ranking_evaluator(spark):
    lists = {u: [(u * 7 + i * 3) % 40 for i in range(12)] for u in range(9)}
    wanted = {u: [(u * 5 + i * 11) % 40 for i in range(6)] for u in range(9)}
    ours = ranking.ranking_metrics(truth(spark, wanted), predictions(spark, lists), [4, 10])
    pairs = spark.createDataFrame(
        [([float(x) for x in lists[u]], [float(x) for x in wanted[u]]) for u in lists],
        "prediction array<double>, label array<double>",
    )
    names = {"MAP": "meanAveragePrecisionAtK", "Recall": "recallAtK", "Precision": "precisionAtK", "NDCG": "ndcgAtK"}
    for k in (4, 10):
        got = by_metric(ours, k)
        for ours_name, theirs in names.items():
            assert got[ours_name] == pytest.approx(RankingEvaluator(metricName=theirs, k=k).evaluate(pairs)), (ours_name, k)


def test_recall_grows_with_k(spark):
    found = ranking.ranking_metrics(truth(spark, {1: list(range(5)), 2: [9]}),
                                    predictions(spark, {1: [8, 0, 7, 1, 2], 2: [1, 9]}), range(1, 6))
    recalls = [r["value"] for r in found.filter("metric = 'Recall'").orderBy("k").collect()]
    assert recalls == sorted(recalls)


def test_pointwise_with_ties(spark):
    scores = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 2.0), (0.0, -1.0)], "label double, logit double")
    got = {r["metric"]: r["value"] for r in quality.pointwise_metrics(scores).collect()}
    assert got["accuracy"] == 0.75  # 0 is not above 0
    assert got["auc_roc"] == pytest.approx(0.875)
    assert got["average_precision"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert got["f1"] == pytest.approx(2 * 2 / (3 + 2))  # 0 counts as chosen


def test_losses_do_not_overflow(spark):
    bce = quality.bce_loss(spark.createDataFrame([(1.0, 800.0), (0.0, -800.0)], "label double, logit double")).first()
    assert bce["value"] == 0.0
    bpr = quality.ranking_loss(
        spark.createDataFrame([(0.0, 0.0), (900.0, 0.0)], "positive_score double, negative_score double")).first()
    assert bpr["value"] == pytest.approx(math.log(2) / 2)


def test_rollup_weights_batches(spark):
    batches = spark.createDataFrame([("t", "m", 1.0, 1), ("t", "m", 0.0, 3)], "part string, metric string, value double, n long")
    assert quality.metric_rollup(batches, ["part"]).first()["average"] == 0.25


def test_words_ties_zero_amounts_and_uncategorised(spark):
    totals = spark.createDataFrame(
        [("c", "w1", 10.0, 2), ("c", "w2", 10.0, 2), ("c", "w3", 5.0, 1), ("c", "w4", 1.0, 1), ("z", "w1", 0.0, 0)],
        "inn_kt string, word string, word_sum double, word_nunique_cnt long",
    )
    cfg = settings(top_words=1)
    scores = words.word_scores(totals, cfg)
    assert scores.filter("inn_kt = 'z'").first()["total_score"] == 0.0
    mapping = spark.createDataFrame(
        [("w1", 1.0, "A", "a"), ("w1", 2.0, "B", "b"), ("w2", 0.0, "A", "a"), ("w3", 9.0, "A", "a")],
        "word string, map_weight double, cat1 string, cat2 string")
    categorised = words.word_categories(scores, mapping, cfg)
    assert categorised.filter("inn_kt = 'c'").count() == 3  # w3 weighs too much, w4 has no category
    top = words.top_words(categorised.filter("inn_kt = 'c'"), cfg)
    assert sorted(r["word"] for r in top.collect()) == ["w1", "w2"]  # a tie keeps both
    ranks = words.category_ranks(words.category_scores(categorised.filter("inn_kt = 'c'")))
    assert {(r["cat1"], r["total_rank"]) for r in ranks.collect()} == {("A", 1), ("B", 2)}


def test_recommendation_names_and_missing_weights(spark):
    map_dt = spark.createDataFrame([("d0", 0)], "inn_dt string, inn_dt_index int")
    map_kt = spark.createDataFrame([("k0", 0), ("k1", 1)], "inn_kt string, inn_kt_index int")
    recs = spark.createDataFrame([(0, 1, 1), (0, 2, 7), (0, 3, 0)], "user int, rank int, item int")
    table = recommend.recommendation_table(recs, map_dt, map_kt)
    assert {(r["inn_dt"], r["inn_kt"], r["rank"]) for r in table.collect()} == {("d0", "k1", 1), ("d0", "k0", 3)}
    weights = spark.createDataFrame([("k1", [0.5, 0.25, 0.125])], "inn_kt string, weights array<float>")
    named = {r["inn_kt"]: r for r in recommend.importance_table(table, weights, "kt", ["a", "b"]).collect()}
    assert (named["k1"]["a"], named["k1"]["b"], named["k0"]["a"]) == (0.5, 0.25, None)


def test_export_is_sorted(spark, tmp_path):
    df = spark.createDataFrame([("b", "x", 2), ("a", "y", 1), ("b", "z", 1)], "inn_dt string, inn_kt string, rank int")
    recommend.export_sorted(df, str(tmp_path / "out"))
    lines = [line for f in sorted((tmp_path / "out").glob("*.csv")) for line in f.read_text().splitlines()[1:]]
    assert lines == ["a,y,1", "b,z,1", "b,x,2"]


def test_entropy(spark):
    df = money(spark, [("a", "x", "2024-01-01", 1), ("a", "y", "2024-01-01", 1), ("b", "x", "2024-01-01", 4)])
    got = {r["inn_dt"]: r for r in profiles.entity_entropy(df, "dt").collect()}
    assert got["a"]["dt_entropy"] == pytest.approx(math.log(2)) and got["a"]["dt_normalized_entropy"] == pytest.approx(1)
    assert got["b"]["dt_entropy"] == 0.0


def test_payments_of_a_window_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(day: str) -> str:
        read.add(1)
        return day

    paid = spark.createDataFrame(
        [("a", "b", "2024-01-05", 1), ("a", "b", "2024-01-05", 2), ("c", "b", "2024-01-06", 4), ("a", "x", "2024-01-06", 8)],
        "inn_dt string, inn_kt string, short_dt string, c_sum int",
    ).withColumns({"short_dt": F.udf(seen, "string")("short_dt"), "c_sum": F.col("c_sum").cast("decimal(14,2)")})
    paid = paid.withColumns({c: F.lit("1" * 20) for c in ("c_bic_kt", "c_num_kt", "c_bic_dt", "c_num_dt")})
    cfg = settings()
    day = paid.withColumn("predicted_value_last", F.lit(cfg.purpose))
    clients = spark.createDataFrame([(i,) for i in "abc"], "inn string").withColumns(
        {"report_dt": F.lit(cfg.report_dt), cfg.segment_column: F.lit(cfg.segments[0]), "type": F.lit(cfg.kinds[0]),
         "active_flg": F.lit(0), "okved_cd": F.lit("1.2"), "okato_cd": F.lit("o")})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with long client lists: frequent keys are counted
    try:
        rows = interactions.build_interactions(day, clients, cfg, ("2024-01-01", "2024-01-31")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r["inn_dt"], float(r["c_sum_fin"])) for r in rows) == [("a", 3.0), ("c", 4.0)]
    assert read.value <= 2 * 4  # the filter and the column; three times as often before


def test_word_totals_per_payment(spark):
    rows = spark.createDataFrame(
        [("k", 1, "w", 2), ("k", 1, "w", 4), ("k", 2, "w", 8), ("k", None, "w", 16), ("k", None, None, 32), ("k", 3, None, 64), ("l", 1, None, 2)],
        "inn_kt string, id long, word string, c_sum int",
    ).withColumns({"c_sum": F.col("c_sum").cast("decimal(14,2)"), "sum_koef": F.lit("0.5").cast("decimal(3,2)")})
    totals = words.word_totals(rows)
    assert [tuple(map(float, r[2:])) for r in totals.collect()] == [(15.0, 2.0, 3.0, 63.0)]
    assert {(r["inn_kt"], r["all_nunique_cnt"], float(r["all_sum"])) for r in words.company_totals(rows).collect()} == {("k", 3, 63.0), ("l", 1, 1.0)}
    parts = dealt(spark.range(100).select((F.col("id") % 50).alias("key")), ["key"], rows=5)
    held = parts.select("key", F.spark_partition_id().alias("part")).distinct().groupBy("key").count()
    assert parts.rdd.getNumPartitions() == 20 and held.filter("count > 1").count() == 0  # as many parts as the rows need
