"""The registered queries: every operator run over whole test tables, under comparable column names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict
from functools import cache

from pyspark.ml.clustering import LocalLDAModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paylattice.config import (
    SIDES,
    entity,
    importance_names,
    index_features,
    numeric_features,
    other,
)
from paylattice.functions.columns import dot
from paylattice.operators import (
    embeddings,
    forest,
    indexing,
    interactions,
    learning,
    offline,
    pair_model,
    pairs,
    profiles,
    quality,
    ranking,
    recommend,
    retrieval,
    topics,
    towers,
    words,
)
from paylattice.sources import tables
from paylattice.sources.demo import Demo

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BATCH = 4096
IN_BATCH = 256


def query(name: str):
    def register(build: Callable[[Demo], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Demo(spark, folder))
        return build

    return register


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def as_double(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# --- clients, payments, interactions ---------------------------------------------------


@query("base_clients")
def _(d: Demo):
    return interactions.base_clients(d.clients(), d.cfg).select("inn", "okved_cd", "okato_cd")


@query("first_clients")
def _(d: Demo):
    return interactions.first_clients(interactions.base_clients(d.clients(), d.cfg), 500).select("inn")


@query("snapshot_inventory")
def _(d: Demo):
    return interactions.snapshot_inventory(d.clients())


@query("date_window")
def _(d: Demo):
    kept = interactions.in_window(d.payments(), d.cfg.test, d.cfg.purpose)
    return as_double(kept.select("inn_dt", "inn_kt", "short_dt", "c_sum"), "c_sum")


@query("bank_substrings")
def _(d: Demo):
    return as_double(interactions.with_bank_parts(d.payments()).drop("predicted_value_last"), "c_sum")


@query("interactions")
def _(d: Demo):
    return as_double(d.live_interactions(d.cfg.train), "c_sum_fin")


# --- statistics and passports -------------------------------------------------------------


def stat_digits(side: str) -> dict[str, int]:
    return {f"{side}_stddev_sum": 4, f"{side}_skewness_sum": 6}


def _stats(side: str):
    return lambda d: rounded(profiles.entity_stats(d.train(), side), stat_digits(side))


query("entity_stats_kt")(_stats("kt"))
query("entity_stats_dt")(_stats("dt"))


@query("entity_stats_log")
def _(d: Demo):
    logged = profiles.log_stats(profiles.entity_stats(d.train(), "kt"), "kt")
    return rounded(logged, {c: 6 for c in numeric_features("kt")})


@query("code_levels")
def _(d: Demo):
    levels = [f"okved_cd_{s}_lvl{i}" for s in SIDES for i in range(1, 5)]
    split = profiles.with_code_levels(d.train()).select("inn_dt", "inn_kt", "short_dt", *levels)
    return split


def _passport(side: str):
    return lambda d: rounded(profiles.passport(d.train(), side), stat_digits(side))


query("passport_kt")(_passport("kt"))
query("passport_dt")(_passport("dt"))


@query("entity_entropy")
def _(d: Demo):
    found = profiles.entity_entropy(d.train(), "dt")
    return rounded(found, {"dt_entropy": 6, "dt_normalized_entropy": 6})


@query("partner_count_buckets")
def _(d: Demo):
    return profiles.partner_count_buckets(profiles.partner_counts(d.train(), "dt"), "dt")


def _extended(side: str):
    def build(d: Demo):
        buckets = profiles.partner_count_buckets(profiles.partner_counts(d.train(), side), side)
        found = profiles.extended_passport(d.passport(side), profiles.entity_entropy(d.train(), side), buckets, side)
        return rounded(found, {**stat_digits(side), f"{side}_entropy": 6, f"{side}_normalized_entropy": 6})

    return build


query("passport_extended")(_extended("dt"))
query("passport_extended_kt")(_extended("kt"))


@query("asinh_weights")
def _(d: Demo):
    return rounded(as_double(profiles.asinh_weights(d.train()), "c_sum_fin"), {"weight": 9})


# --- label indexing -----------------------------------------------------------------------


def _labels(side: str):
    return lambda d: indexing.label_table(d.passport(side), side)


query("label_index_kt")(_labels("kt"))
query("label_index_dt")(_labels("dt"))


@query("label_map")
def _(d: Demo):
    both = [
        indexing.label_map(d.labels(s), s).select(
            F.lit(s).alias("side"), F.col(entity(s)).alias("inn"), F.col(f"{entity(s)}_index").alias("index")
        )
        for s in SIDES
    ]
    return both[0].unionByName(both[1])


def _indexed(side: str):
    return lambda d: rounded(
        indexing.indexed_passport(d.passport(side), d.labels(side), side), stat_digits(side)
    )


query("passport_indexed")(_indexed("dt"))
query("passport_indexed_kt")(_indexed("kt"))


@query("entity_feature_table")
def _(d: Demo):
    return rounded(indexing.feature_table(d.indexed("kt"), "kt"), stat_digits("kt"))


@query("feature_sizes")
def _(d: Demo):
    both = [indexing.feature_sizes(d.indexed(s), s).withColumn("side", F.lit(s)) for s in SIDES]
    return both[0].unionByName(both[1])


@query("feature_size_check")
def _(d: Demo):
    """Test-window payers indexed with the training labels, against sizes of the training window."""
    sizes = indexing.feature_sizes(d.indexed("dt"), "dt")
    later = indexing.indexed_passport(profiles.passport(d.test(), "dt"), d.labels("dt"), "dt")
    expected = [*index_features("dt")[:-1], "dt_buyers_count_index"]
    return indexing.feature_size_check(later, sizes, expected, "dt")


# --- truth and ranking metrics ------------------------------------------------------------


def history_candidates(d: Demo, side: str, k: int) -> DataFrame:
    """Prediction lists for the metric queries: an entity's most frequent training partners."""
    own, partner = f"{entity(side)}_index", f"{entity(other(side))}_index"
    counts = learning.pair_counts(d.train(), indexing.label_map(d.labels("dt"), "dt"), indexing.label_map(d.labels("kt"), "kt"))
    best = Window.partitionBy("user").orderBy(F.desc("n"), "item")
    named = counts.select(F.col(own).alias("user"), F.col(partner).alias("item"), "n")
    return named.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("user", "rank", "item")


def _truth(side: str):
    return lambda d: ranking.truth_sets(d.test(), d.indexed("dt"), d.indexed("kt"), side, d.cfg.min_test_rows)


query("truth_sets")(_truth("dt"))
query("truth_sets_reverse")(_truth("kt"))


@query("truth_set_size")
def _(d: Demo):
    return rounded(ranking.truth_set_size(ranking.truth_rows(d.truth("dt"), "dt")), {"mean_size": 9})


@query("top_active_users")
def _(d: Demo):
    return ranking.top_active_users(ranking.truth_rows(d.truth("dt"), "dt"), 50)


def _metrics(side: str):
    def build(d: Demo):
        truth = ranking.truth_rows(d.truth(side), side)
        found = ranking.ranking_metrics(truth, history_candidates(d, side, 100), d.cfg.metrics_k)
        return rounded(found, {"value": 9})

    return build


query("ranking_metrics")(_metrics("dt"))
query("ranking_metrics_reverse")(_metrics("kt"))


@query("metrics_k_sweep")
def _(d: Demo):
    truth = ranking.truth_rows(d.truth("dt"), "dt")
    active = ranking.restrict_users(truth, ranking.top_active_users(truth, 50))
    found = ranking.ranking_metrics(active, history_candidates(d, "dt", 20), range(2, 21))
    return rounded(found, {"value": 9})


# --- goods words ----------------------------------------------------------------------------


def _word_rows(d: Demo) -> DataFrame:
    return words.word_rows(d.payment_words(), interactions.base_clients(d.clients(), d.cfg), d.cfg.words_since)


def _word_scores(d: Demo) -> DataFrame:
    totals = d.stage("word_totals", lambda: words.word_totals(_word_rows(d)))
    return words.word_scores(totals, d.cfg)


def _word_categories(d: Demo) -> DataFrame:
    return words.word_categories(_word_scores(d), d.stage("word_map", d.word_map), d.cfg)


@query("word_rows")
def _(d: Demo):
    return as_double(_word_rows(d), "c_sum", "sum_koef")


@query("company_totals")
def _(d: Demo):
    return as_double(words.company_totals(_word_rows(d)), "all_sum")


@query("word_totals")
def _(d: Demo):
    return as_double(words.word_totals(_word_rows(d)), "word_sum", "all_sum")


@query("word_scores")
def _(d: Demo):
    scores = as_double(_word_scores(d), "word_sum", "all_sum")
    return rounded(scores, {"norm_sum": 9, "norm_freq": 9, "total_score": 9})


@query("top_words")
def _(d: Demo):
    return rounded(words.top_words(_word_categories(d), d.cfg), {"total_score": 9})


@query("category_scores")
def _(d: Demo):
    return rounded(as_double(words.category_scores(_word_categories(d)), "total_score", "word_sum"), {"total_score": 8})


@query("category_ranks")
def _(d: Demo):
    ranked = words.category_ranks(words.category_scores(_word_categories(d)))
    return rounded(as_double(ranked, "total_score", "word_sum"), {"total_score": 8})


@query("word_inventory")
def _(d: Demo):
    totals = d.stage("word_totals", lambda: words.word_totals(_word_rows(d)))
    return words.word_inventory(totals, d.stage("word_map", d.word_map), d.cfg)


@query("source_csv_map")
def _(d: Demo):
    path = d.scratch("word_map_csv")
    d.word_map().write.mode("overwrite").option("header", True).csv(path)
    return tables.read_word_map(d.spark, path)


# --- embeddings and retrieval ---------------------------------------------------------------


def _packed(d: Demo) -> DataFrame:
    """External embeddings: wide table with one directory per month, one month read back."""
    path = d.scratch("embeddings_wide")
    if not tables.table_exists(d.spark, path):
        tables.write_table(d.embeddings_wide(), path, "mon")
    month = tables.scan_partition(d.spark, path, "mon", "2024-12-31")
    return embeddings.pack_embeddings(month, d.cfg.embedding_width)


def _vectors(d: Demo, side: str) -> DataFrame:
    return d.stage(
        f"{side}_embeddings_indexed", lambda: embeddings.indexed_embeddings(_packed(d), d.indexed(side), side)
    )


@query("embedding_pack")
def _(d: Demo):
    found = embeddings.indexed_embeddings(_packed(d), d.indexed("dt"), "dt")
    return found.select(
        "inn_dt", "inn_dt_index",
        F.size("embedding").alias("width"),
        *[F.round(F.get("embedding", F.lit(i)).cast("double"), 6).alias(f"e{i}") for i in (0, 31, 63)],
        F.round(dot("embedding", "embedding"), 6).alias("square_length"),
    )


@query("exact_topk_cosine")
def _(d: Demo):
    return retrieval.exact_topk(d.query_vectors(), d.catalogue_vectors(), d.cfg.top_k, "cosine")


@query("exact_topk_dot")
def _(d: Demo):
    return retrieval.exact_topk(d.query_vectors(), d.catalogue_vectors(), d.cfg.top_k, "dot")


@query("ann_topk_clusters")
def _(d: Demo):
    return retrieval.ann_topk(d.query_vectors(), d.catalogue_vectors(), d.cfg.top_k, seed=d.cfg.seed)


@query("ann_recall")
def _(d: Demo):
    """Share of all pairs that the approximate search scores, and its recall against the exact one."""
    users, items, k = d.query_vectors(), d.catalogue_vectors(), d.cfg.top_k
    return retrieval.recall_report(users, items, k, seed=d.cfg.seed)


@query("ann_topk_forest")
def _(d: Demo):
    return forest.forest_topk(d.query_vectors(), d.catalogue_vectors(), d.cfg.top_k, seed=d.cfg.seed)


@query("ann_recall_forest")
def _(d: Demo):
    """Share of all pairs that the forest scores, its recall against the exact search, and its shape."""
    return forest.forest_report(d.query_vectors(), d.catalogue_vectors(), d.cfg.top_k, seed=d.cfg.seed)


@query("pair_scores")
def _(d: Demo):
    paid = d.train().select("inn_dt", "inn_kt").distinct()
    scored = retrieval.pair_scores(paid, _vectors(d, "dt"), _vectors(d, "kt"))
    return rounded(scored, {"score": 9})


@query("entity_ids")
def _(d: Demo):
    features, truth = d.indexed("dt"), d.truth("dt")
    listed = d.requests().join(indexing.label_map(d.labels("dt"), "dt"), "inn_dt")
    parts = [
        retrieval.entity_ids(source, features, truth, "inn_dt_index").select(F.lit(name).alias("source"), F.col("inn_dt_index").alias("id"))
        for name, source in (("all", "all"), ("test_dict", "test_dict"), ("list", listed))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- training pairs -------------------------------------------------------------------------


def _maps(d: Demo) -> dict[str, DataFrame]:
    return {s: indexing.label_map(d.labels(s), s) for s in SIDES}


def _positives(d: Demo) -> DataFrame:
    maps = _maps(d)
    return pairs.positive_pairs(d.train(), maps["dt"], maps["kt"])


def _pairs(d: Demo, side: str, stage: str | None = None) -> DataFrame:
    """Labelled pairs; with a `stage` the drawn rows are written, so that fewer shuffles are held at once."""
    maps = _maps(d)

    def drawn() -> DataFrame:
        n = indexing.label_counts(d.labels(side))[entity(side)]
        known = pairs.positive_pairs(pairs.with_draw(d.train(), d.cfg.seed), maps["dt"], maps["kt"])
        found = pairs.with_uniform_negative(known, side, n, d.cfg.seed)
        return found.select("inn_dt", "inn_kt", "inn_dt_index", "inn_kt_index", "short_dt", "negative")

    return pairs.labelled_pairs(d.stage(stage, drawn) if stage else drawn(), side, maps[side])


@query("shuffle_train")
def _(d: Demo):
    return pairs.shuffled(d.train(), d.cfg.seed).select("shuffle_key", "inn_dt", "inn_kt", "short_dt")


@query("positive_pairs")
def _(d: Demo):
    """Test rows kept for training pairs: both parties are known to the training indexers."""
    maps = _maps(d)
    kept = pairs.positive_pairs(d.test(), maps["dt"], maps["kt"])
    return kept.select("inn_dt", "inn_kt", "short_dt", "inn_dt_index", "inn_kt_index")


@query("pairs_forward")
def _(d: Demo):
    return _pairs(d, "kt")


@query("pairs_reverse")
def _(d: Demo):
    return _pairs(d, "dt")


@query("pairs_popularity")
def _(d: Demo):
    weights = pairs.popularity(d.train(), _maps(d)["kt"], "kt")
    drawn = pairs.with_popular_negative(_positives(d), weights, "kt", d.cfg.seed)
    return drawn.select("inn_dt_index", "inn_kt_index", "short_dt", "negative")


@query("pairs_in_batch")
def _(d: Demo):
    return pairs.in_batch_pairs(_positives(d), "kt", IN_BATCH, d.cfg.seed, shifts=(1, 2))


@query("in_batch_loss")
def _(d: Demo):
    """Ranking loss of external vectors over all negatives of each batch."""
    vectors = [_vectors(d, s).select(F.col(f"{entity(s)}_index").alias("index"), "embedding") for s in SIDES]
    placed = pairs.batches(_positives(d), IN_BATCH, d.cfg.seed)
    return rounded(pairs.in_batch_loss(placed, *vectors, "kt"), {"value": 8})


def _side_features(d: Demo, side: str) -> DataFrame:
    vectors = _vectors(d, side).select(F.col(f"{entity(side)}_index").alias("index"), "embedding")
    return pairs.side_features(d.indexed(side), side, vectors, d.cfg.embedding_width)


def _pair_features(user_side: str):
    def build(d: Demo):
        features = {s: d.stage(f"{s}_side_features", lambda s=s: _side_features(d, s)) for s in SIDES}
        width = d.cfg.embedding_width
        samples = pairs.pair_features(_pairs(d, other(user_side)), features, user_side)
        samples = pairs.fill_vectors(samples, {"dt_emb": width, "kt_emb": width})
        flat = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("user", "item")]
        for role in ("user", "item"):
            flat += [
                F.round(F.get(f"double_{role}", F.lit(i)).cast("double"), 3).alias(f"double_{role}_{i}")
                for i in range(7)
            ]
        for side in SIDES:
            flat += [
                F.size(f"{side}_emb").alias(f"{side}_width"),
                F.round(F.get(f"{side}_emb", F.lit(7)).cast("double"), 6).alias(f"{side}_emb_7"),
            ]
        return samples.select("label", "inn_dt_index", "inn_kt_index", "short_dt", *flat)

    return build


query("pair_features")(_pair_features("dt"))
query("pair_features_reverse")(_pair_features("kt"))


@query("epoch_length")
def _(d: Demo):
    train = pairs.epoch_length(d.train(), BATCH, drop_last=True).withColumn("part", F.lit("train"))
    val = pairs.epoch_length(d.test(), BATCH, drop_last=False).withColumn("part", F.lit("val"))
    return train.unionByName(val)


# --- metrics and losses of scores ---------------------------------------------------------


@query("pointwise_metrics")
def _(d: Demo):
    return rounded(quality.pointwise_metrics(d.quality_scores()), {"value": 9})


def _pair_logit(dt: str, kt: str):
    return (F.pmod(F.col(dt) * 31 + F.col(kt) * 17, F.lit(101)) - 50) / 25.0


@query("loss_report")
def _(d: Demo):
    n = indexing.label_counts(d.labels("kt"))["inn_kt"]
    drawn = pairs.with_uniform_negative(_positives(d), "kt", n, d.cfg.seed).select(
        _pair_logit("inn_dt_index", "inn_kt_index").alias("positive_score"),
        _pair_logit("inn_dt_index", "negative").alias("negative_score"),
    )
    both = quality.bce_loss(d.quality_scores()).unionByName(quality.ranking_loss(drawn))
    return rounded(both, {"value": 9})


@query("metric_rollup")
def _(d: Demo):
    parts = d.quality_scores().select(
        F.when(F.col("doc_id") % 4 == 0, "val").otherwise("train").alias("part"),
        F.floor(F.col("doc_id") / 64).alias("batch"),
        "label", "logit",
    )
    rolled = quality.metric_rollup(quality.batch_metrics(parts, ["part", "batch"]), ["part"])
    return rounded(rolled, {"average": 9})


# --- recommendation tables ------------------------------------------------------------------


@query("cold_entities")
def _(d: Demo):
    return recommend.cold_entities(d.requests(), _maps(d)["dt"], "dt")


def _recommendations(d: Demo) -> DataFrame:
    maps = _maps(d)
    history = d.stage("history_dt", lambda: history_candidates(d, "dt", 100))
    known = recommend.recommendation_table(history, maps["dt"], maps["kt"])
    cold = recommend.cold_entities(d.requests(), maps["dt"], "dt")
    return recommend.with_cold(known, cold, recommend.popular_list(known, d.cfg.top_k))


@query("recommendation_table")
def _(d: Demo):
    return recommend.requested(_recommendations(d), d.requests())


@query("recommendation_union")
def _(d: Demo):
    return recommend.recommendation_union(d.requests(), recommend.requested(_recommendations(d), d.requests()))


@query("importance_table")
def _(d: Demo):
    names = importance_names("kt")
    weights = _vectors(d, "kt").select("inn_kt", F.slice("embedding", 1, len(names)).alias("weights"))
    named = recommend.importance_table(_recommendations(d), weights, "kt")
    return named.select(
        "inn_dt", "inn_kt", "rank", *[F.round(F.col(n).cast("double"), 6).alias(n) for n in names]
    )


# --- topics -----------------------------------------------------------------------------------


@query("entity_documents")
def _(d: Demo):
    return topics.entity_documents(d.payment_words(), "inn_kt")


@query("word_counts")
def _(d: Demo):
    bags = d.stage("document_bags", lambda: topics.entity_documents(d.document_words(), "doc_id"))
    vocab = d.stage("document_vocabulary", lambda: topics.vocabulary(bags, d.cfg.vocab_size, d.cfg.min_df))
    return topics.word_counts(bags, vocab, "doc_id")


def _topic_weights(d: Demo, side: str) -> DataFrame:
    def build() -> DataFrame:
        window = d.payment_words().filter(F.col("short_dt").between(*d.cfg.train))
        bags = d.stage(f"{side}_bags", lambda: topics.entity_documents(window, entity(side)))
        model, vocab, vectors = topics.fit_topics(bags, side, d.cfg)
        tables.save_model(model, d.scratch(f"context_{side}_lda_model"))
        tables.save_model(topics.vocabulary_model(vocab), d.scratch(f"context_{side}_cv_model"))
        return topics.topic_weights(model, vectors, side, d.cfg.n_topics)

    return d.stage(f"{side}_topic_embeddings", build)


@query("topic_weights")
def _(d: Demo):
    return _topic_weights(d, "dt")


@query("topic_indexed")
def _(d: Demo):
    return topics.topic_vectors(_topic_weights(d, "dt"), _maps(d)["dt"], "dt", d.cfg.n_topics)


# --- learned parts, offline evaluation, files ---------------------------------------------------


@query("als_candidates")
def _(d: Demo):
    maps = _maps(d)
    counts = d.stage("pair_counts", lambda: learning.pair_counts(d.train(), maps["dt"], maps["kt"]))
    users, items = learning.als_vectors(counts, "dt", d.cfg.als_rank, d.cfg.als_iterations, d.cfg.seed)
    return retrieval.exact_topk(users, items, d.cfg.top_k, "dot")


def _log_features(d: Demo) -> dict[str, DataFrame]:
    return {
        s: d.stage(f"{s}_log_features", lambda s=s: indexing.feature_table(profiles.log_stats(d.indexed(s), s), s))
        for s in SIDES
    }


def _parts(d: Demo, name: str, labelled: Callable[[], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Labelled pairs in parts, and the packed parts; the written pairs have hashes of their entities' entries only."""
    features = _log_features(d)
    encoded = d.stage(f"{name}_pairs", lambda: pair_model.encode_pairs(labelled(), features, entries=False))
    parted = pair_model.in_parts(encoded, written=True)
    return parted, d.stage(f"{name}_parts", lambda: pair_model.packed_parts(parted, features))


def _pair_model(d: Demo) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labelled pairs of the training window in parts, the weights fitted on them, and the packed parts."""
    parted, packed = _parts(d, "training", lambda: _pairs(d, "kt", stage="training_drawn"))
    weights = d.stage(
        "pair_model", lambda: pair_model.fit_pair_model(parted, d.cfg.fm_factors, d.cfg.fm_iterations, d.cfg.seed, packed=packed)
    )
    return parted, weights, packed


@query("fm_pair_scores")
def _(d: Demo):
    return pair_model.score_pairs(*_pair_model(d))


@query("fm_later_metrics")
def _(d: Demo):
    """The pair model of the training window on labelled pairs of the test window."""
    _, weights, _ = _pair_model(d)
    maps = _maps(d)
    n = indexing.label_counts(d.labels("kt"))["inn_kt"]
    drawn = d.stage(
        "later_pairs",
        lambda: pairs.with_uniform_negative(
            pairs.positive_pairs(pairs.with_draw(d.test(), d.cfg.seed), maps["dt"], maps["kt"]), "kt", n, d.cfg.seed
        ).select("inn_dt_index", "inn_kt_index", "negative"),
    )
    options = F.array(
        F.struct(F.lit(1).alias("label"), F.col("inn_kt_index")), F.struct(F.lit(0).alias("label"), F.col("negative").alias("inn_kt_index"))
    )
    labelled = drawn.select("inn_dt_index", F.explode(options).alias("p")).select("p.label", "inn_dt_index", "p.inn_kt_index")
    parted, packed = _parts(d, "later_labelled", lambda: labelled)
    scores = d.stage("later_scores", lambda: pair_model.score_distinct(parted, weights, packed))
    logit = scores.select("inn_dt_index", "inn_kt_index", (F.col("label") > 0.5).alias("paid"), F.col("logit").alias("s"))
    both = (
        drawn.groupBy("inn_dt_index", "inn_kt_index", "negative").agg(F.count(F.lit(1)).alias("n"))
        .join(logit.filter("paid").select("inn_dt_index", "inn_kt_index", F.col("s").alias("positive_score")), ["inn_dt_index", "inn_kt_index"])
        .join(
            logit.filter("not paid").select("inn_dt_index", F.col("inn_kt_index").alias("negative"), F.col("s").alias("negative_score")),
            ["inn_dt_index", "negative"],
        )
    )
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy")
    every = scores.select("label", "logit", times)
    losses = quality.bce_loss(every).unionByName(quality.ranking_loss(both.select("*", times)))
    found = quality.pointwise_metrics(every).unionByName(losses.withColumnRenamed("loss", "metric"))
    return rounded(found, {"value": 9})


TOWER_WIDTH = 16


def stated_store(d: Demo, shapes: dict[str, tuple[int, int]]) -> DataFrame:
    """Weights stated by arithmetic on the number of the weight, its row and its column, as no trained ones are published."""
    stated = d.spark.createDataFrame(
        [(name, n, *shape) for n, (name, shape) in enumerate(shapes.items())], "name string, n int, rows int, cols int"
    )
    spread = stated.select("*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"))

    def value(col):
        plain = ((F.col("n") * 7 + F.col("row") * 5 + col * 3) % 13 - 6) / F.lit(20.0)
        return F.when(F.col("name").rlike("[.]var_"), 1 + F.abs(plain)).when(F.col("name").endswith(".scale"), 1 + plain).otherwise(plain)

    return spread.select("name", "row", F.transform(F.sequence(F.lit(0), F.col("cols") - 1), value).alias("vec"))


@query("tower_embeddings")
def _(d: Demo):
    """Vectors and attention weights of all payees, from a store of given weights."""
    side, cfg = "kt", d.cfg
    index = f"{entity(side)}_index"
    sizes = {r["feature"]: r["max_index"] + 1 for r in indexing.feature_sizes(d.indexed(side), side).collect()}
    shape = (sizes, side, TOWER_WIDTH, cfg.embedding_width)
    store = d.stage(f"{side}_tower_store", lambda: stated_store(d, towers.store_shapes(*shape)))
    tower, weights = towers.read_tower(store, *shape)
    log_features = d.stage(
        f"{side}_log_features", lambda: indexing.feature_table(profiles.log_stats(d.indexed(side), side), side)
    )
    ids = retrieval.entity_ids("all", d.indexed(side), d.truth(side), index).toDF("id")
    vectors = {"emb": (_vectors(d, side).select(index, "embedding"), cfg.embedding_width)}
    found = towers.tower_embeddings(ids, log_features, weights, tower, side, TOWER_WIDTH, vectors)
    parts = [
        found.select("id", F.lit(name).alias("part"), F.posexplode(name).alias("place", "value")) for name in ("embedding", "weights")
    ]
    return parts[0].unionByName(parts[1]).withColumn("value", F.round("value", 4) + F.lit(0.0))


def _offline(side: str):
    """Truth entities of one side against all entities of the other by their external embeddings."""

    def build(d: Demo):
        truth = ranking.truth_rows(d.truth(side), side)

        def users() -> DataFrame:
            known = _vectors(d, side).select(F.col(f"{entity(side)}_index").alias("user"), "embedding")
            return ranking.restrict_users(known, truth.distinct())

        def items() -> DataFrame:
            return _vectors(d, other(side)).select(F.col(f"{entity(other(side))}_index").alias("item"), "embedding")

        found = offline.evaluate_offline(
            d.spark, d.scratch(f"offline_{side}"), users, items, truth, d.cfg.top_k, d.cfg.metrics_k,
            {"vectors": "external", "side": side, "folder": d.folder, "settings": asdict(d.cfg)},
        )
        return rounded(found, {"value": 9})

    return build


query("offline_evaluation")(_offline("dt"))
query("offline_evaluation_reverse")(_offline("kt"))


def _learned(side: str):
    """The whole chain: vectors learned on the training window, nearest partners, metrics on the test window."""

    def build(d: Demo):
        truth = ranking.truth_rows(d.truth(side), side)
        maps = _maps(d)

        @cache  # users and items come from one fit
        def factors() -> tuple[DataFrame, DataFrame]:
            counts = d.stage("pair_counts", lambda: learning.pair_counts(d.train(), maps["dt"], maps["kt"]))
            return learning.als_vectors(counts, side, d.cfg.als_rank, d.cfg.als_iterations, d.cfg.seed)

        return offline.evaluate_offline(
            d.spark, d.scratch(f"offline_als_{side}"), lambda: ranking.restrict_users(factors()[0], truth.distinct()),
            lambda: factors()[1], truth, d.cfg.top_k, d.cfg.metrics_k,
            {"vectors": "als", "side": side, "folder": d.folder, "settings": asdict(d.cfg)}, search="forest",
        )

    return build


query("offline_evaluation_als")(_learned("dt"))
query("offline_evaluation_als_reverse")(_learned("kt"))


@query("io_roundtrip")
def _(d: Demo):
    """Interactions written by month and read back by path and by name; saved topic models read back."""
    path = d.scratch("interactions_by_month")
    tables.write_table(d.train().withColumn("month", F.substring("short_dt", 1, 7)), path, "month")
    tables.scan(d.spark, path).createOrReplaceTempView("stored_interactions")
    named = tables.scan(d.spark, "stored_interactions")
    _topic_weights(d, "dt")
    model = LocalLDAModel.load(d.scratch("context_dt_lda_model"))
    counter = CountVectorizerModel.load(d.scratch("context_dt_cv_model"))
    by_month = named.groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("c_sum_fin").cast("double").alias("total")
    )
    return by_month.withColumns({"topics": F.lit(model.getK()), "words": F.lit(len(counter.vocabulary)).cast("bigint")})
