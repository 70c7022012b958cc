"""Payment-shaped views over the star-schema test tables, and the stages the queries share.

Customers are payers (`C<key>`), suppliers are payees (`S<key>`), line items are payments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paylattice.config import Settings
from paylattice.operators import indexing, interactions, profiles, ranking
from paylattice.session import freed_shuffles, stage_dir, tune

SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

DEMO = Settings(
    report_dt="2024-09-30",
    segments=SEGMENTS[:4],
    kinds=("company", "trader"),
    purpose="contract",
    train=("1995-01-01", "1998-12-31"),
    test=("1999-01-01", "2001-12-31"),
    words_since="1999-01-01",
    embedding_width=64,
)


class Demo:
    """Views and written stages of one test data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder.rstrip("/")
        self.cfg = DEMO

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # --- source views -------------------------------------------------------------

    def client_view(self) -> DataFrame:
        """Client snapshots: every client on the later date, three in four on the earlier one."""
        nations = self.table("nation")
        customers = self.table("customer").select(
            F.concat(F.lit("C"), F.col("c_custkey")).alias("inn"),
            F.col("c_custkey").alias("key"),
            F.col("c_nationkey").alias("nation"),
            F.col("c_acctbal").alias("balance"),
            F.col("c_mktsegment").alias("org_segment"),
        )
        names = F.array(*[F.lit(s) for s in SEGMENTS])
        suppliers = self.table("supplier").select(
            F.concat(F.lit("S"), F.col("s_suppkey")).alias("inn"),
            F.col("s_suppkey").alias("key"),
            F.col("s_nationkey").alias("nation"),
            F.col("s_acctbal").alias("balance"),
            F.get(names, (F.col("s_suppkey") % 5).cast("int")).alias("org_segment"),
        )
        key = F.col("key")
        parts = F.array(
            F.col("n_regionkey").cast("string"),
            F.col("n_nationkey").cast("string"),
            (key % 7).cast("string"),
            (key % 3).cast("string"),
            (key % 2).cast("string"),
        )
        depth = (key % 6).cast("int")
        kind = F.when(key % 10 == 9, "branch").when(key % 2 == 0, "company").otherwise("trader")
        base = customers.unionByName(suppliers).join(nations, F.col("nation") == F.col("n_nationkey"))
        dates = F.when(key % 4 == 0, F.array(F.lit("2024-09-30"))).otherwise(
            F.array(F.lit("2024-09-30"), F.lit("2024-06-30"))
        )
        return base.select(
            F.explode(dates).alias("report_dt"),
            "inn",
            "org_segment",
            kind.alias("type"),
            F.when(F.col("balance") < -900, 1).otherwise(0).alias("active_flg"),
            F.when(depth > 0, F.array_join(F.slice(parts, F.lit(1), depth), ".")).alias("okved_cd"),
            F.col("n_name").alias("okato_cd"),
        )

    def payments(self) -> DataFrame:
        return self._orders_with_lines().select(
            *_payment_columns(),
            F.when(F.col("l_returnflag") == "R", "other").otherwise("contract").alias("predicted_value_last"),
            _digits(9, (F.col("o_custkey"), 7919)).alias("c_bic_dt"),
            _digits(9, (F.col("l_suppkey"), 104729)).alias("c_bic_kt"),
            # no payer account on one order in eleven
            F.when(
                F.col("l_orderkey") % 11 != 0,
                _digits(20, (F.col("o_custkey"), 15485863), (F.col("l_orderkey") % 3 + 1, 32452843)),
            ).alias("c_num_dt"),
            _digits(20, (F.col("l_suppkey"), 49979687), (F.col("l_orderkey") % 2 + 1, 67867967)).alias("c_num_kt"),
        )

    def payment_words(self) -> DataFrame:
        """One row per payment and word; every seventh line has no normalised word."""
        parts = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
        return (
            self._orders_with_lines()
            .join(parts, "l_partkey")
            .select(
                F.col("l_orderkey").alias("id"),
                *_payment_columns(),
                F.lit("0.5").cast("decimal(3,2)").alias("sum_koef"),
                F.explode(F.split("p_name", " ")).alias("token"),
                F.col("l_linenumber").alias("line"),
            )
            .select(
                "id", "inn_dt", "inn_kt", "short_dt", "c_sum", "sum_koef",
                F.when(F.col("line") % 7 != 0, F.col("token")).alias("word"),
                F.col("token").alias("word_v2"),
            )
        )

    def document_words(self) -> DataFrame:
        """Words of whole texts, for a larger vocabulary: one row per document and word."""
        return (
            self.table("documents")
            .select(F.col("doc_id"), F.explode(F.split("text", "[ \\n\\t\\r]+")).alias("word_v2"))
            .filter(F.col("word_v2") != "")
        )

    def word_map(self) -> DataFrame:
        return (
            self.table("part")
            .select(F.explode(F.split("p_name", " ")).alias("word"), "p_type", "p_brand", "p_size")
            .groupBy("word", F.col("p_type").alias("cat1"), F.col("p_brand").alias("cat2"))
            .agg((F.min("p_size") % 5).cast("double").alias("map_weight"))
            .select("word", "map_weight", "cat1", "cat2")
        )

    def embeddings_wide(self) -> DataFrame:
        """One scalar column per component; each vector serves a payer and a payee, in two months."""
        width = self.cfg.embedding_width
        owner = F.explode(F.array(F.lit("C"), F.lit("S")))
        return (
            self.table("embeddings")
            .select(owner.alias("owner"), "vec_id", "embedding")
            .select(
                F.concat("owner", "vec_id").alias("inn"),
                *[F.get("embedding", F.lit(i)).alias(f"embed_{i}") for i in range(width)],
                F.explode(F.array(F.lit("2024-11-30"), F.lit("2024-12-31"))).alias("mon"),
            )
        )

    def query_vectors(self) -> DataFrame:
        return self.table("embeddings").filter("vec_id % 5 = 0").select(F.col("vec_id").alias("user"), "embedding")

    def catalogue_vectors(self) -> DataFrame:
        return self.table("embeddings").filter("vec_id % 5 <> 0").select(F.col("vec_id").alias("item"), "embedding")

    def requests(self) -> DataFrame:
        """Payers somebody asked recommendations for; one in four is unknown to the pipeline."""
        key = F.col("c_custkey")
        return self.table("customer").select(
            F.concat(F.when(key % 4 == 0, "X").otherwise("C"), key).alias("inn_dt"),
            F.col("c_name").alias("client_name"),
        )

    def quality_scores(self) -> DataFrame:
        """Labelled scores with many ties, for the pointwise metrics."""
        return (
            self.table("labels")
            .join(self.table("documents").select("doc_id", "n_chars"), "doc_id")
            .select(
                "doc_id",
                F.col("quality").cast("double").alias("label"),
                ((F.col("n_chars") % 97 - 48) / 16.0 + F.col("quality") * 0.75).alias("logit"),
            )
        )

    def _orders_with_lines(self) -> DataFrame:
        lines = self.table("lineitem")
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
        return lines.join(orders, "l_orderkey")

    # --- written stages -------------------------------------------------------------

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Write a shared table once per application and data folder, then read it back.

        A written table survives lost executors and gives Catalyst true sizes.
        """
        path = self.scratch(name)
        if path not in _written:
            rows = build()
            with freed_shuffles(self.spark):
                rows.write.mode("overwrite").parquet(path)
            _written.add(path)
        return self.spark.read.parquet(path)

    def scratch(self, name: str) -> str:
        folder = hashlib.md5(self.folder.encode()).hexdigest()[:12]
        return f"{stage_dir(self.spark)}/{folder}/{name}"

    def clients(self) -> DataFrame:
        return self.stage("clients", self.client_view)

    def train(self) -> DataFrame:
        return self.stage("train_interactions", lambda: self.live_interactions(self.cfg.train))

    def test(self) -> DataFrame:
        return self.stage("test_interactions", lambda: self.live_interactions(self.cfg.test))

    def live_interactions(self, window: tuple[str, str]) -> DataFrame:
        return interactions.build_interactions(self.payments(), self.clients(), self.cfg, window)

    def passport(self, side: str) -> DataFrame:
        return self.stage(f"{side}_pass", lambda: profiles.passport(self.train(), side))

    def labels(self, side: str) -> DataFrame:
        return self.stage(f"{side}_labels", lambda: indexing.label_table(self.passport(side), side))

    def indexed(self, side: str) -> DataFrame:
        return self.stage(
            f"{side}_pass_indexed", lambda: indexing.indexed_passport(self.passport(side), self.labels(side), side)
        )

    def truth(self, side: str) -> DataFrame:
        return self.stage(
            f"{side}_truth",
            lambda: ranking.truth_sets(
                self.test(), self.indexed("dt"), self.indexed("kt"), side, self.cfg.min_test_rows
            ),
        )


_written: set[str] = set()


def _payment_columns() -> list[Column]:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    paid = price * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return [
        F.concat(F.lit("C"), F.col("o_custkey")).alias("inn_dt"),
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("inn_kt"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("short_dt"),
        F.round(paid, 2).cast("decimal(14,2)").alias("c_sum"),
    ]


def _digits(width: int, *factors: tuple[Column, int]) -> Column:
    """Digit string of fixed width from keys multiplied by primes."""
    each = width // len(factors)
    return F.concat(*[F.lpad(((key + 1) * prime % 10**each).cast("string"), each, "0") for key, prime in factors])
