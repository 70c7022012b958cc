"""Label indexing: dense integer ids for entity ids and categories, checks of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylattice.config import entity, index_features, indexed_columns, numeric_features
from paylattice.plans.ordering import with_position
from paylattice.plans.skew import join_on_key

# A label list up to this many rows is broadcast (labels are short codes, so some tens of MB).
BROADCAST_LABELS = 500_000


def label_table(passport: DataFrame, side: str) -> DataFrame:
    """`(column, label, index)`: per column, labels by falling frequency, then by label, from 0.

    Gives the indices StringIndexer would give, without a list of all labels on the driver:
    all 13 columns are counted in one aggregate and numbered in one distributed sort.
    """
    columns = indexed_columns(side)
    counts = (
        passport.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("label")) for c in columns])).alias("l"))
        .select("l.column", "l.label")
        .filter(F.col("label").isNotNull())
        .groupBy("column", "label")
        .agg(F.count(F.lit(1)).alias("frequency"))
    )
    placed = with_position(counts, ["column", F.desc("frequency"), "label"])
    first = placed.groupBy("column").agg(F.min("position").alias("first"))  # one row per column
    return placed.join(F.broadcast(first), "column").select(
        "column", "label", (F.col("position") - F.col("first")).cast("int").alias("index"), "frequency"
    )


def label_map(labels: DataFrame, side: str) -> DataFrame:
    """Entity id to index."""
    return labels.filter(F.col("column") == entity(side)).select(
        F.col("label").alias(entity(side)), F.col("index").alias(f"{entity(side)}_index")
    )


def label_counts(labels: DataFrame) -> dict[str, int]:
    """Number of labels per column: at most one small row per column reaches the driver."""
    return {r["column"]: r["n"] for r in labels.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}


def indexed_passport(passport: DataFrame, labels: DataFrame, side: str) -> DataFrame:
    """Entity id, seven numbers and 13 indices; unknown and null labels get the number of labels.

    Category lists are short and counted before they are broadcast; the entity list (and any
    category that turns out long) is joined by key instead.
    """
    sizes = label_counts(labels)
    result = passport
    for column in indexed_columns(side):
        lookup = labels.filter(F.col("column") == column).select(
            F.col("label").alias(column), F.col("index").alias("_index")
        )
        size = sizes.get(column, 0)
        if size <= BROADCAST_LABELS:
            result = result.join(F.broadcast(lookup), column, "left")
        elif column == entity(side):
            result = result.join(lookup, column, "left")  # one row per entity: no frequent key
        else:
            result = join_on_key(result, lookup, column, "left")
        result = result.withColumn(f"{column}_index", F.coalesce("_index", F.lit(size))).drop("_index")
    return result.select(entity(side), *numeric_features(side), *index_features(side))


def feature_table(indexed: DataFrame, side: str) -> DataFrame:
    """Feature rows keyed by the entity index, the form that pairs and towers look up."""
    return indexed.select(*index_features(side), *numeric_features(side))


def feature_sizes(indexed: DataFrame, side: str) -> DataFrame:
    """Distinct values and largest value of every index column, in one aggregate."""
    values = indexed.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in index_features(side)])
        ).alias("f")
    ).select("f.feature", "f.value")
    return (
        values.groupBy("feature", "value")
        .agg(F.lit(1).alias("one"))
        .groupBy("feature")
        .agg(F.count("value").alias("size"), F.max("value").alias("max_index"))
    )


def feature_size_check(indexed: DataFrame, sizes: DataFrame, expected: list[str], side: str) -> DataFrame:
    """Violations: features missing in the sizes, features nobody expects, sizes too small for the data.

    `sizes` has one row per feature; the expected names come from the configuration.
    """
    spark = indexed.sparkSession
    wanted = spark.createDataFrame([(name,) for name in expected], "feature string")
    known = sizes.select("feature", "size")
    observed = feature_sizes(indexed, side).select("feature", F.col("max_index").alias("observed"))
    missing = wanted.join(known, "feature", "left_anti").select(
        "feature", F.lit("missing").alias("problem"), F.lit(None).cast("int").alias("max_index"),
        F.lit(None).cast("bigint").alias("size"),
    )
    extra = known.join(wanted, "feature", "left_anti").select(
        "feature", F.lit("extra").alias("problem"), F.lit(None).cast("int").alias("max_index"), "size"
    )
    small = (
        known.join(wanted, "feature", "left_semi")
        .join(observed, "feature")
        .filter(F.col("observed") >= F.col("size"))
        .select("feature", F.lit("too small").alias("problem"), F.col("observed").alias("max_index"), "size")
    )
    return missing.unionByName(extra).unionByName(small)


def require_valid_features(indexed: DataFrame, sizes: DataFrame, expected: list[str], side: str) -> None:
    """Raise when the check finds anything (there are at most a few rows per feature)."""
    rows = feature_size_check(indexed, sizes, expected, side).collect()
    if rows:
        raise ValueError("; ".join(f"{r['feature']}: {r['problem']}" for r in sorted(rows)))
