"""Statistics and passports: one row per payer or payee."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylattice.config import (
    CODE_DEPTH,
    LEVEL_FILL,
    SIDES,
    SKEWNESS_FILL,
    STDDEV_FILL,
    category_columns,
    entity,
    large_stats,
    numeric_features,
    other,
)

AMOUNT = "c_sum_fin"


def with_code_levels(df: DataFrame, sides: tuple[str, ...] = SIDES) -> DataFrame:
    """Split dotted industry codes into four level columns; a level past the depth is '-1'."""
    return df.select(
        "*",
        *[
            F.coalesce(F.get(F.split(f"okved_cd_{s}", r"\."), F.lit(i)), F.lit(LEVEL_FILL)).alias(
                f"okved_cd_{s}_lvl{i + 1}"
            )
            for s in sides
            for i in range(CODE_DEPTH)
        ],
    )


def _amount_stats(side: str) -> list[Column]:
    amount = F.col(AMOUNT).cast("double")
    # the mean comes from the exact decimal total, so it does not depend on the summing order
    return [
        (F.sum(AMOUNT).cast("double") / F.count(AMOUNT)).alias(f"{side}_avg_sum"),
        F.coalesce(F.stddev(amount), F.lit(STDDEV_FILL)).alias(f"{side}_stddev_sum"),
        F.min(amount).alias(f"{side}_min_sum"),
        F.max(amount).alias(f"{side}_max_sum"),
        F.percentile_approx(amount, 0.5).alias(f"{side}_median_sum"),
        F.coalesce(F.skewness(amount), F.lit(SKEWNESS_FILL)).alias(f"{side}_skewness_sum"),
    ]


def partner_counts(interactions: DataFrame, side: str) -> DataFrame:
    """Distinct partners per entity.

    Kept apart from the amount statistics: in one aggregate, Spark would hold a percentile
    digest for every (entity, partner) pair.
    """
    own, partner = entity(side), entity(other(side))
    return (
        interactions.groupBy(own, partner)
        .agg(F.lit(1).alias("one"))
        .groupBy(own)
        .agg(F.count(partner).alias(f"{side}_buyers_count"))
    )


def _with_partners(profile: DataFrame, interactions: DataFrame, side: str, columns: list[str]) -> DataFrame:
    # both inputs come out of an aggregate on the entity, so the join adds no shuffle
    return profile.join(partner_counts(interactions, side), entity(side)).select(entity(side), *columns)


def entity_stats(interactions: DataFrame, side: str) -> DataFrame:
    """Seven numbers per entity: six over the amounts of its interactions, and its partner count."""
    stats = interactions.groupBy(entity(side)).agg(*_amount_stats(side))
    return _with_partners(stats, interactions, side, numeric_features(side))


def log_stats(stats: DataFrame, side: str) -> DataFrame:
    """log(1 + x) of the six large-scale numbers; skewness stays as it is."""
    large = set(large_stats(side))
    return stats.select(*[F.log1p(c).alias(c) if c in large else F.col(c) for c in stats.columns])


def _earliest(column: str) -> Column:
    """The non-null value of the earliest day, the lowest one if that day has several."""
    known = F.when(F.col(column).isNotNull(), F.struct("short_dt", column))
    return F.min(known).getField(column).alias(column)


def passport(interactions: DataFrame, side: str) -> DataFrame:
    """Twelve categories and seven statistics per entity, from one aggregate on the entity."""
    levelled = with_code_levels(interactions, (side,))
    profile = levelled.groupBy(entity(side)).agg(
        *[_earliest(c) for c in category_columns(side)],
        *_amount_stats(side),
    )
    return _with_partners(profile, interactions, side, [*category_columns(side), *numeric_features(side)])


def entity_entropy(interactions: DataFrame, side: str) -> DataFrame:
    """Entropy of the amounts an entity exchanges with its partners, plain and divided by ln(partners).

    With T the total and x the pair sums, -sum(p ln p) = ln T - sum(x ln x) / T: one pass, no join back.
    """
    own, partner = entity(side), entity(other(side))
    pairs = interactions.groupBy(own, partner).agg(F.sum(AMOUNT).cast("double").alias("x")).filter(F.col("x") > 0)
    sums = pairs.groupBy(own).agg(
        F.sum("x").alias("total"),
        F.sum(F.col("x") * F.ln("x")).alias("x_ln_x"),
        F.count(F.lit(1)).alias("partners"),
    )
    entropy = F.when(F.col("partners") == 1, F.lit(0.0)).otherwise(
        F.greatest(F.ln("total") - F.col("x_ln_x") / F.col("total"), F.lit(0.0))
    )
    return sums.select(own, "partners", entropy.alias(f"{side}_entropy")).withColumn(
        f"{side}_normalized_entropy",
        F.when(F.col("partners") == 1, F.lit(0.0)).otherwise(F.col(f"{side}_entropy") / F.ln("partners")),
    )


def partner_count_buckets(stats: DataFrame, side: str, buckets: int = 10) -> DataFrame:
    """Quantile bucket of the partner count; boundaries that coincide are merged."""
    count = f"{side}_buyers_count"
    shares = [i / buckets for i in range(1, buckets)]
    # at most buckets-1 numbers come to the driver
    found = stats.agg(F.percentile_approx(count, shares, 10_000)).first()[0] or []
    bucket = F.lit(0)
    for bound in sorted(set(found)):
        bucket = bucket + (F.col(count) >= bound).cast("int")
    return stats.select(entity(side), count, bucket.alias(f"{count}_index"))


def asinh_weights(interactions: DataFrame) -> DataFrame:
    """Payment weight that grows like a logarithm for large amounts."""
    return interactions.select(
        "inn_dt", "inn_kt", "short_dt", AMOUNT, F.asinh(F.col(AMOUNT).cast("double")).alias("weight")
    )


def extended_passport(passport: DataFrame, entropy: DataFrame, buckets: DataFrame, side: str) -> DataFrame:
    """Passport with the entropy of the entity's partners and the bucket of their number; 0 where unknown.

    All three tables hold an entity once, so no key is frequent.
    """
    own = entity(side)
    extra = {f"{side}_entropy": 0.0, f"{side}_normalized_entropy": 0.0, f"{side}_buyers_count_index": 0}
    joined = passport.join(entropy.select(own, f"{side}_entropy", f"{side}_normalized_entropy"), own, "left").join(
        buckets.select(own, f"{side}_buyers_count_index"), own, "left"
    )
    return joined.na.fill(extra)
