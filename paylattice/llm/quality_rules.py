"""Quality rules whose cutoffs carry a proven limit on false rejection.

Each rule rejects a document when one of its shares (symbols, repeated words, ...) is above a cutoff.
The cutoffs of all rules form one sequence of vectors from lenient to strict, each a step of one rule
beyond the one before. Per stratum, a holdout of labelled good documents tests the vectors in that order:
a vector is accepted while an exact binomial test rejects "all rules together lose `limit` or more of the
good documents". Testing in a fixed order and stopping at the first failure needs no correction for the
number of vectors; the level is divided by the strata and their pool (Bonferroni), so with confidence
1 - delta no stratum tested on its own labels loses more than `limit` of its good documents.

A stratum with too few labels to prove the limit even without a loss gets the cutoffs proven on the good
documents of all strata together, as far as its own labelled good documents lose no more than `limit`.
That bounds the loss of the pool, not of the stratum, and is marked in the column `pooled`. When the pool
is too small as well, only the base rules judge.

Only DataFrame functions are used. Null text counts as empty. A null stratum is a stratum. A document with
several labels is good only if all say so. Repeated rows are judged alike, an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paylattice.llm.common import count_of, cut, fresh, let, words

# Rule shares and their candidate cutoffs from lenient to strict. Fixed values.
GRID = {
    "symbol_share": (0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03),
    "repeat_share": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
    "line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "upper_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "shout_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15),
}
SYMBOLS = "#*$%&|<>"


def measures(text: Column) -> Column:
    """Struct of all counts of one text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda s: F.struct(
            *[s["w"][c].alias(c) for c in ("n_words", "word_chars", "n_repeat_words")],
            *[s["l"][c].alias(c) for c in ("n_lines", "n_dup_lines")],
            count_of(text, SYMBOLS).alias("n_symbols"),
            F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
            count_of(text, "!").alias("n_shouts"),
        ),
    )


def _repeated_words(w: Column) -> Column:
    """Words that lie in a three-word window found more than once in the text."""

    def windows(hashes: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(
                F.get(hashes, i).alias("h"), F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"),
                F.get(w, i + 2).alias("c"), i.alias("i"),
            ),
        )

    def same(x: Column, y: Column) -> Column:
        equal = (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        return F.coalesce(equal, F.lit(False))

    def covered(ordered: Column) -> Column:
        # equal windows are neighbours in the sorted array
        found = F.filter(
            ordered, lambda x, j: same(x, F.get(ordered, j - 1)) | same(x, F.get(ordered, j + 1))
        )
        starts = F.sort_array(F.transform(found, lambda x: x["i"]))
        begin = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-3).alias("last"))
        return F.aggregate(
            starts,
            begin,
            lambda acc, p: F.struct(
                (acc["total"] + F.least(F.lit(3), p - acc["last"])).alias("total"), p.alias("last")
            ),
            lambda acc: acc["total"],
        )

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    zero = F.lit(0).cast("long")
    # different hashes prove different windows; only texts with equal ones pay for the sort
    looked = let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(
            let(F.sort_array(windows(h)), covered)
        ),
    )
    return F.when(F.size(w) < 4, zero).otherwise(looked)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def shares(m: Column) -> dict[str, Column]:
    def share(part: str, whole: str) -> Column:
        return m[part] / F.greatest(m[whole], F.lit(1))

    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "line_share": share("n_dup_lines", "n_lines"),
        "upper_share": share("n_upper", "word_chars"),
        "shout_share": share("n_shouts", "n_words"),
    }


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """Exact P(X <= k) for X ~ Binomial(n, rate), summed from logarithms; 1 where k is above its mean.

    Above the mean the test cannot succeed, so those sums are not worked out.
    """
    odds = math.log(rate) - math.log1p(-rate)
    first = n * math.log1p(-rate)
    begin = F.struct(first.alias("log"), F.exp(first).alias("sum"))

    def add(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i + 1) / i) + odds
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k > n * rate, F.lit(1.0)).otherwise(F.aggregate(steps, begin, add, lambda acc: acc["sum"]))


def sequence() -> list[tuple[str, float]]:
    """Rule and cutoff of every step, all rules going from lenient to strict at the same pace."""
    steps = [(i / (len(cs) - 1), r, rule, c) for r, (rule, cs) in enumerate(GRID.items()) for i, c in enumerate(cs)]
    return [(rule, c) for _, _, rule, c in sorted(steps)]


def calibrate(
    measured: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = 0.05, delta: float = 0.05
) -> DataFrame:
    """Cutoffs per stratum: columns stratum, one per rule (null: the rule is not used there), and pooled.

    `measured` has doc_id, the stratum and the struct `m`. `limit` bounds the share of good documents
    that a stratum loses to all rules together, `delta` the chance that this fails anywhere.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    holdout = measured.select("doc_id", F.col(stratum).alias("stratum"), "m").filter(~base_failed(F.col("m")))
    steps = sequence()
    rate = shares(F.col("m"))
    lost_at = F.least(*[F.when(rate[rule] > c, F.lit(t)) for t, (rule, c) in enumerate(steps)])
    lost = [f"k_{t}" for t in range(len(steps))]
    counted = cut(
        holdout.join(good, "doc_id")
        .select("stratum", lost_at.alias("lost_at"))
        .groupBy("stratum")
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("lost_at") <= t).alias(k) for t, k in enumerate(lost)])
    )
    # one row of counts to the driver
    pool = counted.agg(F.count(F.lit(1)).alias("strata"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", *lost)]).first()
    level = delta / (pool["strata"] + 1)
    every = measured.select(F.col(stratum).alias("any")).distinct()
    strata = every.join(counted, F.col("any").eqNullSafe(F.col("stratum")), "left")
    rows = F.array(*[
        F.struct(
            F.lit(t).alias("t"), F.lit(rule).alias("rule"), F.lit(c).alias("c"), F.coalesce(k, F.lit(0)).alias("k"),
            F.lit(pool[k]).cast("long").alias("k_pool"),
        )
        for t, ((rule, c), k) in enumerate(zip(steps, lost))
    ])
    n = F.coalesce("n", F.lit(0))
    pooled = n * math.log1p(-limit) > math.log(level)
    one = strata.select(F.col("any").alias("stratum"), n.alias("n"), pooled.alias("pooled"), F.explode(rows).alias("s"))
    one = one.select("stratum", "n", "pooled", "s.*")
    in_pool = binomial_tail(F.col("k_pool"), F.lit(pool["n"]).cast("long"), limit) > level
    fails = F.when(F.col("pooled"), in_pool | (F.col("k") > limit * F.col("n"))).otherwise(
        binomial_tail(F.col("k"), F.col("n"), limit) > level
    )
    so_far = Window.partitionBy("stratum").orderBy("t")
    accepted = one.withColumn("failed", fails.cast("int")).withColumn("failed", F.max("failed").over(so_far)).filter("failed = 0")
    return accepted.groupBy("stratum").agg(
        *[F.min(F.when(F.col("rule") == r, F.col("c"))).alias(r) for r in GRID], F.first("pooled").alias("pooled")
    )


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang", m: str = "m") -> DataFrame:
    """Add `kept`: passes the base rules and every cutoff of its stratum. All rows and columns stay."""
    key, *rules = fresh(measured, "stratum", *GRID)
    limits = cut(cutoffs).select(F.col("stratum").alias(key), *[F.col(r).alias(n) for r, n in zip(GRID, rules)])
    rate = shares(F.col(m))
    rejected = F.lit(False)
    for rule, name in zip(GRID, rules):
        rejected = rejected | F.coalesce(rate[rule] > F.col(name), F.lit(False))
    joined = measured.join(limits, measured[stratum].eqNullSafe(limits[key]), "left")
    return joined.withColumn("kept", ~base_failed(F.col(m)) & ~rejected).drop(key, *rules)


def quality_verdicts(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, stratum, counts in `m` and `kept` of every document, from one pass over the texts."""
    stratum = options.get("stratum", "lang")
    measured = cut(docs.select("doc_id", stratum, measures(F.col("text")).alias("m")))
    return judge(measured, calibrate(measured, labels, **options), stratum)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass, with their own columns only.

    Texts are measured once and written beside their counts: counting costs far more than a copy.
    """
    row = F.struct(*docs.columns).alias("doc")
    stratum = F.col(options.pop("stratum", "lang")).alias("stratum")
    beside = docs.select(row, "doc_id", stratum, measures(F.col("text")).alias("m"))
    # texts are large, and a writer and a reader hold a row group in memory
    measured = cut(beside, "measured", **{"parquet.block.size": 16 << 20})
    counts = measured.select("doc_id", "stratum", "m")
    cutoffs = calibrate(counts, labels, stratum="stratum", **options)
    return judge(measured, cutoffs, "stratum").filter("kept").select("doc.*")
