"""Mixing sources to target weights as a minimum-cost flow.

A document belongs to one or more sources. Documents are added up by membership pattern; a pattern offers
its words once for free, a second time at a cost, a third time at a higher one (convex). The flow routes
this capacity to the quotas of the sources at least cost. The part of a pattern that is used once more
than the rest is made of whole documents in seeded order: a prefix of the order, then further documents
that still fit the gap, in a few rounds.

Patterns, sources and targets are tables of any size. A source that no document shares with another one needs
no routing, only arithmetic; sources that share documents, directly or over others, form a group, and each group's
flow is solved in a task of its own. A pattern that holds most of the documents is sorted and summed across all tasks.

Null text has size 0. A null source is a source of its own, ordered last. Rows equal in id, sources and
text are taken together. Documents without words and an empty table are fine: they take nothing.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylattice.functions.columns import draw
from paylattice.llm.common import cut, fresh, ship_package, words
from paylattice.llm.components import connected_components
from paylattice.plans.ordering import with_position, with_prefix

BROADCAST_PATTERNS = 50_000  # recipes of more rows are joined by key
# Cost of using a pattern's words for the first, second and third time. Fixed values.
COPY_COSTS = (0, 1, 4)
# Passes that fill the gap which the seeded prefix leaves.
_ROUNDS = 4


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], total: float, most: float = 3) -> DataFrame:
    """Add number (place in order of code points, null last) and target to rows of source and size.

    The sources have the given weights in turn and get their shares of `total` by weight, none above `most`
    times its size; the excess goes to the others by weight. Sources reach their cap in order of size over
    weight, so two running sums give the level at which the rest is shared.
    """
    numbered = with_position(sources, [F.col("source").isNull(), "source"], "number")
    turn = (F.col("number") % len(weights) + 1).cast("int")
    weighed = numbered.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
    ratio = F.when(F.col("weight") > 0, F.col("size") / F.col("weight")).otherwise(F.lit(float("inf")))
    ranked = cut(
        with_prefix(
            weighed.withColumn("ratio", ratio), ["ratio", "number"],
            {"full": F.col("size"), "used": F.col("weight")},
        )
    )
    all_weights = float(ranked.agg(F.sum("weight")).first()[0] or 0)
    each = F.try_divide(F.lit(float(total)) - most * F.col("full"), F.lit(all_weights) - F.col("used"))
    level = ranked.filter(each <= most * F.col("ratio")).agg(F.max(each)).first()[0]
    share = F.col("weight") * F.lit(float("inf") if level is None else level)
    target = F.when(F.col("weight") > 0, F.least(share, (most * F.col("size")).cast("double"))).otherwise(0.0)
    return ranked.select("source", "size", "number", target.alias("target"))


def route(patterns: list[tuple[tuple, int]], quotas: dict, costs: tuple[int, ...] = COPY_COSTS) -> list[dict]:
    """Words that each pattern gives to each of its sources, by successive cheapest paths.

    `patterns` holds (sources, words); `quotas` whole numbers. Every source gets its quota as far as its
    patterns can give it, and the sum of repetition costs is the least possible.
    """
    names = list(quotas)
    n = len(patterns) + len(names) + 2
    start, end = n - 2, n - 1
    graph: list[list[list]] = [[] for _ in range(n)]  # to, capacity, cost, place of the reverse edge

    def edge(a: int, b: int, capacity: int, cost: int) -> None:
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    place = {s: len(patterns) + i for i, s in enumerate(names)}
    for p, (members, size) in enumerate(patterns):
        for cost in costs:
            edge(start, p, size, cost)
        for s in members:
            edge(p, place[s], size * len(costs), 0)
    for s in names:
        edge(place[s], end, quotas[s], 0)

    potential = [0] * n
    while True:
        far: list[float] = [float("inf")] * n
        came: list[tuple[int, list] | None] = [None] * n
        far[start] = 0
        heap = [(0, start)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for e in graph[a]:
                if e[1] > 0 and d + e[2] + potential[a] - potential[e[0]] < far[e[0]]:
                    far[e[0]] = d + e[2] + potential[a] - potential[e[0]]
                    came[e[0]] = (a, e)
                    heapq.heappush(heap, (far[e[0]], e[0]))
        if came[end] is None:
            break
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far)]
        path, b = [], end
        while b != start:
            a, e = came[b]
            path.append(e)
            b = a
        pushed = min(e[1] for e in path)
        for e in path:
            e[1] -= pushed
            graph[e[0]][e[3]][1] += pushed
    given = []
    for p, (members, size) in enumerate(patterns):
        flows = {}
        for e in graph[p]:
            if e[0] != start and len(patterns) <= e[0] < n - 2:
                flows[names[e[0] - len(patterns)]] = size * len(costs) - e[1]
        given.append(flows)
    return given


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float | None = None, seed: int = 11,
    most: int = 3, sources: Column | None = None, text: str = "text", out: str = "mix",
) -> DataFrame:
    """All rows of `docs` with a struct column `out`: size, source_size, target, copies and taken.

    A column of that name is replaced.

    Sources in order of code points (null last) have the given weights in turn. `sources` is an array of
    the sources of a document, by default the one in column `source`. For documents of several sources
    `source_size` and `target` are those of the first. `total` defaults to the words of all documents.
    """
    unit, size, pattern, share = fresh(docs, "unit", "size", "pattern", "share")
    members = F.array(F.col("source").cast("string")) if sources is None else F.array_sort(F.array_distinct(F.coalesce(sources, F.array())))
    keyed = docs.withColumns({
        unit: F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.lit(seed), F.col(text)).alias("h")),
        size: word_count(F.col(text)),
        pattern: members,
    })
    units = cut(
        keyed.groupBy(unit, pattern).agg(F.sum(size).alias("size")).select(
            unit, pattern, "size", draw(seed, F.to_json(unit)).alias("u")
        )
    )
    plan = cut(_recipe(units, pattern, weights, total, most))
    small = plan.count() <= BROADCAST_PATTERNS
    offered = units.join(F.broadcast(plan) if small else plan, pattern, "left").fillna(
        {"base": 0, "extra": 0, "source_size": 0, "target": 0.0}
    )
    chosen = _select(offered, pattern, unit, small)
    placed = chosen.select(
        F.col(unit).alias("_u"), F.col(pattern).alias("_p"), F.struct("copies", "source_size", "target").alias(share)
    )
    of = F.col(share)
    result = F.struct(
        F.col(size).alias("size"), of["source_size"].alias("source_size"), of["target"].alias("target"),
        of["copies"].alias("copies"), (F.col(size) * of["copies"]).alias("taken"),
    )
    joined = keyed.join(placed, (keyed[unit] == placed["_u"]) & (keyed[pattern] == placed["_p"]))
    return joined.select(*[keyed[c] for c in docs.columns if c.lower() != out.lower()], result.alias(out))


def _recipe(units: DataFrame, pattern: str, weights: tuple[float, ...], total: float | None, most: int) -> DataFrame:
    """How often the words of each pattern are used (base), of how many words once more (extra), and the size
    and target of its first source."""
    ship_package(units.sparkSession)
    costs = COPY_COSTS[:most]
    patterns = cut(units.groupBy(pattern).agg(F.sum("size").alias("words")))
    if total is None:
        total = patterns.agg(F.sum("words")).first()[0] or 0
    members = patterns.select(pattern, "words", F.explode(pattern).alias("member"))
    sizes = members.groupBy(F.col("member").alias("source")).agg(F.sum("words").alias("size"))
    sources = cut(source_targets(sizes, weights, total, most))
    quotas = cut(
        members.join(sources, F.col("member").eqNullSafe(F.col("source")))
        .withColumn("quota", F.bround("target").cast("long"))
        .groupBy(pattern, "words")
        .agg(F.sort_array(F.collect_list(F.struct("number", "quota", "size", "target"))).alias("of"))
    )
    shared = quotas.filter(F.size("of") > 1)
    edges = shared.select(F.col("of")[0]["number"].alias("a"), F.explode("of.number").alias("b"))
    groups = connected_components(edges.filter("a <> b"))
    grouped = quotas.join(groups, F.col("of")[0]["number"] == F.col("node"), "left")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        listed = sorted(
            ((tuple(map(int, n)), int(w), q, p) for n, w, q, p in zip(rows["numbers"], rows["words"], rows["quotas"], rows["p"])),
            key=lambda x: x[0],
        )
        wanted = {n: int(q) for numbers, _, each, _ in listed for n, q in zip(numbers, each)}
        flows = route([(numbers, w) for numbers, w, _, _ in listed], dict(sorted(wanted.items())), costs)
        return pd.DataFrame({"p": [p for *_, p in listed], "used": [sum(f.values()) for f in flows]})

    routed = (
        grouped.filter("component is not null")
        .select("component", F.col(pattern).alias("p"), "words", F.col("of.number").alias("numbers"), F.col("of.quota").alias("quotas"))
        .groupBy("component").applyInPandas(solve, "p array<string>, used long")
    )
    alone = grouped.filter("component is null").select(
        F.col(pattern).alias("p"), F.least(F.col("of")[0]["quota"], F.col("words") * len(costs)).alias("used")
    )
    first, n = F.col("of")[0], F.col("words")
    return quotas.join(routed.unionByName(alone), F.col(pattern) == F.col("p")).select(
        pattern,
        F.when(n > 0, F.expr("used div words")).otherwise(0).cast("long").alias("base"),
        F.when(n > 0, F.col("used") % n).otherwise(0).cast("long").alias("extra"),
        first["size"].alias("source_size"), first["target"].alias("target"),
    )


def _select(units: DataFrame, pattern: str, unit: str, small: bool) -> DataFrame:
    """Add `copies`: the base of the pattern, and one more for units that together have `extra` words."""
    per_pattern = F.broadcast if small else (lambda df: df)
    left = units.withColumn("more", F.lit(False))
    for _ in range(_ROUNDS):
        # `extra` is what is still missing; units larger than that cannot help
        able = ~F.col("more") & (F.col("size") <= F.col("extra")) & (F.col("size") > 0)
        summed = cut(
            with_prefix(
                left.withColumn("able", able), [pattern, F.col("able").desc(), "u", unit],
                {"before": F.when(F.col("able"), F.col("size")).otherwise(0)},
            )
        )
        starts = summed.groupBy(pattern).agg(F.min("before").alias("start"))
        picked = summed.join(per_pattern(starts), pattern).withColumn(
            "pick", F.col("able") & (F.col("before") - F.col("start") + F.col("size") <= F.col("extra"))
        )
        gained = picked.filter("pick").groupBy(pattern).agg(F.sum("size").alias("gained"))
        left = cut(
            picked.join(per_pattern(gained), pattern, "left")
            .withColumn("more", F.col("more") | F.col("pick"))
            .withColumn("extra", F.col("extra") - F.coalesce("gained", F.lit(0)))
            .drop("able", "before", "start", "pick", "gained")
        )
    return left.withColumn("copies", F.col("base") + F.col("more").cast("long"))
