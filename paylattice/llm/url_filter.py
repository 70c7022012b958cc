"""URL block and allow lists as a trie over reversed host labels and then path segments.

The longest matching rule wins: more host labels first, then the longer path. A rule's path is a prefix
of the url's path; its last segment may be cut short (`/en` fits `/english`), which `/en/` does not allow.
Lists up to `broadcast_rows` rules of at most `broadcast_bytes` together are sent to the executors as a
trie; larger ones are joined on every host suffix of the url, which gives the same rows.

Null urls and urls without `://` have empty host and path and match nothing. No rule: allowed. Two rules
with one host and path: block wins. Rows, also repeated ones, are judged one by one.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylattice.llm.common import fresh, ship_package

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class Trie:
    """Nodes are dicts; host labels are keys of the host level, path segments of the level below it."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {"next": {}, "paths": None}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"next": {}, "ends": {}}
            *whole, last = path.split("/")
            step = node["paths"]
            for segment in whole:
                step = step["next"].setdefault(segment, {"next": {}, "ends": {}})
            if step["ends"].get(last, ("allow",))[0] != "block":
                step["ends"][last] = (verdict, host + path)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and rule of the longest match."""
        found, node = None, self.root
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                break
            if node["paths"] is not None:
                found = self._in_path(node["paths"], path) or found
        return found

    @staticmethod
    def _in_path(step: dict, path: str) -> tuple[str, str] | None:
        found = None
        segments = path.split("/")
        for i, segment in enumerate(segments):
            for n in range(len(segment) + 1):  # a last rule segment may be cut short
                found = step["ends"].get(segment[:n], found) if step["ends"] else found
            step = step["next"].get(segment) if i + 1 < len(segments) else None
            if step is None:
                break
        return found


def filter_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """`pages` with a struct column `url_filter`: host, path, rule (null: none fits) and verdict.

    `rules` has the columns verdict (block or allow), host and path; nulls among them are left out.
    """
    rules = rules.select("verdict", F.translate("host", _UPPER, _UPPER.lower()).alias("host"), "path").dropna()
    size = rules.agg(F.count(F.lit(1)), F.sum(F.length("host") + F.length("path") + 40)).first()
    if size[0] <= broadcast_rows and (size[1] or 0) <= broadcast_bytes:
        return _by_trie(pages, [tuple(r) for r in rules.distinct().collect()], url)
    return _by_join(pages, rules, url)


def _by_trie(pages: DataFrame, rules: list[tuple[str, str, str]], url: str) -> DataFrame:
    spark = pages.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(Trie(rules))

    @F.arrow_udf("struct<rule:string, verdict:string>")
    def look_up(host: pa.Array, path: pa.Array) -> pa.Array:
        trie = shared.value
        found = [trie.find(h, p) for h, p in zip(host.to_pylist(), path.to_pylist())]
        return pa.array(
            [{"rule": f[1], "verdict": f[0]} if f else {"rule": None, "verdict": "allow"} for f in found],
            pa.struct([("rule", pa.string()), ("verdict", pa.string())]),
        )

    host, path, hit = fresh(pages, "host", "path", "hit")
    return (
        pages.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
        .withColumn(hit, look_up(host, path))
        .withColumn("url_filter", _result(F.col(host), F.col(path), F.col(hit)["rule"], F.col(hit)["verdict"]))
        .drop(host, path, hit)
    )


def _by_join(pages: DataFrame, rules: DataFrame, url: str) -> DataFrame:
    """Every host suffix meets the rules of that host; each distinct host and path is looked up once."""
    host, path, hit = fresh(pages, "host", "path", "hit")
    located = pages.withColumns({host: host_of(F.col(url)), path: path_of(F.col(url))})
    labels = F.split("h", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    asked = located.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    best = (
        asked.select("h", "p", F.explode(suffixes).alias("suffix"))
        .join(rules, F.col("suffix") == F.col("host"))
        .filter(F.expr("startswith(p, path)"))
        .groupBy("h", "p")
        .agg(
            F.max(
                F.struct(
                    F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"), "verdict",
                    F.concat("host", "path").alias("rule"),
                )
            ).alias("b")
        )
        .select(F.col("h").alias("_h"), F.col("p").alias("_p"), F.struct("b.rule", "b.verdict").alias(hit))
    )
    joined = located.join(best, (located[host] == best["_h"]) & (located[path] == best["_p"]), "left")
    verdict = F.coalesce(F.col(hit)["verdict"], F.lit("allow"))
    return joined.withColumn("url_filter", _result(F.col(host), F.col(path), F.col(hit)["rule"], verdict)).drop(
        host, path, hit, "_h", "_p"
    )


def _result(host: Column, path: Column, rule: Column, verdict: Column) -> Column:
    return F.struct(host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("verdict"))
