"""SimHash near-dedup by a binary trie that is joined with itself.

A text becomes a 64-bit fingerprint: a bit is 1 if it is set in over half of the hashes (XXH64, seed 42) of
its shingles of four lower-cased words. Fingerprints that differ in at most `BUDGET` bits are linked, and
connected documents form a component.

1. Equal fingerprints become one key, with the smallest doc_id, so copies cost nothing further on.
2. The upper trie is made of tables, level by level of `FANOUT` bits: a node with more than `LEAF` keys is
   split, others are leaves. Keys are distinct, so a leaf holds at most `LEAF` of them, however skewed they are.
3. Pairs of nodes go down together: the children of one node meet the children of the other, differing bits
   add up, and a pair beyond the budget is dropped with everything below it. A leaf that meets a deeper
   node waits and counts only the bits that it knows.
4. A surviving pair of leaves is a cell, dealt to a task with the keys of both. There the same descent goes on
   bit by bit, over arrays of node pairs and depth first in bounded chunks, down to ranges that are compared
   whole. A cell gives one row per linked key (a tree of links), never the pairs, so its memory is bounded by
   `LEAF` and not by the number of links.
5. Connected components of these rows, which stay distributed, get the smallest doc_id of their documents.

A text of fewer than four words is one shingle of all its words; null texts, empty texts and texts of blanks
have fingerprint zero and are linked like any other. Every row of the table gives one row. Rows without an id
take part, a component that has only such rows has a null id, and rows that share an id may have different
fingerprints. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylattice.llm.common import cut, ship_package
from paylattice.llm.components import connected_components

SHINGLE, SEED, BITS = 4, 42, 64
BUDGET = 4  # differing bits of linked fingerprints
FANOUT = 2  # bits per level of the upper trie
LEAF = 32_768  # keys of a leaf at most
_CHUNK = 1 << 18  # node pairs or key pairs that a task holds at once
_SMALL = 8  # ranges of up to so many keys are compared whole


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a text (UTF-8)."""
    words = (text or b"").lower().split()  # bytes: only A-Z, blank and tab to carriage return count
    if not words:
        return 0
    columns = [words[i:] for i in range(min(SHINGLE, len(words)))]
    code = xxhash.xxh64_intdigest
    hashes = np.fromiter((code(b" ".join(shingle), SEED) for shingle in zip(*columns)), dtype="<u8")
    n = len(hashes)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, n, 4096):
        bits = np.unpackbits(hashes[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


_PRINTS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64())])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and fingerprint (as a signed long `key`) of every row."""
    ship_package(docs.sparkSession)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(b.as_py()) for b in batch.column(1).cast(pa.binary())], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], schema=_PRINTS)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(prints, "doc_id long, key long")


def _trie(keys: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """level, node and sorted keys of every leaf; level, node and `leaf` of every node; the deepest level."""
    leaves, nodes, rest, level = [], [], keys.select("key"), 0
    while True:
        node = F.lit(0).cast("long") if level == 0 else F.shiftrightunsigned("key", BITS - FANOUT * level)
        here = rest.withColumn("node", node)
        sizes = cut(
            here.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
            .select(F.lit(level).alias("level"), "node", (F.col("size") <= LEAF).alias("leaf")), "trie",
        )
        nodes.append(sizes)
        leaves.append(
            here.join(sizes.filter("leaf"), "node").groupBy("level", "node")
            .agg(F.array_sort(F.collect_list("key")).alias("keys"))
        )
        large = sizes.filter("not leaf").select("node")
        if large.isEmpty():
            break
        rest = cut(here.join(large, "node", "left_semi").select("key"), "trie")
        level += 1
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return cut(union(leaves), "trie"), union(nodes), level


def _cells(nodes: DataFrame, depth: int) -> DataFrame:
    """a_level, a_node, b_level, b_node of the pairs of leaves that may hold linked keys, each pair once."""
    root = nodes.filter("level = 0")
    sides = [[F.col(c).alias(f"{side}_{c}") for c in ("level", "node", "leaf")] for side in "ab"]
    pairs = cut(root.select(*sides[0], *sides[1]), "trie")
    ready = [pairs.filter("a_leaf and b_leaf")]
    for level in range(1, depth + 1):
        below = nodes.filter(F.col("level") == level)
        pairs = pairs.filter("not (a_leaf and b_leaf)")
        for side, columns in zip("ab", sides):
            children = below.select(F.shiftrightunsigned("node", FANOUT).alias(f"{side}_parent"), *columns)
            waits = pairs.filter(f"{side}_leaf")
            goes = pairs.filter(f"not {side}_leaf").withColumnRenamed(f"{side}_node", f"{side}_parent")
            goes = goes.drop(f"{side}_level", f"{side}_leaf").join(children, f"{side}_parent").drop(f"{side}_parent")
            pairs = waits.unionByName(goes)
        # the bits that both nodes know
        known = [
            F.expr(f"shiftrightunsigned({s}_node, {FANOUT} * ({s}_level - least(a_level, b_level)))") for s in "ab"
        ]
        apart = F.bit_count(known[0].bitwiseXOR(known[1]))
        pairs = cut(pairs.filter(apart <= BUDGET).filter("a_level <> b_level or a_node <= b_node"), "trie")
        ready.append(pairs.filter("a_leaf and b_leaf"))
    return reduce(DataFrame.unionByName, ready).drop("a_leaf", "b_leaf")


def _halves(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """Where the keys with that bit start in ranges whose keys agree on all bits before."""
    upper = np.uint64((1 << BITS) - (1 << (BITS - bit)))
    middle = np.searchsorted(keys, (keys[low] & upper) | np.uint64(1 << (BITS - 1 - bit)))
    return np.clip(middle, low, high)


def _linked(a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked keys of two sorted arrays, by a descent in both tries; with `same`, b is a."""
    one = lambda x: np.array([x], np.int64)
    stack = [(0, one(0), one(len(a)), one(0), one(len(b)), one(0))]
    while stack:
        bit, a_low, a_high, b_low, b_high, apart = stack.pop()
        if len(a_low) > _CHUNK:  # depth first, a part at a time
            half = len(a_low) // 2
            stack += [(bit, *(x[part] for x in (a_low, a_high, b_low, b_high, apart))) for part in (slice(half, None), slice(half))]
            continue
        small = np.maximum(a_high - a_low, b_high - b_low) <= _SMALL
        yield from _compare(a, b, a_low[small], a_high[small], b_low[small], b_high[small], same)
        a_low, a_high, b_low, b_high, apart = (x[~small] for x in (a_low, a_high, b_low, b_high, apart))
        if not len(a_low):
            continue
        a_mid, b_mid = _halves(a, a_low, a_high, bit), _halves(b, b_low, b_high, bit)
        twin = (a_low == b_low) if same else np.zeros(len(a_low), bool)  # a node with itself
        below = []
        for x, (x_low, x_high) in enumerate(((a_low, a_mid), (a_mid, a_high))):
            for y, (y_low, y_high) in enumerate(((b_low, b_mid), (b_mid, b_high))):
                more = apart + (x != y)
                keep = (x_low < x_high) & (y_low < y_high) & (more <= BUDGET)
                if x > y:
                    keep &= ~twin
                below.append([z[keep] for z in (x_low, x_high, y_low, y_high, more)])
        stack.append((bit + 1, *(np.concatenate(z) for z in zip(*below))))


def _compare(a, b, a_low, a_high, b_low, b_high, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked positions of pairs of short ranges."""
    reach = np.arange(_SMALL)
    for n in range(0, len(a_low), _CHUNK // _SMALL**2):
        part = slice(n, n + _CHUNK // _SMALL**2)
        i = a_low[part, None] + reach
        j = b_low[part, None] + reach
        left, right = a[np.minimum(i, len(a) - 1)], b[np.minimum(j, len(b) - 1)]
        p, x, y = np.nonzero(np.bitwise_count(left[:, :, None] ^ right[:, None, :]) <= BUDGET)
        i, j = i[p, x], j[p, y]
        real = (i < a_high[part][p]) & (j < b_high[part][p])
        if same:
            real &= i < j
        yield i[real], j[real]


def _join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position connected with each, after the links (i, j) have been added."""
    while True:
        x, y = root[i], root[j]
        differ = x != y
        if not differ.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (root[root] != root).any():
            root = root[root]


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row (key, root) per key that is linked inside its cell."""
    for batch in batches:
        for same, left, right in zip(*(batch.column(c) for c in ("same", "a_keys", "b_keys"))):
            same = same.as_py()
            a, b = (np.sort(x.values.to_numpy().view(np.uint64)) for x in (left, right))
            shift = 0 if same else len(a)
            keys = a if same else np.concatenate([a, b])
            root = np.arange(len(keys))
            for i, j in _linked(a, b, same):
                if len(i):
                    root = _join_roots(root, i, j + shift)
            hung = np.flatnonzero(root != np.arange(len(keys)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[hung].view(np.int64)), pa.array(keys[root[hung]].view(np.int64))], schema=_LINKS
            )


def link_keys(keys: DataFrame) -> DataFrame:
    """a, b: links between distinct longs `key` that connect exactly those within the budget of each other."""
    leaves, nodes, depth = _trie(keys)
    cells = _cells(nodes, depth)
    for side in "ab":
        cells = cells.join(
            leaves.select(
                F.col("level").alias(f"{side}_level"), F.col("node").alias(f"{side}_node"), F.col("keys").alias(f"{side}_keys")
            ),
            [f"{side}_level", f"{side}_node"],
        )
    same = (F.col("a_level") == F.col("b_level")) & (F.col("a_node") == F.col("b_node"))
    return cells.select(same.alias("same"), "a_keys", "b_keys").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row per row of `docs`; the component is
    named by the smallest doc_id in it."""
    printed = cut(fingerprints(docs, text), "prints")
    keys = cut(printed.groupBy("key").agg(F.min("doc_id").alias("least")), "keys")
    parts = connected_components(link_keys(keys))
    named = parts.join(keys, F.col("node") == F.col("key"))
    first = named.groupBy("component").agg(F.min("least").alias("first"))
    known = keys.join(named.select("key", "component"), "key", "left").join(first, "component", "left").select(
        "key", F.coalesce("first", "least").alias("component_id")
    )
    return printed.join(cut(known, "known"), "key").select(
        "doc_id", F.lpad(F.lower(F.hex("key")), 16, "0").alias("fingerprint"), "component_id"
    )
