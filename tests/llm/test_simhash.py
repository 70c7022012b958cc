"""SimHash components against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash
from conftest import SMALL
from llm.odd import documents

from paylattice.llm import simhash
from paylattice.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(keys):
    """Smallest position connected with every key, by all pairs."""
    keys = np.array(keys, np.uint64)
    root = np.arange(len(keys))
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= simhash.BUDGET
    while True:
        new = np.where(near, root[None, :], len(keys)).min(axis=1)
        if (new == root).all():
            return root.tolist()
        root = new


def expected_rows(docs):
    keys = [plain_fingerprint(t) for _, t in docs]
    least = {}
    labels = roots(keys)
    for (doc, _), label in zip(docs, labels):
        if doc is not None:
            least[label] = min(least.get(label, doc), doc)
    return [(doc, f"{key:016x}", least.get(label)) for (doc, _), key, label in zip(docs, keys, labels)]


@pytest.mark.parametrize("leaf, fanout", [(simhash.LEAF, simhash.FANOUT), (4, 16)])
def test_components_of_documents(spark, leaf, fanout, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", leaf)  # 4: the trie of tables goes down to the last bit
    monkeypatch.setattr(simhash, "FANOUT", fanout)
    odd = documents(spark)
    for frame in (odd, spark.read.parquet(f"{SMALL}/documents.parquet")):
        got = [tuple(r) for r in simhash.near_duplicates(frame).collect()]
        assert sorted(got, key=str) == sorted(expected_rows(frame.select("doc_id", "text").collect()), key=str)
    assert simhash.near_duplicates(documents(spark, empty=True)).count() == 0


def test_query_returns_whole_table(spark):
    got = [tuple(r) for r in QUERIES["op11_simhash_trie"](spark, SMALL).collect()]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(got) == sorted(expected_rows(docs))


def skewed_keys():
    rng = random.Random(5)
    flip = lambda key, n: key ^ sum(1 << b for b in rng.sample(range(64), n))
    keys = {rng.getrandbits(64) for _ in range(300)}
    keys |= {flip(k, n) for k in sorted(keys)[:100] for n in (1, 4, 5)}
    centre = rng.getrandbits(64)
    keys |= {flip(centre, rng.randrange(9)) for _ in range(300)}  # one large group, most in one leaf
    keys |= {centre ^ i for i in range(40)} | {0, 2**64 - 1, 1, 2**63}
    return sorted(keys)


@pytest.mark.parametrize("leaf, fanout", [(5, 16), (150, 4)])
def test_trie_finds_every_link(spark, leaf, fanout, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "FANOUT", fanout)
    monkeypatch.setattr(simhash, "_CHUNK", 256)  # several chunks
    keys = skewed_keys()
    signed = np.array(keys, np.uint64).view(np.int64).tolist()
    links = simhash.link_keys(spark.createDataFrame([(k,) for k in signed], "key long")).collect()
    place = {k: i for i, k in enumerate(signed)}
    found = simhash._join_roots(
        np.arange(len(keys)), np.array([place[r.a] for r in links]), np.array([place[r.b] for r in links])
    )
    assert found.tolist() == roots(keys)


def test_cells_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 60)
    monkeypatch.setattr(simhash, "FANOUT", 4)
    rng = np.random.default_rng(2)
    keys = spark.createDataFrame([(int(k),) for k in rng.integers(-(2**63), 2**63, 8000)], "key long")
    leaves, nodes, depth = simhash._trie(keys)
    cells = simhash._cells(nodes, depth)
    most, total, n = leaves.selectExpr("max(size(keys))", "sum(size(keys))", "count(*)").first()
    assert (total, n) == (8000, 256) and most <= 60
    # prefixes of 8 bits that differ in at most 4: 163 of 256, halved for order, plus the leaf itself
    assert cells.distinct().count() == cells.count() == 256 * (162 // 2 + 1)


def test_descent_equals_all_pairs():
    keys = np.array(skewed_keys(), np.uint64)
    near = np.bitwise_count(keys[:, None] ^ keys[None, :]) <= simhash.BUDGET
    pairs = [(i, j) for a, b in simhash._linked(keys, keys, True) for i, j in zip(a.tolist(), b.tolist())]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}
    a, b = keys[::2], keys[1::2]
    pairs = [(i, j) for x, y in simhash._linked(a, b, False) for i, j in zip(x.tolist(), y.tolist())]
    assert sorted(pairs) == sorted(zip(*(x.tolist() for x in np.nonzero(near[::2, 1::2]))))
