"""Periodic runs against a search of every lag."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SMALL
from llm.odd import documents

from paylattice.llm import periodic
from paylattice.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            stretch = w[start : i + q]
            if len(stretch) >= max(6, 4 * q) and not any(stretch[p:] == stretch[:-p] for p in range(1, q)):
                out.append((start, len(stretch), q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_random_sequences():
    rng = random.Random(3)
    for _ in range(1500):
        w, size = [], rng.choice([3, 10, 40, 150])
        while len(w) < size:
            if rng.random() < 0.5:
                part = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.choice([1, 2, 3, 5, 8, 13]))]
                w += (part * rng.randrange(1, 9))[: rng.randrange(1, 90)]
            else:
                w += [rng.randrange(50) for _ in range(rng.randrange(4))]
        assert periodic.find_runs(np.array(w, np.int64)) == brute(w)


def test_long_runs_cost_one_extension(monkeypatch):
    calls = []
    reach = periodic._reach
    monkeypatch.setattr(periodic, "_reach", lambda *a: calls.append(a[1:]) or reach(*a))
    assert periodic.find_runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    assert periodic.find_runs(np.tile(np.arange(5_000), 7)[3:]) == [(0, 34_997, 5_000)]
    assert len(calls) <= 4


def test_odd_rows(spark):
    # rows that hold runs: one word, a period across blanks of all kinds, nested runs, a run to the very end
    more = [
        (50, "a " * 5), (51, "a " * 6), (52, "x\ty\x0bx\x0cy\r\nx y x y z"), (53, "a a a a a a b " * 5), (54, "p " + "q r s " * 4),
        (None, "é é é é é é é"), (51, "a " * 6), (55, "u v " * 9),
    ]
    odd = documents(spark)
    frame = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    frame = frame.withColumn("periodic", frame["n_chars"])  # replaced
    got = periodic.periodic_runs(frame)
    assert got.columns == frame.columns
    rows = got.collect()
    assert len(rows) == frame.count()
    for r in rows:
        w = WORD.findall(r.text or "")
        runs = [tuple(x) for x in r.periodic.runs]
        if len(w) < 5000:
            assert runs == brute(w)
        assert r.periodic.n_words == len(w)
        assert r.periodic.collapsed == collapse(w, runs)
    assert {r.doc_id: len(r.periodic.runs) for r in rows if r.doc_id in (50, 51, 54)} == {50: 0, 51: 1, 54: 1}
    assert periodic.periodic_runs(documents(spark, empty=True)).count() == 0


@pytest.mark.parametrize("source", ["small", "odd"])
def test_query_against_brute_force(spark, source, tmp_path):
    folder = SMALL
    if source == "odd":
        folder = str(tmp_path)
        documents(spark).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    expected = []
    for doc, text in docs:
        w = WORD.findall(text or "")
        h, n = zlib.crc32(str(doc).encode()) if doc is not None else 1, len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute(w) if n < 5000 else [tuple(r) for r in periodic.find_runs(np.unique(w, return_inverse=True)[1])]
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        expected.append((
            doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{x},{q}\n" for s, x, q in runs)), sha(collapse(w, runs)),
        ))
    got = [tuple(r) for r in QUERIES["op13_periodic_runs"](spark, folder).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
