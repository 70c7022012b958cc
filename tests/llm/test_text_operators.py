"""The text operators against brute force, on the smallest documents and on odd rows."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import connect, difference
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.odd import documents
from pyspark.sql import functions as F

from paylattice.llm import (
    chat, components, jaccard_join, line_dedup, mixing, packing, quality_rules, sharding, suffix_dedup, topk, url_filter,
)
from paylattice.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module", params=["small", "odd", "empty"])
def docs(request, spark, small):
    return small if request.param == "small" else documents(spark, request.param == "empty")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, SMALL), connect(SMALL), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_product(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


# --- quality rules ----------------------------------------------------------------------


def counts(text):
    words = WORD.findall(text or "")
    windows = list(zip(words, words[1:], words[2:]))
    times = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_repeat_words": len(covered),
        "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines),
        "n_symbols": sum(c in quality_rules.SYMBOLS for c in text or ""),
    }


def test_quality_counts(docs):
    for r in rows(docs.select("text", quality_rules.measures(F.col("text")).alias("m"))):
        expected = counts(r["text"])
        assert {k: r["m"][k] for k in expected} == expected


def test_binomial_tail(spark):
    from math import comb

    cases = [(0, 10), (3, 200), (9, 1000), (2, 30), (7, 20)]
    found = spark.createDataFrame(cases, "k long, n long").select(
        "k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.05).alias("p")
    )
    for r in found.collect():
        exact = sum(comb(r.n, i) * 0.05**i * 0.95 ** (r.n - i) for i in range(r.k + 1))
        assert r.p == pytest.approx(1.0 if r.k > 0.05 * r.n else exact, rel=1e-9)


def test_quality_rejects_junk_and_keeps_good(spark):
    good = [" ".join(f"v{i}x{j}" for j in range(60)) for i in range(1500)]
    junk = [" ".join(f"v{i}x{j}$$$" for j in range(60)) for i in range(100)]
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + junk)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(1500)] + [(1500, 0), (1500, 1)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality_rules.keep_good(frame, labels).collect()}
    assert kept == set(range(1500))
    # without enough labels no rule is proven, so only the base rules judge
    few = {r.doc_id for r in quality_rules.keep_good(frame, labels.limit(20)).collect()}
    assert few == set(range(1600))


def test_small_strata_get_rules(spark):
    # stratum -> labelled good documents, junk documents
    sizes = {"en": (300, 20), "de": (150, 20), "fr": (30, 20), "es": (0, 20), None: (5, 5)}
    made, labelled = [], []
    for lang, (n_good, n_junk) in sizes.items():
        for j in range(n_good + n_junk):
            mark = "" if j < n_good else "$$$"
            made.append((len(made), " ".join(f"v{j}x{w}{mark}" for w in range(60)), lang, j < n_good))
            labelled += [(made[-1][0], 1)] if j < n_good else []
    frame = spark.createDataFrame([r[:3] for r in made], "doc_id long, text string, lang string")
    labels = spark.createDataFrame(labelled, "doc_id long, quality int")
    kept = {r.doc_id for r in quality_rules.keep_good(frame, labels).collect()}
    assert kept == {r[0] for r in made if r[3]}
    measured = frame.select("doc_id", "lang", quality_rules.measures(F.col("text")).alias("m"))
    found = {r.stratum: r for r in quality_rules.calibrate(measured, labels).collect()}
    assert {k: r.pooled for k, r in found.items()} == {"en": False, "de": False, "fr": True, "es": True, None: True}
    # pooled cutoffs stop where the stratum's own good documents are lost
    odd = frame.withColumn("text", F.when(F.col("lang") == "fr", F.concat("text", F.lit(" ###" * 5))).otherwise(F.col("text")))
    lost = {r.doc_id for r in quality_rules.quality_verdicts(odd, labels).filter("not kept").collect()}
    assert not lost & {r[0] for r in made if r[3]}


def test_joint_loss_stays_below_the_limit(spark):
    # ten labelled good documents in 400 break one rule each: 2.5 % per rule, 5 % together
    good = [" ".join(f"v{i}x{j}" for j in range(60)) for i in range(400)]
    for i in range(10):
        good[i] = " ".join(f"v{i}x{j}$$$" for j in range(60))
        good[10 + i] = " ".join(f"v{i}x{j}!" for j in range(60))
    frame = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(400)], "doc_id long, quality int")
    assert quality_rules.keep_good(frame, labels).count() > 380


def test_keep_good_keeps_columns(spark, docs):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    kept = quality_rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    expected = [r for r in rows(docs) if counts(r["text"])["n_words"] >= 50 and 2 * counts(r["text"])["n_repeat_words"] <= counts(r["text"])["n_words"]]
    assert kept.count() == len(expected)


# --- urls -------------------------------------------------------------------------------

RULES = [
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.net", "/en/bad"), ("allow", "a.example.net", ""),
    ("block", "org", "/x/y/"), ("allow", "org", "/x/y/"), ("block", None, "/"),
]
URLS = [
    "http://example.net/en/1", "http://EXAMPLE.net/en/badger", "https://b.a.example.net?x=/en/", "ftp://net/", "http://xnet/", None,
    "no url", "", "http://q.org/x/y/z#f", "http://q.org/x/yz", "http://example.net/de", "://net/x?y", "http://example.net",
    "http://example.net/en/1", "http://é.net/Ä\n/?",
]


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_url_rules(spark, broadcast_rows):
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    for r in rows(url_filter.filter_urls(pages, rules, broadcast_rows=broadcast_rows)):
        host, path = "", ""
        if r["url"] and "://" in r["url"]:
            host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", r["url"].split("://", 1)[1]).groups()
            host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = [
            (h.count("."), len(p), v, h + p) for v, h, p in RULES if h and ("." + host).endswith("." + h) and path.startswith(p)
        ]
        best = max(fits, default=(0, 0, "allow", None))
        assert r["url_filter"] == {"host": host, "path": path, "rule": best[3], "verdict": best[2]}
    assert url_filter.filter_urls(pages.limit(0), rules.limit(0), broadcast_rows=broadcast_rows).count() == 0


# --- sharding ---------------------------------------------------------------------------


@pytest.mark.parametrize("bucket_bytes", [1 << 24, 20_000])
def test_two_pass_shuffle(docs, bucket_bytes, tmp_path):
    placed = sharding.scatter_and_shuffle(docs, 8, bucket_bytes=bucket_bytes)
    got = rows(placed.select("doc_id", "text", "place.*"))
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted(
        (r["doc_id"] or -1, r["text"] or "") for r in rows(docs.select("doc_id", "text"))
    )
    slots = collections.defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    sizes = [len(slots[i]) for i in range(8)]
    assert max(sizes) - min(sizes) <= 1


def test_shuffle_is_seeded_and_written(spark, small, tmp_path):
    def order(seed):
        placed = sharding.scatter_and_shuffle(small, 4, seed=seed, bucket_bytes=50_000)
        return {r.doc_id: (r.place.shard, r.place.slot) for r in placed.select("doc_id", "place").collect()}

    assert order(1) == order(1) != order(2)
    sharding.write_shards(sharding.scatter_and_shuffle(small, 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == small.count()


# --- chat -------------------------------------------------------------------------------


def test_events_are_folded(spark):
    events = spark.createDataFrame(
        [
            (1, 0, "message", 0, "user", "hi"), (1, 1, "message", 1, "assistant", "He"), (1, 2, "delta", 1, None, "llo"),
            (1, 3, "message", 2, "user", "more"), (1, 4, "regenerate", 1, None, None), (1, 5, "delta", 1, None, "Good "),
            (1, 6, "delta", 1, None, "day"), (1, 7, "edit", 0, None, "hey"), (1, 8, "message", 2, "user", None),
            (None, 0, "message", 0, None, "x\\<s>[SAY]"), (2, 0, "message", 0, "assistant", "</s>é"),
        ],
        "conv_id long, seq long, kind string, message long, role string, text string",
    )
    out = {
        r.conv_id: ([(t.role, t.text) for t in r.turns], r.learned)
        for r in chat.render(chat.fold(events)).select(
            "conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learned")
        ).collect()
    }
    assert out == {
        1: ([("user", "hey"), ("assistant", "Good day"), ("user", "")], "Good day"),
        None: ([("", "x\\<s>[SAY]")], ""), 2: ([("assistant", "</s>é")], "</s>é"),
    }
    assert chat.render(chat.fold(events.limit(0))).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="<>s/\\[]INSTOUAY \né"), max_size=12))
def test_escape_round_trip(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not any(mark in r.e for mark in chat.CONTROLS)


# --- top k ------------------------------------------------------------------------------


def test_top_k_with_odd_vectors(spark):
    data = [(i, [float((i * 37 + j * 11) % 23 - 11) / 256 for j in range(6)]) for i in range(300)]
    data += [(50, [1.0] * 6), (301, None), (302, [None, 1.0]), (303, [float("nan")]), (304, [float("inf"), 0.0]), (305, [0.5, 0.5])]
    data += [(400 + i, data[0][1]) for i in range(40)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").select(
        "vec_id", topk.integer_vector(F.col("embedding")).alias("vector")
    )
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(frame, F.col("vec_id") % 50 == 0, 5).collect())
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in data if v and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for at, (i, v) in enumerate(good):
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for n, (j, w) in enumerate(good) if n != at)[:5]
            expected += [(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)]
    assert got == sorted(expected)
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- mixing -----------------------------------------------------------------------------


def test_mix(docs):
    got = rows(mixing.mix(docs).select("doc_id", "source", "text", "mix.*"))
    assert len(got) == docs.count()
    taken, size, target = collections.Counter(), collections.Counter(), {}
    for r in got:
        assert r["size"] == len(WORD.findall(r["text"] or "")) and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    for s in target:
        assert target[s] <= 3 * size[s] + 1e-6
        largest = max((r["size"] for r in got if r["source"] == s), default=0)
        assert abs(taken[s] - target[s]) <= largest + 1
    if got:
        assert sum(target.values()) == pytest.approx(sum(size.values()))
    again = rows(mixing.mix(docs).select("doc_id", "source", "text", "mix.*"))
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_flow_prefers_first_copies():
    # words of both sources can serve either; only the flow finds that no repetition is needed
    flows = mixing.route([(("a",), 10), (("a", "b"), 30), (("b",), 5)], {"a": 20, "b": 25})
    assert flows == [{"a": 10}, {"a": 10, "b": 20}, {"b": 5}]
    flows = mixing.route([(("a",), 10), (("b",), 10)], {"a": 25, "b": 5})
    assert flows == [{"a": 25}, {"b": 5}]


def shared_out(sizes, weights, total, most=3):
    open_, targets, rest = dict(weights), {}, total
    while open_:
        each = rest / sum(open_.values())
        full = [s for s, w in open_.items() if w * each > most * sizes[s]]
        if not full:
            return targets | {s: w * each for s, w in open_.items()}
        for s in full:
            targets[s] = most * sizes[s]
            rest -= targets[s]
            del open_[s]
    return targets


def test_targets_are_capped_and_reshared(spark):
    rng = random.Random(3)
    cases = [({"a": 10, "b": 100, "c": 100}, 210), ({"a": 1, "b": 0}, 50)]
    cases += [({f"s{i:02}": rng.choice([0, 1, 7, 90, 4000]) for i in range(rng.randrange(1, 30))}, rng.choice([1, 900, 40_000])) for _ in range(3)]
    for sizes, total in cases:
        frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r["source"]: r["target"] for r in rows(mixing.source_targets(frame, (5, 2, 1), total))}
        weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
        assert got == pytest.approx(shared_out(sizes, weights, total))


def least_cost(patterns, quotas, costs=(0, 1, 4)):
    """Most words that reach the quotas, and the least cost for that; every split of every pattern is tried."""
    splits = [
        [x for x in itertools.product(range(3 * n + 1), repeat=len(m)) if sum(x) <= 3 * n] for m, n in patterns
    ]
    best = None
    for choice in itertools.product(*splits):
        into = collections.Counter()
        for (m, _), x in zip(patterns, choice):
            into.update(dict(zip(m, x)))
        if all(into[s] <= q for s, q in quotas.items()):
            cost = sum(c * min(max(sum(x) - i * n, 0), n) for (_, n), x in zip(patterns, choice) for i, c in enumerate(costs))
            best = min(best or (1, 0), (-sum(into.values()), cost))
    return best


def test_flow_costs_no_more_than_the_best_of_all_splits():
    rng = random.Random(8)
    for _ in range(25):
        patterns = [(m, rng.randrange(1, 3)) for m in rng.sample([("a",), ("b",), ("c",), ("a", "b"), ("b", "c")], 3)]
        quotas = {s: rng.randrange(6) for s in "abc"}
        flows = mixing.route(patterns, quotas)
        used = [sum(f.values()) for f in flows]
        cost = sum(c * min(max(u - i * n, 0), n) for (_, n), u in zip(patterns, used) for i, c in enumerate((0, 1, 4)))
        assert (-sum(used), cost) == least_cost(patterns, quotas), (patterns, quotas)


def test_mix_of_many_sources_and_of_shared_documents(spark, monkeypatch):
    many = spark.range(60_000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), "id").alias("source"), F.lit("a b c").alias("text")
    )
    mix = mixing.mix(many).select("mix.*")
    # targets of 5.625, 2.25 and 1.125 words: only the first can be met by whole documents of three
    assert mix.agg(F.count("*"), F.sum("size"), F.max("taken"), F.sum("taken")).first() == (60_000, 180_000, 6, 120_000)
    # two groups of overlapping sources, one source alone, one document without sources
    lists = [["a"], ["a", "b"], ["b"], ["x", "y"], ["y", "z"], [None], []] * 12
    frame = spark.createDataFrame(
        [(i, s, " ".join(["w"] * (1 + i % 5))) for i, s in enumerate(lists)], "doc_id long, of array<string>, text string"
    )
    got = {r["doc_id"]: r for r in rows(mixing.mix(frame, sources=F.col("of")).select("doc_id", "mix.*"))}
    monkeypatch.setattr(mixing, "BROADCAST_PATTERNS", 0)
    assert got == {r["doc_id"]: r for r in rows(mixing.mix(frame, sources=F.col("of")).select("doc_id", "mix.*"))}
    patterns, sizes = collections.Counter(), collections.Counter()
    for i, s in enumerate(lists):
        patterns[tuple(s)] += 1 + i % 5
        sizes.update({x: 1 + i % 5 for x in s})
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = shared_out(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, sum(patterns.values()))
    order = sorted(patterns, key=lambda p: [(s is None, s or "") for s in p])
    flows = mixing.route([(p, patterns[p]) for p in order], {s: round(targets[s]) for s in names})
    for p, flow in zip(order, flows):
        taken = sum(got[i]["taken"] for i, s in enumerate(lists) if tuple(s) == p)
        assert sum(flow.values()) - 5 <= taken <= sum(flow.values())
        first = [got[i] for i, s in enumerate(lists) if tuple(s) == p][0]
        assert first["target"] == pytest.approx(targets[p[0]] if p else 0)


# --- packing ----------------------------------------------------------------------------


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    texts = collections.defaultdict(list)
    for r in rows(docs.select("doc_id", "text")):
        texts[r["doc_id"]].append(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    got = rows(packing.pack(docs, VOCABULARY))
    places = collections.defaultdict(list)
    pieces = collections.Counter()
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        codes = [
            zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
            for ids in texts[r["doc_id"]] if len(ids) == r["doc_tokens"]
        ]
        assert r["ids_crc32"] in codes
        pieces[r["doc_id"]] += r["length"]
    assert pieces == {d: sum(map(len, t)) for d, t in texts.items()}
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sé \n\t  \x1c1!<|endoftext|>"), max_size=40))
def test_word_cache_gives_the_same_ids(text):
    from tokenizers import Tokenizer

    global _REFERENCE
    if "_REFERENCE" not in globals():
        _REFERENCE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        _REFERENCE.encode_special_tokens = True
    expected = _REFERENCE.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(VOCABULARY).encode(text), "<u4").tolist() == expected


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n  y z", "<|endoftext| >"])
def test_added_tokens_stand_for_their_ids(text):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = plain.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(VOCABULARY).encode(text), dtype="<u4").tolist() == expected


def test_plan_uses_the_histogram_up():
    histogram = {c: (c * 37) % 91 + 1 for c in range(1, 257)}
    plan = packing.plan_sequences(histogram, 2048)
    used = collections.Counter()
    for combination, n in plan:
        assert sum(combination) <= 256
        for c in combination:
            used[c] += n
    assert used == histogram
    filled = sum(sum(c) * n for c, n in plan) / (256 * sum(n for _, n in plan))
    assert filled > 0.97


def test_least_squares():
    matrix = np.array([[1.0, 0, 1, 2], [1, 1, 0, 0], [0, 1, 1, 0]])
    x = packing.nnls(matrix, matrix @ np.array([0.3, 0.0, 0.5, 0.1]))
    assert matrix @ x == pytest.approx(matrix @ np.array([0.3, 0.0, 0.5, 0.1]), abs=1e-4)
    assert (x >= 0).all()


# --- lines ------------------------------------------------------------------------------


def without_lines(body, spans):
    gone = {i for s in spans for i in range(s["first"], s["first"] + s["n"])}
    return "\n".join(x for i, x in enumerate(body.split("\n")) if i not in gone) if body is not None else None


def test_line_dedup(docs):
    got = rows(line_dedup.remove_repeated_chunks(docs).select("doc_id", "text", "line_dedup.*"))
    before = rows(docs.select("doc_id", "text"))
    assert len(got) == len(before)
    units = sorted({(r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in before}, key=lambda u: u[:2])
    first, ties = {}, set()
    for none, doc, text in units:
        for chunk, [(at, _, _)] in line_dedup._chunks(text):
            if chunk not in first:
                first[chunk] = (none, doc, text, at)
            elif first[chunk][:2] == (none, doc) and first[chunk][2] != text:
                ties.add(chunk)
    assert not ties
    expected = collections.Counter()
    for r in before:
        unit = (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
        spans = [{"first": a, "n": n} for c, [(a, n, _)] in line_dedup._chunks(r["text"] or "") if first[c] != (*unit, a)]
        expected[r["doc_id"], without_lines(r["text"], spans), sum(s["n"] for s in spans)] += 1
    assert collections.Counter((r["doc_id"], r["text"], r["removed_lines"]) for r in got) == expected


def test_passages_are_found_at_other_places():
    passage = [f"line {i} of the passage" for i in range(20)]
    a = line_dedup.chunk_lines(["x", *passage, "y"])
    b = line_dedup.chunk_lines(["p", "q", "r", *passage, "z"])
    ours = {(f - 1, n) for f, n in a if f >= 1}
    assert len(ours & {(f - 3, n) for f, n in b}) >= 4


def test_boundaries_stay_inside_a_moved_passage():
    rng = random.Random(5)
    passage = [f"line {rng.randrange(9)} of the passage" if rng.random() < 0.8 else "" for _ in range(30)]
    at = {shift: line_dedup.boundary_chunks([f"b {i}" for i in range(shift)] + passage + ["y"]) for shift in (0, 1, 7)}
    inside = {
        shift: {(b - shift, f - shift, n) for b, chunks in grown.items() for f, n in chunks if f >= shift and f + n <= shift + 30}
        for shift, grown in at.items()
    }
    assert inside[0] == inside[1] == inside[7] and all(f <= b < f + n for b, f, n in inside[0])
    held = {i for _, f, n in inside[0] for i in range(f, f + n)}
    assert {i for i, line in enumerate(passage) if line} <= held
    assert sum(len(line_dedup.boundary_chunks([str(i) for i in range(k)])) for k in range(2)) == 0  # no single lines


def test_nothing_goes_without_boundaries(spark, monkeypatch):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\ny", "c\nd\nz"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda: {r["doc_id"]: r["text"] for r in rows(line_dedup.remove_repeated_lines(frame))}
    assert found() == {0: texts[0], 1: "x\ny", 2: "z"}
    monkeypatch.setattr(line_dedup, "_grown", lambda text: iter(()))
    assert found() == dict(enumerate(texts))


def test_shared_runs_of_lines_go_whole(spark):
    rng = random.Random(11)
    line = lambda: rng.choice(["a b", "c", "d e f", "g", "h i", "", "", " "])
    texts = ["\n".join(line() for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    texts += ["x x\nx x\nx x\nx x\nx x", "k\nl\nm", "n\nk\nl\no", "p q\n\n\n\n\nr s", "t\np q\n\n\n\n\nr s\nu"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in rows(line_dedup.remove_repeated_lines(frame).select("doc_id", "text", "line_dedup.*"))}
    split = [t.split("\n") for t in texts]
    for doc, lines in enumerate(split):
        gone = set()
        for i, j in itertools.combinations(range(len(lines) + 1), 2):
            run = lines[i:j]
            # a run with a word, at most one wordless line at either end, and a disjoint earlier place
            if j - i < 2 or not any(x.strip() for x in run[:2]) or not any(x.strip() for x in run[-2:]):
                continue
            if any(
                other[a : a + j - i] == run
                for o, other in enumerate(split[: doc + 1])
                for a in range(len(other) if o < doc else max(0, i - (j - i) + 1))
            ):
                gone |= set(range(i, j))
        words_left = [x for n, x in enumerate(lines) if n not in gone and x.strip()]
        r = got[doc]
        assert [x for x in (r["text"] or "").split("\n") if x.strip()] == words_left, doc
        assert r["lines"] == len(lines) and r["removed_lines"] >= len(gone)
        if r["removed_lines"] < len(lines):
            assert r["text"].count("\n") + 1 == len(lines) - r["removed_lines"]
    assert got[64]["text"] == "t\nu"  # the lines without a word inside a passage go with it


# --- n-gram join ------------------------------------------------------------------------


def exact_links(pairs):
    sets = [(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())) for i, w in pairs]
    links, parent = collections.Counter(), {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            both = len(a & b)
            if both and 9 * both >= 4 * (len(a) + len(b)):
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (root(i), links[i]) for i, _ in sets}


def check_near_duplicates(docs):
    got = rows(jaccard_join.near_duplicates(docs))
    source = rows(docs.select("doc_id", "text"))
    assert len(got) == len(source)
    texts = [(r["doc_id"], r["text"]) for r in source]
    units = {u: (u[0], n) for n, u in enumerate(dict.fromkeys(t for t in texts if t[0] is not None))}  # equal rows are one
    found = exact_links([(key, WORD.findall(t or "")) for (_, t), key in units.items()])
    expected = [
        (doc, found[units[doc, t]][0][0], found[units[doc, t]][1]) if doc is not None else (None, None, 0) for doc, t in texts
    ]
    assert collections.Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == collections.Counter(expected)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    free = sum(doc is None or not WORD.search(t or "") for doc, t in texts)
    groups = {found[key][0] for (_, t), key in units.items() if WORD.search(t or "")}
    assert kept.count() == free + len(groups)
    stay = {(r["doc_id"], r["text"]) for r in rows(kept)}
    assert all(g[0] in {doc for doc, _ in stay} for g in groups)


def test_near_duplicates(docs):
    check_near_duplicates(docs)


def test_rows_that_share_an_id_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_AT_ONCE", 64)  # several ranges of shingles
    word = lambda a, n: " ".join(f"s{i}" for i in range(a, a + n))
    data = [
        (1, word(0, 60)), (1, word(100, 60)), (2, word(100, 61)), (2, word(300, 40)), (3, word(0, 61)), (3, word(0, 60)),
        (1, word(0, 60)), (4, ""), (4, ""), (5, word(300, 40)), (5, "  " + word(300, 40)),
    ]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    check_near_duplicates(frame)
    kept = sorted((r.doc_id, r.text) for r in jaccard_join.keep_one(frame).collect())
    assert [d for d, _ in kept] == [1, 1, 2, 4, 4] and (2, word(300, 40)) in kept
    assert kept == sorted((r.doc_id, r.text) for r in jaccard_join.keep_one(frame.repartition(7)).collect())


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "_BLOCK_ROWS", 32)  # several blocks, as for groups of thousands
    base = [f"t{i}" for i in range(200)]
    texts = []
    for i in range(150):
        words = list(base)
        words[i] = f"other{i}"
        texts.append(words)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.near_duplicates(frame).collect()}
    assert got == exact_links(list(enumerate(texts)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7), (100, 98)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- suffixes ---------------------------------------------------------------------------


def test_suffix_dedup(docs):
    got = rows(suffix_dedup.remove_repeated_strings(docs).select("doc_id", "text", "suffix_dedup.*"))
    source = [(r["doc_id"], (r["text"] or "").encode()) for r in rows(docs.select("doc_id", "text"))]
    least = {}
    for doc, body in source:
        if doc is not None:
            for p in range(len(body) - 49):
                s = body[p : p + 50]
                least[s] = min(least.get(s, doc), doc)
    assert len(got) == len(source)
    for r in got:
        body = (r["text"] or "").encode()
        gone = np.zeros(len(body) + 1, dtype=bool)
        for p in range(len(body) - 49):
            if r["doc_id"] is not None and least[body[p : p + 50]] < r["doc_id"]:
                gone[p : p + 50] = True
        kept = bytes(b for b, g in zip(body, gone) if not g)
        assert (r["n_bytes"], r["n_removed"], bytes(r["kept"])) == (len(body), int(gone.sum()), kept)
        assert r["n_spans"] == int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=120) | st.text(alphabet="ab", max_size=120).map(str.encode))
def test_suffix_array(data):
    order = suffix_dedup.suffix_array(np.frombuffer(data, np.uint8))
    assert sorted(order.tolist()) == list(range(len(data)))
    cut = [data[i : i + 50] for i in order]
    assert cut == sorted(cut)


def test_hot_strings_are_dealt_by_window(spark, monkeypatch):
    passage = "".join(f"{hashlib.md5(str(i).encode()).hexdigest()} " for i in range(4))
    texts = [(i, f"{hashlib.sha256(str(i).encode()).hexdigest()}{passage}{i * 7919}") for i in range(60)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")

    def run():
        return sorted((r["doc_id"], r["n_removed"]) for r in rows(suffix_dedup.remove_repeated_strings(frame).select("doc_id", "suffix_dedup.n_removed")))

    plain = run()
    assert plain[0] == (0, 0) and all(n >= len(passage) for i, n in plain[1:])
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 4)
    assert run() == plain
