"""Packing token sequences by non-negative least squares over length combinations.

Documents are tokenised once. Whole windows are cut off their front; what is left of a document (less than
a window) falls into a length class of `STEP` tokens. Combinations of up to three classes that fill a
window are the columns of a matrix, and a non-negative least squares fit to the histogram of classes says
how often to use each. Counts are rounded down and limited to what is there; the rest is packed greedily,
largest class first. All this works on the histogram, whose size is fixed (window / STEP classes), so it
runs on the driver for any number of documents.

Rows then find their place by their number within the class: the plan is a list of intervals of numbers.

Null text counts as empty and packs as the end token alone. Repeated rows are packed each on its own.
An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paylattice.llm.common import TEXT_ROWS, cut, ship_package
from paylattice.plans.ordering import with_position

STEP = 8
_CACHE_BYTES = 24 << 20  # of words and their ids in a worker's cache, with what Python needs to hold them
_ENTRY_BYTES = 170
# A blank between white space: there the pattern of the vocabulary looks across the blank.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of the byte-level BPE vocabulary, with a cache of words.

    Its pattern never joins characters across a single blank, so a text without runs of white space is
    encoded word by word (each with the blank before it) and most words come from the cache.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
        # tokens added to the vocabulary (`<|endoftext|>`) stand for their id, as `tokenizers` reads them
        with open(re.sub(r"\.tiktoken$", ".json", path), encoding="utf-8") as file:
            self.added = {t["content"]: np.asarray([t["id"]], dtype="<u4").tobytes() for t in json.load(file)["added_tokens"]}
        longest_first = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.at_added = re.compile(f"({'|'.join(longest_first)})") if self.added else None
        self.bpe = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, bytes] = {}
        self.cached = 0

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        parts = self.at_added.split(text) if self.at_added else [text]
        if len(parts) == 1:
            return self._ordinary(text)
        return b"".join(self.added[part] if i % 2 else self._ordinary(part) for i, part in enumerate(parts))

    def _ordinary(self, text: str) -> bytes:
        if _UNSAFE.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        cache = self.cache
        found = [cache.get(word) for word in rest]
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = cache.get(rest[i]) or self._keep(rest[i], self._whole(" " + rest[i]))
        return self._whole(first) + b"".join(found)

    def _keep(self, word: str, ids: bytes) -> bytes:
        size = 4 * len(word) + len(ids) + _ENTRY_BYTES
        if self.cached + size > _CACHE_BYTES:
            self.cache.clear()
            self.cached = 0
        if size < _CACHE_BYTES:
            self.cache[word] = ids
            self.cached += size
        return ids

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.bpe.encode_ordinary(text), dtype="<u4").tobytes()


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_documents(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, row (the place of its row)."""
    ship_package(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = bpe.encode(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    out.append((doc_id, start, len(part) // 4, zlib.crc32(part), total))
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=schema.replace(" long", "").split(", "))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pieces, schema)


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    pieces = cut(cut_documents(docs, vocabulary, window, end_id), batch_rows=TEXT_ROWS)
    whole = pieces.filter(F.col("length") == window)
    rest = pieces.filter(F.col("length") < window).withColumn("class", F.ceil(F.col("length") / STEP).cast("int"))
    histogram = {r["class"]: r["n"] for r in rest.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_sequences(histogram, window)

    order = ["class", F.xxhash64("doc_id", "start", "ids_crc32"), "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    numbered = with_position(rest, order)
    first_of: dict[int, int] = {}
    seen = 0
    for size in sorted(histogram):
        first_of[size], seen = seen, seen + histogram[size]
    intervals, sequences = _intervals(plan, first_of)
    schema = "class int, from_n long, to_n long, first_sequence long, slot int"
    placed = (
        numbered.join(F.broadcast(_frame(docs, intervals, schema)), "class")
        .filter((F.col("position") >= F.col("from_n")) & (F.col("position") < F.col("to_n")))
        .withColumn("sequence_id", F.col("first_sequence") + F.col("position") - F.col("from_n"))
    )
    # a sequence has few pieces: at most window / shortest class
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    alone = with_position(whole, ["doc_id", "start", "ids_crc32", "doc_tokens"], "sequence_id").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence_id") + sequences).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return placed.select(*columns).unionByName(alone)


def _frame(docs: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return docs.sparkSession.createDataFrame(rows, schema)


# --- the plan, from the histogram -------------------------------------------------------


def plan_sequences(histogram: dict[int, int], window: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of classes with their repeat counts, which use up the histogram exactly.

    A class of c holds lengths up to c * STEP, so a combination of classes with sum window / STEP fits.
    """
    top = window // STEP
    left = {c: n for c, n in histogram.items() if n}
    combinations = _combinations(sorted(left), top)
    plan: list[tuple[tuple[int, ...], int]] = []
    if combinations:
        index = {c: i for i, c in enumerate(sorted(left))}
        matrix = np.zeros((len(index), len(combinations)))
        for j, combination in enumerate(combinations):
            for c in combination:
                matrix[index[c], j] += 1
        target = np.array([left[c] for c in sorted(left)], dtype=float)
        counts = nnls(matrix, target / target.max()) * target.max()
        for j in np.argsort(-counts, kind="stable"):
            need = defaultdict(int)
            for c in combinations[j]:
                need[c] += 1
            n = min(int(counts[j] + 1e-6), *(left[c] // k for c, k in need.items()))
            if n > 0:
                plan.append((combinations[j], n))
                for c, k in need.items():
                    left[c] -= n * k
    return plan + _greedy(left, top)


def _combinations(classes: list[int], top: int) -> list[tuple[int, ...]]:
    """One to three of the classes that sum to `top` exactly; fuller triples before sparse ones do not matter."""
    present = set(classes)
    out = [(c,) for c in classes if c == top]
    out += [(top - c, c) for c in classes if 2 * c <= top and top - c in present]
    for i, a in enumerate(classes):
        for b in classes[i:]:
            c = top - a - b
            if c < b:
                break
            if c in present:
                out.append((c, b, a))
    return out


def _greedy(left: dict[int, int], top: int) -> list[tuple[tuple[int, ...], int]]:
    """Largest class first, then whatever still fits; each found combination is repeated as often as it goes."""
    left = {c: n for c, n in left.items() if n}
    plan = []
    while left:
        room, taken = top, defaultdict(int)
        for c in sorted(left, reverse=True):
            k = min(left[c], room // c)
            if k:
                taken[c] += k
                room -= k * c
        n = min(left[c] // k for c, k in taken.items())
        plan.append((tuple(c for c in sorted(taken, reverse=True) for _ in range(taken[c])), n))
        for c, k in taken.items():
            left[c] -= n * k
            if not left[c]:
                del left[c]
    return plan


def nnls(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradient steps with restarts.

    The matrix is small and fixed in size. The result needs no more precision than rounding keeps.
    """
    gram, linear = matrix.T, matrix.T @ target
    norm = np.ones(matrix.shape[1])
    for _ in range(50):  # largest eigenvalue of the normal equations
        norm = gram @ (matrix @ norm)
        size = np.linalg.norm(norm)
        norm /= size
    step = 1.0 / (1.02 * size)
    x = momentum = np.zeros(matrix.shape[1])
    t, value = 1.0, np.inf
    for _ in range(3000):
        new = np.maximum(0.0, momentum - step * (gram @ (matrix @ momentum) - linear))
        error = float(np.sum((matrix @ new - target) ** 2))
        if error > value:  # restart the momentum
            momentum, t, value = x, 1.0, np.inf
            continue
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        momentum = new + (t - 1) / t_new * (new - x)
        x, t, value = new, t_new, error
        if error < 1e-10 * max(1e-30, float(target @ target)):
            break
    return x


def _intervals(plan: list[tuple[tuple[int, ...], int]], first_of: dict[int, int]) -> tuple[list[tuple], int]:
    """(class, from, to, first sequence, slot) per slot of every combination; and the number of sequences."""
    used = dict(first_of)
    rows, sequences = [], 0
    for combination, n in plan:
        for slot, c in enumerate(combination):
            rows.append((c, used[c], used[c] + n, sequences, slot))
            used[c] += n
        sequences += n
    return rows, sequences
