"""Periodic runs of words, found by seeds on diagonals.

A run is a stretch of words with smallest period q (words q apart are equal), at least `POWER` periods and
`SHORTEST` words long, that no neighbouring word extends. On the diagonal of lag q it matches for
max(SHORTEST, POWER * q) - q words at least. Lags are dealt into classes [2^j, 2^(j+1)); the least overlap
of a class is the length k of its seeds, and k is never below its lags.

1. k-grams are indexed by exact names: a name of 2^m words is the rank of two names of 2^(m-1) words.
   A gram that stands only once in the text is left out for good, so plain prose ends after a few levels.
2. Same-text occurrence pairs: since k >= q, the next occurrence of a seed inside a run is exactly q words
   on, so each occurrence is paired with the next one only. That finds every run with one pair a word,
   where all pairs of a gram would grow with the square of its count.
3. A seed is extended to both sides along its lag. A table keeps, per lag, how far the text is covered, and
   seeds below that are skipped. A next occurrence has the smallest period of its stretch, so no run is
   found under a multiple of its period.

The work of a text is local to it: no shuffle, and memory of a task is bounded by one Arrow batch (64 MB)
and the largest text. Null and empty texts, or texts of blanks, have no words, no runs and the empty
collapsed text. Rows are taken one by one, so repeated rows give repeated results and ids do not matter;
an empty table gives no rows. A column with the name of the result is replaced, other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paylattice.llm.common import fresh, let, ship_package

POWER, SHORTEST = 4, 6


def _least_overlap(lag: int) -> int:
    return max(SHORTEST, POWER * lag) - lag


def _join(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose pair of names stands more than once, and the names of these pairs; -1 is no name."""
    at = np.flatnonzero((left >= 0) & (right >= 0))
    key = left[at] * (int(right.max(initial=0)) + 1) + right[at]
    _, name, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[name] > 1
    return at[again], name[again]


def _grams(names: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and names of the k-grams that stand more than once; adds levels to `names` as needed."""
    level = k.bit_length() - 1
    while len(names) <= level:
        half, last = 1 << (len(names) - 1), names[-1]
        n = max(len(last) - half, 0)
        at, name = _join(last[:n], last[half : half + n])
        above = np.full(n, -1, np.int64)
        above[at] = name
        names.append(above)
    top = names[level]
    n = max(len(top) - (k - (1 << level)), 0)
    return _join(top[:n], top[k - (1 << level) : k - (1 << level) + n])


def _reach(ids: np.ndarray, i: int, lag: int, step: int) -> int:
    """How many words from i on, in the direction of `step`, equal the word one lag to the right."""
    found, width = 0, 32
    while True:
        if step > 0:
            a = i + found
            b = min(a + width, len(ids) - lag)
            same = ids[a:b] == ids[a + lag : b + lag]
        else:
            b = i + 1 - found
            a = max(b - width, 0)
            same = (ids[a:b] == ids[a + lag : b + lag])[::-1]
        miss = np.flatnonzero(~same)
        if len(miss):
            return found + int(miss[0])
        found += len(same)
        if len(same) < width:
            return found
        width *= 2


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    out, names = [], [ids.astype(np.int64)]
    low = 1
    while max(SHORTEST, POWER * low) <= len(ids):
        k = _least_overlap(low)
        at, name = _grams(names, k)
        if not len(at):
            # longer seeds hold this one, so they stand only once as well
            break
        order = np.argsort(name, kind="stable")
        i, name = at[order], name[order]
        lag = np.where(name[1:] == name[:-1], i[1:] - i[:-1], 0)
        seeds = np.flatnonzero((lag >= low) & (lag < 2 * low))
        i, lag = i[seeds], lag[seeds]
        order = np.lexsort((i, lag))
        i, lag = i[order], lag[order]
        covered: dict[int, int] = {}
        n = 0
        while n < len(i):
            start, q = int(i[n]), int(lag[n])
            if start < covered.get(q, 0):
                # the next seed beyond what this lag has covered
                n += int(np.searchsorted(i[n : np.searchsorted(lag, q, "right")], covered[q]))
                continue
            left = _reach(ids, start - 1, q, -1) if start else 0
            right = start + k + _reach(ids, start + k, q, 1)
            covered[q] = right - k + 1
            length = right - (start - left) + q
            if length >= max(SHORTEST, POWER * q):
                out.append((start - left, length, q))
            n += 1
        low *= 2
    return sorted(out, key=lambda run: (run[0], run[2]))


_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
_FOUND = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _examine(body: bytes | None) -> tuple[int, list[tuple[int, int, int]], bytes]:
    words = (body or b"").split()  # bytes split at blanks and tab to carriage return only
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    runs = find_runs(ids)
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep)]
    return len(ids), runs, b" ".join(words)


def periodic_runs(docs: DataFrame, text: str = "text", out: str = "periodic") -> DataFrame:
    """All rows of `docs` and a struct column `out`: n_words, runs (start, length, period of each, in words,
    by start, then period) and collapsed, the text without repetitions: a word goes if a run holds it after
    its first period; the others are joined by one blank."""
    ship_package(docs.sparkSession)
    rest = [c for c in docs.columns if c.lower() != out.lower()]
    body, = fresh(docs, "body")
    schema = StructType(docs.select(rest).schema.fields).add(out, StructType.fromDDL(
        "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    ))

    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, runs, kept = [], [0], [], []
            for whole in batch.column(len(rest)).cast(pa.binary()):
                n, found, collapsed = _examine(whole.as_py())
                sizes.append(n)
                runs += found
                ends.append(len(runs))
                kept.append(collapsed)
            parts = [pa.array([r[c] for r in runs], pa.int64()) for c in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_RUN)))
            columns = [pa.array(sizes, pa.int64()), lists, pa.array(kept, pa.binary()).cast(pa.string())]
            found = pa.StructArray.from_arrays(columns, fields=list(_FOUND))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], found], names=[*rest, out])

    return docs.select(*rest, F.col(text).cast("string").alias(body)).mapInArrow(examine, schema)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the earlier, then the shorter period on ties."""

    def better(best: Column, run: Column) -> Column:
        # products of two word counts stay below 2^63
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start: long, length: long, period: long>"), better)


def repeat_words(words: Column, first: Column, period: Column) -> Column:
    """The words of a list with word i >= first replaced by word first + (i - first) % period."""
    at = F.sequence(F.lit(0).cast("long"), F.size(words).cast("long") - 1)
    source = lambda i: F.when(i < first, i).otherwise(first + (i - first) % period)
    return let(words, lambda w: F.transform(at, lambda i: F.get(w, source(i).cast("int"))))
