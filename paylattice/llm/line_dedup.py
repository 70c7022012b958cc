"""Removal of repeated passages of lines, found by content-defined chunks.

Boundaries: a window of two neighbouring lines rolls over the hashes of the lines, and the line with the lower
hash is a boundary. So every two neighbouring lines hold a boundary, and whether they do depends on these
two lines only: a passage has the same boundaries inside wherever it stands. Lines without a word rank last and
are no boundaries as long as a line with a word is beside them.

`remove_repeated_lines` takes the boundaries that occur more than once in the corpus and grows them: with the
line before or after to a chunk of two lines, over a longer wordless gap to a chunk that ends at the next line
with a word. Chunks that occur more than once are removed except for their first occurrence (smallest doc_id,
then place in the document; null ids last), after their bytes have been compared. Neighbouring chunks overlap in
their boundaries, so a passage of two lines or more goes whole: a line with a word goes exactly if it
lies in two or more lines that stood together earlier. The first occurrence of a line always stays, and an
occurrence that overlaps the first one in the same text does not count as another.

`remove_repeated_chunks` cuts longer chunks, which do not overlap, by a rolling hash over the last lines, and
removes those of two lines or more that are repeated as a whole; it keeps the edges of passages.

Only hashes and places are shuffled for counting; texts move for documents with repeated chunks. A hash that
stands for different bytes is left alone. Single lines and chunks without a word stay.
Null texts stay null and empty texts stay empty. Rows equal in doc_id and text count as one document, so
they keep or lose the same lines; rows that share only the id are told apart by their text. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylattice.llm.common import TEXT_ROWS, cut, fresh, let, ship_package

WINDOW = 2  # lines under the rolling hash
MEAN = 2  # a line ends a chunk with probability 1 / MEAN, once the chunk is long enough
SHORTEST, LONGEST = 2, 64  # lines of a chunk
HOT_SHARE = 1000  # a boundary is frequent if it makes up more than 1 / HOT_SHARE of the repeated ones
_BLANKS = " \t\n\x0b\x0c\r"
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def chunk_lines(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, number of lines) of the chunks of a text."""
    out, first, rolled = [], 0, [0] * WINDOW
    power = pow(_BASE, WINDOW, 1 << 64)
    state = 0
    for i, line in enumerate(lines):
        code = xxhash.xxh3_64_intdigest(line)
        state = (state * _BASE + code - rolled[i % WINDOW] * power) & _MASK
        rolled[i % WINDOW] = code
        n = i + 1 - first
        if n >= LONGEST or (n >= SHORTEST and (state >> 33) % MEAN == 0):
            out.append((first, n))
            first = i + 1
    if first < len(lines):
        out.append((first, len(lines) - first))
    return out


# A boundary's text, and the chunks that hold it: first line, number of lines, text.
Seed = tuple[str, list[tuple[int, int, str]]]


def _chunks(text: str) -> Iterator[Seed]:
    """Chunks that do not overlap; each is its own seed."""
    lines = text.split("\n")
    if len(lines) > 1:
        for first, n in chunk_lines(lines):
            chunk = "\n".join(lines[first : first + n])
            if n > 1 and chunk.strip(_BLANKS):
                yield chunk, [(first, n, chunk)]


def boundary_chunks(lines: list[str]) -> dict[int, list[tuple[int, int]]]:
    """Boundary lines of a text, each with the chunks (first line, number of lines) it grows to."""
    ranks = [(0, xxhash.xxh3_64_intdigest(line)) if line.strip(_BLANKS) else (1, 0) for line in lines]
    grown: dict[int, list[tuple[int, int]]] = {}

    def grow(a: int, b: int) -> None:
        grown.setdefault(a if ranks[a] <= ranks[b] else b, []).append((a, b + 1 - a))

    last = None  # the latest line with a word
    for i in range(len(lines)):
        wordy = not ranks[i][0]
        if i and (wordy or last == i - 1):
            grow(i - 1, i)
        if wordy:
            # chunks of two lines reach one line into a gap from either side
            if last is not None and i - last > 3:
                grow(last, i)
            last = i
    return grown


def _grown(text: str) -> Iterator[Seed]:
    """The boundaries of a text with their chunks."""
    lines = text.split("\n")
    for boundary, spans in boundary_chunks(lines).items():
        yield lines[boundary], [(first, n, "\n".join(lines[first : first + n])) for first, n in spans]


def _code(chunk: str) -> tuple[int, int]:
    code = xxhash.xxh3_128_digest(chunk)
    return int.from_bytes(code[:8], "little", signed=True), int.from_bytes(code[8:], "little", signed=True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def remove_repeated_chunks(docs: DataFrame, text: str = "text", out: str = "line_dedup") -> DataFrame:
    """All rows of `docs` with repeated chunks taken out of the text, and a struct column `out`: lines and
    removed_lines of each row. A column of that name is replaced."""
    return _remove_repeated(docs, _chunks, text, out)


def remove_repeated_lines(docs: DataFrame, text: str = "text", out: str = "line_dedup") -> DataFrame:
    """Like `remove_repeated_chunks`, for every repeated passage of two lines or more."""
    return _remove_repeated(docs, _grown, text, out)


def _remove_repeated(docs: DataFrame, seeds: Callable[[str], Iterator[Seed]], text: str, out: str) -> DataFrame:
    spark = docs.sparkSession
    ship_package(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    span = pa.struct([(c, pa.int64()) for c in ("first", "n", "h1", "h2")])
    found = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("seed", pa.int64()), ("grown", pa.list_(span))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, th, body in zip(*batch.columns):
                doc, th = doc.as_py(), th.as_py()
                for seed, spans in seeds(body.as_py() or ""):
                    grown = [dict(zip(("first", "n", "h1", "h2"), (first, n, *_code(chunk)))) for first, n, chunk in spans]
                    rows.append((doc, th, _code(seed)[0], grown))
                if len(rows) > 10_000:
                    yield _batch(rows, found)
                    rows = []
            yield _batch(rows, found)

    spans = "array<struct<first: long, n: long, h1: long, h2: long>>"
    seeded = cut(keyed.mapInArrow(find, f"id long, th long, seed long, grown {spans}"), batch_rows=TEXT_ROWS)
    # only boundaries that stand elsewhere too are grown; the frequent ones are known without a shuffle of their places
    met = cut(seeded.groupBy("seed").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"))
    total = met.agg(F.sum("times")).first()[0] or 0
    hot = F.broadcast(met.filter(F.col("times") * HOT_SHARE > total).select("seed"))  # fewer than HOT_SHARE rows
    rare = seeded.join(hot, "seed", "left_anti").join(met.select("seed"), "seed")
    chunks = cut(seeded.join(hot, "seed", "left_semi").unionByName(rare).select("id", "th", F.inline("grown")))
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "th", "first")
    repeated = (
        chunks.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("keeper")).filter("times > 1")
    )
    overlaps = (
        F.col("id").eqNullSafe(F.col("keeper.id"))
        & (F.col("th") == F.col("keeper.th"))
        & (F.col("first") < F.col("keeper.first") + F.col("n"))
    )
    hits = cut(
        chunks.join(repeated, ["h1", "h2"]).select("id", "th", "first", "n", "h1", "h2", (~overlaps).alias("later"))
    )

    # bytes of every occurrence of a repeated hash
    per_row = hits.groupBy("id", "th").agg(F.sort_array(F.collect_set(F.struct("first", "n", "h1", "h2"))).alias("spans"))
    touched = keyed.join(per_row.hint("merge"), keyed["id"].eqNullSafe(per_row["id"]) & (keyed["th"] == per_row["th"])).select(
        "text", "spans"
    )
    bodies = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("chunk", pa.string())])

    def lift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for body, spans in zip(*batch.columns):
                lines = body.as_py().split("\n")
                for s in spans.as_py():
                    chunk = "\n".join(lines[s["first"] : s["first"] + s["n"]])
                    found[s["h1"], s["h2"], chunk] = None  # copies within the batch once
            yield _batch(list(found), bodies)

    unequal = (
        touched.mapInArrow(lift, "h1 long, h2 long, chunk string")
        .groupBy("h1", "h2")
        .agg(F.min("chunk").alias("a"), F.max("chunk").alias("b"))
        .filter("a <> b")
        .select("h1", "h2")
    )
    doomed = cut(
        hits.filter("later")
        .join(cut(unequal, batch_rows=TEXT_ROWS), ["h1", "h2"], "left_anti")
        .groupBy("id", "th")
        .agg(F.sort_array(F.collect_set(F.struct("first", "n"))).alias("spans"))
    )

    th, lost = fresh(docs, "th", "lost")
    named = docs.withColumn(th, F.xxhash64(text))
    gone = doomed.select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("spans").alias(lost))
    joined = named.join(gone.hint("merge"), named["doc_id"].eqNullSafe(gone["_id"]) & (named[th] == gone["_th"]), "left")
    n_lost = F.coalesce(_covered(F.col(lost)), F.lit(0))
    kept = F.when(F.col(lost).isNull(), F.col(text)).otherwise(_without(F.col(text), F.col(lost)))
    return joined.select(
        *[kept.alias(c) if c == text else named[c] for c in docs.columns if c.lower() != out.lower()],
        F.struct(_line_count(F.col(text)).alias("lines"), n_lost.cast("long").alias("removed_lines")).alias(out),
    )


def _covered(spans: Column) -> Column:
    """Lines in sorted spans that may overlap."""
    zero = F.lit(0).cast("long")

    def add(acc: Column, s: Column) -> Column:
        end = s["first"] + s["n"]
        more = F.greatest(zero, end - F.greatest(s["first"], acc["end"]))
        return F.struct((acc["total"] + more).alias("total"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(spans, F.struct(zero.alias("total"), zero.alias("end")), add, lambda acc: acc["total"])


def _line_count(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")


def _without(text: Column, spans: Column) -> Column:
    """The text without the lines of sorted spans, which may overlap."""
    zero = F.lit(0).cast("long")

    def gap(acc: Column, s: Column) -> Column:
        between = F.array(F.struct(acc["at"].alias("first"), (s["first"] - acc["at"]).alias("n")))
        return F.struct(
            F.greatest(acc["at"], s["first"] + s["n"]).alias("at"),
            F.when(s["first"] > acc["at"], F.concat(acc["gaps"], between)).otherwise(acc["gaps"]).alias("gaps"),
        )

    none = F.array().cast("array<struct<first: long, n: long>>")
    start = F.struct(zero.alias("at"), none.alias("gaps"))

    def kept(lines: Column) -> Column:
        end = F.struct((F.size(lines).cast("long")).alias("first"), zero.alias("n"))
        gaps = F.aggregate(F.concat(spans, F.array(end)), start, gap, lambda acc: acc["gaps"])
        parts = F.transform(gaps, lambda g: F.slice(lines, (g["first"] + 1).cast("int"), g["n"].cast("int")))
        return F.array_join(F.flatten(parts), "\n")

    return let(F.split(text, "\n"), kept)
