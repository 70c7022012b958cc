"""N-gram Jaccard join by chosen paths.

Documents are sets of five-word shingles; pairs with a Jaccard similarity of 0.8 or more are linked.

1. Equal sets form a class; one document stands for it.
2. Chosen paths: each run splits all sets by the value of a sampled shared token (a coordinate of a minhash
   embedding), one or two samples per node with 1 / 0.8 on average, drawn from the node's own hash. Buckets
   of up to `BUCKET` sets are compared by brute force on their sketches, larger ones split again. Runs are
   repeated until a pair at the threshold meets with the target recall. What is still large after the last
   level shares so many tokens that it goes on whole.
3. The connected parts of these candidates are small groups that hold every true link found. In each, all
   pairs are verified on the exact shingle sets, in cells of two blocks of bounded size, so a large group is
   spread over many tasks. A cell gives one row per set (number of links and a root), never the pairs.
4. Connected components of the verified links are the classes of the result.

Texts of fewer than five words are one shingle of all their words. Documents without words, with null text
or with a null doc_id link to nothing. Rows equal in doc_id and text are one document; rows that share only
the doc_id are documents of their own, told apart by their text. Sizes of tasks do not depend on how many
copies a text has. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylattice.llm.common import TEXT_ROWS, cut, fresh, ship_package
from paylattice.llm.components import connected_components

SHINGLE = 5
THRESHOLD = (4, 5)  # 0.8 as a fraction, so that comparisons are exact
HASHES = 128
BUCKET = 64
LEVELS = 4
RECALL = 0.99
# Sketches of a pair at the threshold agree on at least this many of 128 bytes but once in some thousand pairs.
_SKETCH_LEAST = 87
_BLOCK_ROWS, _BLOCK_BYTES = 1024, 4 << 20
# Shingles of a cell that are numbered at once, and bytes of sets in one batch; they bound a task's memory.
_AT_ONCE, _BATCH_BYTES = 1 << 18, 4 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[1]
    x = (x ^ (x >> np.uint64(29))) * _ODD[3]
    return x ^ (x >> np.uint64(32))


_FACTORS = _mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _ODD[0]) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted hashes of the five-word shingles of a text."""
    words = (text or "").encode().split()  # bytes split at blanks and tab to carriage return only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(h) - SHINGLE + 1
    mixed = np.zeros(n, np.uint64)
    for i, odd in enumerate(_ODD):
        mixed = (mixed ^ (mixed >> np.uint64(33))) * odd + h[i : i + n]
    return np.unique(_mix(mixed))


def minhash(values: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 2**64 - 1, np.uint64)
    for a in range(0, len(values), 2048):
        part = _FACTORS[:, None] * values[None, a : a + 2048]
        out = np.minimum(out, part.min(axis=1))
    return _mix(out).astype(np.uint32)


_SETS = pa.schema([
    ("doc", pa.int64()), ("th", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("hashes", pa.binary()), ("sketch", pa.binary()),
])


def _code(values: np.ndarray) -> tuple[int, int]:
    code = xxhash.xxh3_128_digest(values.tobytes())
    return int.from_bytes(code[:8], "little", signed=True), int.from_bytes(code[8:], "little", signed=True)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, th, text in zip(*batch.columns):
            s = shingles(text.as_py())
            if len(s):
                m = minhash(s)
                rows.append((doc.as_py(), th.as_py(), *_code(s), len(s), m.tobytes(), m.astype(np.uint8).tobytes()))
        for a in range(0, len(rows), 2000):
            yield _rows(rows[a : a + 2000], _SETS)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _children(path: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and next nodes: every row goes on by the tokens its node has sampled."""
    samples = [(np.arange(len(path)), _mix(path ^ _ODD[0]) % np.uint64(HASHES))]
    second = np.flatnonzero(_mix(path ^ _ODD[1]) < np.uint64(2**62))  # a quarter of the nodes sample twice
    samples.append((second, _mix(path[second] ^ _ODD[2]) % np.uint64(HASHES)))
    row = np.concatenate([s[0] for s in samples])
    coordinate = np.concatenate([s[1] for s in samples])
    token = hashes[row, coordinate.astype(np.int64)].astype(np.uint64)
    return row, _mix(_mix(path[row] ^ (coordinate + np.uint64(1)) * _ODD[4]) ^ token * _ODD[0])


def runs_for(recall: float = RECALL, levels: int = LEVELS) -> int:
    """Runs after which a pair at the threshold has met with the given probability."""
    meets = 1.0  # chance that a pair still shares a node, level by level
    for _ in range(levels):
        share = meets * THRESHOLD[0] / THRESHOLD[1]
        meets = 0.75 * share + 0.25 * (1 - (1 - share) ** 2)
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


_PATHS = pa.schema([("path", pa.int64()), ("rep", pa.int64())])


def _split(batches: Iterator[pa.RecordBatch], roots: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Nodes of the next level; `roots` are the runs' first nodes, else the node is the first column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rep = batch.column("rep").to_numpy()
        hashes = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint32).reshape(-1, HASHES)
        if roots is None:
            starts = [batch.column("path").to_numpy().view(np.uint64)]
        else:
            starts = [np.full(len(rep), r) for r in roots]
        for start in starts:
            row, path = _children(start, hashes)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(rep[row])], schema=_PATHS)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Brute force inside small buckets; rows come sorted by path. Gives a star per group of alike sketches."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        new = [
            batch.column("path").to_numpy(), batch.column("rep").to_numpy(),
            np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES),
        ]
        now = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        if not len(now[0]):
            continue
        whole = int(np.searchsorted(np.cumsum(np.r_[False, now[0][1:] != now[0][:-1]]), (now[0][1:] != now[0][:-1]).sum()))
        held = [x[whole:] for x in now]  # the last bucket may go on in the next batch
        yield _stars(*(x[:whole] for x in now))
    if held is not None:
        yield _stars(*held)


def _stars(path: np.ndarray, rep: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
    left, right = [], []
    for shift in range(1, BUCKET):
        i = np.flatnonzero(path[:-shift] == path[shift:]) if shift < len(path) else np.empty(0, np.int64)
        if not len(i):
            break
        for part in np.array_split(i, -(-len(i) // 20_000)):
            alike = (sketch[part] == sketch[part + shift]).sum(axis=1) >= _SKETCH_LEAST
            left.append(part[alike])
            right.append(part[alike] + shift)
    if not left:
        return _rows([], _EDGES)
    a, b = np.concatenate(left), np.concatenate(right)
    label = np.arange(len(path))
    while True:
        least = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        if (old == label).all():
            break
    moved = np.flatnonzero(label != np.arange(len(path)))
    return pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[label[moved]])], schema=_EDGES)


def _candidates(classes: DataFrame, recall: float) -> DataFrame:
    """Edges whose connected parts hold all pairs that met."""
    roots = _mix(np.arange(1, runs_for(recall) + 1, dtype=np.uint64) * _ODD[2])
    frontier = cut(classes.select("rep", "hashes").mapInArrow(lambda b: _split(b, roots), "path long, rep long"), "paths")
    small, edges = [], []
    for level in range(1, LEVELS + 1):
        counts = frontier.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        sized = cut(frontier.join(counts, "path"), "paths")
        small.append(sized.filter(F.col("size") <= BUCKET).select("path", "rep"))
        large = sized.filter(F.col("size") > BUCKET).select("path", "rep")
        if level == LEVELS:
            least = large.groupBy("path").agg(F.min("rep").alias("b"))
            edges.append(large.join(least, "path").select(F.col("rep").alias("a"), "b").filter("a <> b"))
        elif large.isEmpty():
            break
        else:
            frontier = cut(
                large.join(classes.select("rep", "hashes"), "rep").mapInArrow(
                    lambda b: _split(b, None), "path long, rep long"
                ),
                "paths",
            )
    buckets = small[0]
    for more in small[1:]:
        buckets = buckets.unionByName(more)
    compared = (
        buckets.join(classes.select("rep", "sketch"), "rep").select("path", "rep", "sketch")
        .repartition("path").sortWithinPartitions("path", "rep").mapInArrow(_compare, "a long, b long")
    )
    for more in edges:
        compared = compared.unionByName(more)
    return compared.distinct()


_MEMBERS = pa.schema([
    ("part", pa.int64()), ("rep", pa.int64()), ("copies", pa.int64()), ("blocks", pa.int64()), ("block", pa.int64()), ("set", pa.binary()),
])


def _member_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets of representatives; a row that has only the id of one, and another text, is left out."""
    for batch in batches:
        rows, size = [], 0
        for *rest, h1, h2, text in zip(*batch.columns):
            values = shingles(text.as_py())
            if _code(values) == (h1.as_py(), h2.as_py()):
                rows.append((*(x.as_py() for x in rest), values.tobytes()))
                size += values.nbytes
            if size > _BATCH_BYTES:
                yield _rows(rows, _MEMBERS)
                rows, size = [], 0
        yield _rows(rows, _MEMBERS)


_LINKS = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("partners", pa.int64()), ("root", pa.int64())])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links inside each cell; rows come sorted by cell."""
    cell, held, out = None, [], []
    for batch in batches:
        for part, low, high, *member in zip(*(c.to_pylist() for c in batch.columns)):
            if (part, low, high) != cell:
                out += _links(held, cell)
                cell, held = (part, low, high), []
            if not held or held[-1][0] != member[0]:  # a repeated row of the representative
                held.append(member)
        if len(out) > 5000:
            yield _rows(out, _LINKS)
            out = []
    yield _rows(out + _links(held, cell), _LINKS)


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = times > 1  # values of one set only add nothing
    number = np.cumsum(twice) - 1
    pick = twice[column]
    owner, column = owner[pick], number[column[pick]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), dtype=np.float32)
    step = 1024
    for a in range(0, int(twice.sum()), step):
        x, y = np.searchsorted(column, [a, a + step])
        there = np.zeros((len(sets), step), dtype=np.float32)
        there[owner[x:y], column[x:y] - a] = 1
        common += there @ there.T
    return common


def _links(members: list[list], cell: tuple | None) -> list[tuple]:
    """(rep, linked sets, linked documents, root) of each linked member of a cell; members: rep, copies, block, set."""
    if len(members) < 2:
        return []
    rep, copies, block = (np.array([m[i] for m in members], dtype=np.int64) for i in range(3))
    sets = [np.frombuffer(m[3], np.uint64) for m in members]
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = np.zeros((2, 2))
        common[0, 1] = common[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        common = np.zeros((len(sets), len(sets)), dtype=np.float32)
        at = np.zeros(len(sets), np.int64)
        parts = -(-int(sizes.sum()) // _AT_ONCE)
        for part in range(1, parts + 1):  # shingles are hashes, so ranges of them are of like size
            last = np.uint64(part * (2**64 // parts)) if part < parts else None
            to = sizes if last is None else np.array([np.searchsorted(x, last) for x in sets])
            common += _shared([x[i:j] for x, i, j in zip(sets, at, to)])
            at = to
    over, under = THRESHOLD
    linked = (over + under) * common >= over * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(linked, False)
    if cell[1] != cell[2]:
        linked &= block[:, None] != block[None, :]  # pairs inside a block belong to another cell
    some = np.flatnonzero(linked.any(axis=1))
    label = np.arange(len(sets))
    while len(some):
        least = np.where(linked[some], label[None, :], len(sets)).min(axis=1)
        new = label.copy()
        new[some] = np.minimum(label[some], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [
        (int(rep[i]), int(linked[i].sum()), int(copies[linked[i]].sum()), int(rep[label[i]])) for i in some
    ]


def _classified(docs: DataFrame, text: str, recall: float) -> DataFrame:
    """doc, th (hash of the text), class_id, first_th (of the text that stands for the class), n_links and
    n_text_links of every document that has words and an id."""
    ship_package(docs.sparkSession)
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.col(text).cast("string")).alias("th"),
        F.col(text).cast("string").alias("text"),
    )
    sets = cut(
        plain.filter("doc is not null").mapInArrow(
            _sets, "doc long, th long, h1 long, h2 long, n long, hashes binary, sketch binary"
        ),
        "sets", batch_rows=TEXT_ROWS,
    )
    # classes are numbered as they are written: a document's id does not tell its texts apart
    classes = cut(
        sets.groupBy("h1", "h2")
        .agg(F.min(F.struct("doc", "th")).alias("first"), F.count_distinct("doc", "th").alias("copies"))
        .select("h1", "h2", "first.doc", "first.th", "copies", F.monotonically_increasing_id().alias("rep")),
        "classes",
    )
    stand = cut(
        sets.join(classes, ["doc", "th", "h1", "h2"]).select("rep", "doc", "h1", "h2", "n", "copies", "hashes", "sketch")
        .dropDuplicates(["rep"]),
        "stand",
    )
    loose = connected_components(_candidates(stand, recall))

    weights = loose.join(stand.select("rep", "doc", "h1", "h2", "n", "copies"), loose["node"] == stand["rep"])
    blocks = weights.groupBy("component").agg(
        F.greatest(
            F.ceil(F.count(F.lit(1)) / _BLOCK_ROWS), F.ceil(F.sum("n") * 8 / _BLOCK_BYTES)
        ).cast("long").alias("blocks")
    )
    members = weights.join(blocks, "component").select(
        F.col("component").alias("part"), "rep", "copies", "blocks",
        F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"), "h1", "h2", F.col("doc").alias("first"),
    )
    cells = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1),
        lambda q: F.struct(F.least(q, "block").alias("low"), F.greatest(q, "block").alias("high")),
    )
    dealt = (
        plain.join(members.hint("merge"), F.col("doc") == F.col("first"))
        .select("part", "rep", "copies", "blocks", "block", "h1", "h2", "text")
        .mapInArrow(_member_sets, "part long, rep long, copies long, blocks long, block long, set binary")
        .select("part", F.explode(cells).alias("cell"), "rep", "copies", "block", "set")
        .select("part", "cell.low", "cell.high", "rep", "copies", "block", "set")
        .repartition("part", "low", "high")
        .sortWithinPartitions("part", "low", "high", "rep")
    )
    links = cut(dealt.mapInArrow(_verify, "rep long, links long, partners long, root long"), "links", batch_rows=TEXT_ROWS)
    counted = links.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("partners").alias("partners"))
    grouped = connected_components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    joined = classes.join(counted, "rep", "left").join(grouped.withColumnRenamed("node", "rep"), "rep", "left")
    joined = cut(joined.withColumn("component", F.coalesce("component", "rep")), "joined")
    named = joined.groupBy("component").agg(F.min(F.struct("doc", "th")).alias("named"))
    known = cut(
        joined.join(named, "component").select(
            "h1", "h2", F.col("named.doc").alias("class_id"), F.col("named.th").alias("first_th"),
            (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("links", F.lit(0)).alias("n_text_links"),
        ),
        "known",
    )
    return sets.select("doc", "th", "h1", "h2").distinct().join(known, ["h1", "h2"]).drop("h1", "h2")


def near_duplicates(docs: DataFrame, text: str = "text", recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links, n_text_links: one row per row of `docs`.

    `class_id` is the smallest doc_id of the connected group. `n_links` counts the other documents with a
    similarity of 0.8 or more, copies included; `n_text_links` counts different sets of shingles among them.
    """
    found = _classified(docs, text, recall)
    zero = F.lit(0).cast("long")
    rows = docs.select("doc_id", F.xxhash64(F.col(text).cast("string")).alias("row_th"))
    return rows.join(found, (F.col("doc_id") == F.col("doc")) & (F.col("row_th") == F.col("th")), "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", zero).alias("n_links"),
        F.coalesce("n_text_links", zero).alias("n_text_links"),
    )


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """One document of each class, the one with the smallest id (then hash of the text), and every row without
    words or without an id. Of rows equal in id and text one stays, in the columns of any of them."""
    found = cut(_classified(docs, text, RECALL), "found")
    key, other_id, other_th = fresh(docs, "th", "other_id", "other_th")
    hashed = docs.withColumn(key, F.xxhash64(F.col(text).cast("string")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_th))
    named = lambda rows: rows.select(F.col("doc").alias(other_id), F.col("th").alias(other_th))
    kept = hashed.join(named(found.filter("doc <> class_id or th <> first_th")).hint("merge"), same, "left_anti")
    # few documents stand in several rows; only the texts of those are grouped once more
    repeated = cut(
        hashed.select("doc_id", key).join(named(found), same).groupBy(other_id, other_th)
        .agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(other_id, other_th),
        "repeated",
    )
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(repeated.hint("merge"), same, "left_anti")
    more = kept.join(repeated.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", key])
    return once.unionByName(more).select(*docs.columns)
