"""Exact removal of repeated byte strings with suffix arrays.

A byte goes when a string of `LENGTH` bytes that covers it also starts in a document with a smaller doc_id.

0. Texts are cut at content-defined places into chunks of windows, about CHUNK each. A chunk whose bytes
   (told apart by 128-bit hashes) are also a chunk of a smaller document is settled: all its windows go. This
   leaves of a group of copies little more than the first. Settled windows need no further part: the
   smallest document that holds a window never has it settled.
1. Every other window of LENGTH bytes is represented by its minimizer: the GRAM-byte substring with the smallest
   hash. Equal windows have equal minimizers, so only minimizers that occur in more than one place can
   belong to repeated windows. They are found by a shuffle of hashes, about one per 16 bytes of text.
2. The windows of one minimizer stand in a row in the text, as one short segment. Segments are shuffled by
   the minimizer's hash, so all equal windows of the corpus meet in one task.
3. There a suffix array of the segments is built by two-stage sorting: suffixes smaller than their
   successors are sorted directly, the others are induced by scanning the buckets in order. Adjacent
   common prefixes of LENGTH bytes and more then group equal windows, and the smallest doc_id of each
   group decides.

Hot strings: a batch sends equal segments once and settles the rest itself, so a string in a third of all
documents reaches a task once per batch. Minimizers with very many occurrences in different surroundings
are dealt window by window instead, by a hash of the window, so no task gets all of them. The list of those
has at most 1 / `HOT_SHARE` entries.

Null texts count as empty. Rows with a null doc_id are left as they are and count for no other row. Rows
that share a doc_id are not removed by each other. Texts shorter than LENGTH stay. An empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylattice.llm.common import cut, fresh, partitions_for, ship_package, total_text_bytes

LENGTH = 50
GRAM = 20
REACH = LENGTH - GRAM  # a window that starts at p holds the grams that start at p .. p + REACH
_BESIDE = REACH // 2
CHUNK = 256
HOT_ROWS = 2048
HOT_SHARE = 1e-5
_SLICE = 1 << 20
_TASK_BYTES = 8 << 20  # of text to a partition; sorting its segments takes some hundred bytes for each of theirs
_PORTION = 6 << 20  # bytes of text that a task works on at once
_TOP = np.uint64(2**64 - 1)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _words(data: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The 8 bytes from every place on, as numbers; one entry per place with 8 bytes left."""
    n = len(data) - 7
    out = np.empty(max(0, n), dtype=np.uint64)
    raw = data.tobytes()
    for r in range(min(8, max(0, n))):
        count = (len(raw) - r) // 8
        out[r::8] = np.frombuffer(raw, dtype=order, count=count, offset=r)
    return out


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over `width` neighbours from every place on."""
    done, out = 1, values
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return pick(out[:-rest], out[rest:]) if rest else out


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the gram from every place on; never 0."""
    w = _words(data)
    n = len(data) - GRAM + 1
    h = w[:n] * _MIX[0] + w[8 : 8 + n] * _MIX[1] + w[GRAM - 8 : GRAM - 8 + n] * _MIX[2]
    h ^= h >> np.uint64(32)
    h *= _MIX[3]
    h ^= h >> np.uint64(29)
    return h | np.uint64(1)


def minimizers(
    data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, skip: list[tuple[int, int]] = ()
) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the minimizers of all windows inside the texts at `starts` of `data`.

    `skip` lists half-open runs of windows that need none.
    """
    if len(data) < LENGTH:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = _hashes(data)
    low = _slide(h, REACH + 1, np.minimum)  # one per window of data
    inside = np.zeros(len(low) + 1, dtype=np.int8)
    ok = sizes >= LENGTH
    np.add.at(inside, starts[ok], 1)
    np.add.at(inside, starts[ok] + sizes[ok] - LENGTH + 1, -1)
    low[np.cumsum(inside[:-1]) == 0] = 0
    for a, b in skip:
        low[a:b] = 0
    # a gram is chosen if it is the smallest of some window that holds it
    padded = np.zeros(len(low) + 2 * REACH, dtype=np.uint64)
    padded[REACH : REACH + len(low)] = low
    places = np.flatnonzero(_slide(padded, REACH + 1, np.maximum)[: len(h)] == h)
    return places, h[places]


def _slices(ids: list, bodies: list[bytes], settled: list | None = None) -> Iterator[tuple]:
    """Texts joined to arrays of about one megabyte: data, starts, sizes, row numbers, offsets in the text and
    the settled runs of windows."""
    parts, size = [], 0
    for row, body in enumerate(bodies):
        if ids[row] is None or len(body) < LENGTH:
            continue
        done = _merged([(r["start"], r["start"] + r["windows"]) for r in settled[row] or []]) if settled else []
        if done and done[0] == (0, len(body) - LENGTH + 1):
            continue
        for at in range(0, len(body) - LENGTH + 1, _SLICE):  # long texts overlap by a window less one byte
            part = body[at : at + _SLICE + LENGTH - 1]
            parts.append((row, at, part, done))
            size += len(part)
            if size >= _SLICE:
                yield _joined(parts)
                parts, size = [], 0
    if parts:
        yield _joined(parts)


def _joined(parts: list[tuple[int, int, bytes, list]]) -> tuple:
    sizes = np.array([len(p[2]) for p in parts])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint8)
    skip = []
    for start, (_, at, part, done) in zip(starts.tolist(), parts):
        for a, b in done:
            a, b = max(a - at, 0), min(b - at, len(part) - LENGTH + 1)
            if a < b:
                skip.append((start + a, start + b))
    return data, starts, sizes, np.array([p[0] for p in parts]), np.array([p[1] for p in parts]), skip


_CHUNKS = pa.schema([(c, pa.int64()) for c in ("h1", "h2", "doc", "th", "start", "windows")])


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content-defined runs of windows with the hash of all bytes under them."""
    limit = np.uint64(2**64 // CHUNK)
    for batch in _portions(batches):
        ids, ths, texts = (c.to_pylist() for c in batch.columns)
        bodies = [(t or "").encode() for t in texts]
        bounds: dict[int, list[int]] = {}
        for data, starts, sizes, rows, offsets, _ in _slices(ids, bodies):
            at = np.flatnonzero(_hashes(data) < limit)
            part = np.searchsorted(starts, at, side="right") - 1
            place = at - starts[part]
            ok = place <= sizes[part] - LENGTH
            for row, p in zip(rows[part[ok]].tolist(), (place + offsets[part])[ok].tolist()):
                bounds.setdefault(row, []).append(p)
        out = []
        for row, body in enumerate(bodies):
            if ids[row] is None or len(body) < LENGTH:
                continue
            edges = [0, *(p for p in bounds.get(row, []) if p), len(body) - LENGTH + 1]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    code = xxhash.xxh3_128_digest(body[a : b + LENGTH - 1])
                    out.append((
                        int.from_bytes(code[:8], "little", signed=True), int.from_bytes(code[8:], "little", signed=True),
                        ids[row], ths[row], a, b - a,
                    ))
        yield _rows(out, _CHUNKS)


def _portions(batches: Iterator[pa.RecordBatch], size: int = _PORTION) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about `size` bytes or a single row."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size / max(1, batch.nbytes)))
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


_SPOTS = pa.schema([("key", pa.int64()), ("hash", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64())])
# tag = place * 4 + kind
_OPEN, _KNOWN, _SETTLED = 0, 1, 2  # to be matched; repeated, and matched with others; repeated, passed on only


def _spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Minimizers of every text. Hashes that several documents of the batch share are known to be repeated."""
    for batch in _portions(batches):
        ids = batch.column(0).to_pylist()
        bodies = [(t or "").encode() for t in batch.column(1).to_pylist()]
        hashes, docs, places = [], [], []
        for data, starts, sizes, rows, offsets, skip in _slices(ids, bodies, batch.column(2).to_pylist()):
            at, h = minimizers(data, starts, sizes, skip)
            part = np.searchsorted(starts, at, side="right") - 1
            hashes.append(h)
            docs.append(np.array([ids[r] for r in rows], dtype=np.int64)[part])
            places.append(at - starts[part] + offsets[part])
        if not hashes:
            continue
        h, doc, place = (np.concatenate(x) for x in (hashes, docs, places))
        order = np.lexsort((doc, h))
        h, doc, place = h[order], doc[order], place[order]
        first = np.r_[True, h[1:] != h[:-1]]
        group = np.cumsum(first) - 1
        head = np.flatnonzero(first)
        tail = np.r_[head[1:], len(h)] - 1
        shared = doc[head] != doc[tail]
        kind = np.where(~shared[group], _OPEN, np.where(first, _KNOWN, _SETTLED))
        signed = h.view(np.int64)
        key = np.where(kind == _SETTLED, doc * 1_000_003 + place, signed)
        columns = (key, signed, doc, place * 4 + kind)
        for a in range(0, len(key), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 50_000]) for x in columns], schema=_SPOTS)


_REPEATED = pa.schema([("doc", pa.int64()), ("place", pa.int64()), ("hash", pa.int64())])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of one partition, those whose hash is repeated."""
    held = []
    for batch in batches:
        h, doc, tag = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        kind = tag & 3
        passed = kind != _OPEN
        if passed.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[passed]) for x in (doc, tag >> 2, h)], schema=_REPEATED)
        meets = kind != _SETTLED
        held.append((h[meets], doc[meets], tag[meets]))
    if not held:
        return
    h, doc, tag = (np.concatenate(x) for x in zip(*held))
    del held
    order = np.lexsort((doc, h))
    h, doc, tag = h[order], doc[order], tag[order]
    head = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    tail = np.r_[head[1:], len(h)] - 1
    twin = np.repeat(doc[head] != doc[tail], tail - head + 1)  # repetitions inside a document do not count
    pick = np.flatnonzero(twin & ((tag & 3) == _OPEN))
    for a in range(0, len(pick), 100_000):
        p = pick[a : a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[p], tag[p] >> 2, h[p])], schema=_REPEATED)


def segments(
    places: np.ndarray, hashes: np.ndarray, low: np.ndarray, high: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of every place that owns windows, and the place's index.

    `places` is sorted; windows from `low` to `high` (per place) exist. A window belongs to the place with
    the smallest hash among those it holds, the leftmost if several have it. Texts stand more than a window
    apart.
    """
    before = np.full(len(places), -1)  # nearest place to the left with a hash as small
    after = np.full(len(places), np.iinfo(np.int64).max // 2)  # nearest to the right with a smaller one
    for d in range(1, len(places)):
        near = places[d:] - places[:-d] <= REACH
        if not near.any():
            break
        left = near & (hashes[:-d] <= hashes[d:])
        before[d:] = np.where(left, np.maximum(before[d:], places[:-d]), before[d:])
        right = near & (hashes[d:] < hashes[:-d])
        after[:-d] = np.where(right, np.minimum(after[:-d], places[d:]), after[:-d])
    first = np.maximum(np.maximum(places - REACH, before + 1), low)
    last = np.minimum(np.minimum(places, after - REACH - 1), high)
    own = np.flatnonzero(first <= last)
    return first[own], last[own], own


_SEGMENTS = pa.schema([
    ("key", pa.int64()), ("segment", pa.binary()), ("doc", pa.int64()), ("th", pa.int64()), ("start", pa.int64()),
    ("windows", pa.int64()), ("at", pa.int64()),
])
_PIECES = 16_384  # pieces copied at once
_GAP = b"\xff" * 64  # in no UTF-8 text; keeps texts more than a window apart


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all spans one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _pieces(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    body = np.empty(int(offsets[-1]), np.uint8)
    for a in range(0, len(starts), _PIECES):  # the place of every byte is a number of eight
        b = min(a + _PIECES, len(starts))
        body[offsets[a] : offsets[b]] = data[_spans(starts[a:b], sizes[a:b])]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(body)])


def _grouped(key: np.ndarray, pieces: pa.BinaryArray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.BinaryArray, np.ndarray]:
    """Order by (piece, key, doc), first row of each group of equal piece and key, the pieces, and each row's piece."""
    coded = pieces.dictionary_encode()
    index = coded.indices.to_numpy().astype(np.int64)
    order = np.lexsort((doc, key, index))
    k, i = key[order], index[order]
    heads = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1])]) if len(order) else order
    return order, heads, coded.dictionary, index


def _mixed(words: np.ndarray, at: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """Hash of the bytes under the words at the given offsets from each place."""
    h = np.zeros(len(at), np.uint64)
    for n, offset in enumerate(offsets):
        h = (h ^ (h >> np.uint64(31))) * _MIX[n % 4] + words[at + offset]
    h ^= h >> np.uint64(32)
    h *= _MIX[3]
    return h ^ (h >> np.uint64(29))


def _segment_rows(batches: Iterator[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Segments to be matched; equal ones of the batch once, for the smallest document. The others are settled."""
    for batch in _portions(batches):
        bodies = [t.encode() for t in batch.column("text").to_pylist()]
        sizes = np.array([len(x) for x in bodies])
        data = np.frombuffer(_GAP.join(bodies) + _GAP, np.uint8)
        base = np.cumsum(sizes + len(_GAP)) - sizes - len(_GAP)
        spots = batch.column("spots")
        counts = np.asarray(spots.value_lengths())
        flat = spots.flatten()
        place, h = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("place", "hash"))
        row = np.repeat(np.arange(len(bodies)), counts)
        inside = place + GRAM <= sizes[row]  # rows that share an id may be of different length
        place, h, row = place[inside] + base[row[inside]], h[inside], row[inside]
        first, last, own = segments(place, h.view(np.uint64), base[row], base[row] + sizes[row] - LENGTH)
        key, at, row = h[own], place[own] - first, row[own]
        windows = last - first + 1
        hotter = np.isin(key, hot)
        if hotter.any():  # each window of a hot minimizer on its own
            each = _spans(first[hotter], windows[hotter])
            code = _mixed(_words(data), each, (0, 8, 16, 24, 32, 40, LENGTH - 8)).view(np.int64)
            cold = ~hotter
            row = np.r_[row[cold], np.repeat(row[hotter], windows[hotter])]
            key, first, at = np.r_[key[cold], code], np.r_[first[cold], each], np.r_[at[cold], np.full(len(each), _BESIDE)]
            windows = np.r_[windows[cold], np.ones(len(each), np.int64)]
        if not len(key):
            continue
        doc, th = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("doc", "th"))
        start = first - base[row]
        pieces = _pieces(data, first, windows + LENGTH - 1)
        order, heads, _, _ = _grouped(key, pieces, doc)
        least = np.repeat(doc[order][heads], np.diff(np.r_[heads, len(order)]))
        sent, done = order[doc[order] == least], order[doc[order] > least]
        for a in range(0, len(sent), 20_000):
            i = sent[a : a + 20_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[i]), pieces.take(pa.array(i)), *(pa.array(x[i]) for x in (doc, th, start, windows, at))],
                schema=_SEGMENTS,
            )
        done = done[np.lexsort((start[done], row[done]))]
        if len(done):
            d, t, s, w, r = (x[done] for x in (doc, th, start, windows, row))
            heads = np.flatnonzero(np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1] + w[:-1])])  # runs that touch are one
            w = np.add.reduceat(w, heads)
            d, t, s = d[heads], t[heads], s[heads]
            yield pa.RecordBatch.from_arrays(
                [pa.array(d * 1_000_003 + s), pa.nulls(len(d), pa.binary()), *(pa.array(x) for x in (d, t, s, w, np.zeros_like(s)))],
                schema=_SEGMENTS,
            )


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open runs in order, overlapping and touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _by_words(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The places in order of the 7 words of 8 bytes from each; a word is only looked at where all before tie."""
    first = words[places]
    order = places[np.argsort(first)]
    head = words[order]
    new = np.r_[True, head[1:] != head[:-1]] if len(order) else np.empty(0, bool)
    for offset in range(8, 49, 8):
        tied = np.flatnonzero(~(new & np.r_[new[1:], True])) if len(order) else new
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        word = words[order[tied] + offset]
        by = np.argsort(word)
        step = word[by]
        rank = np.empty(len(word), np.int64)
        rank[by] = np.cumsum(np.r_[False, step[1:] != step[:-1]])
        key = group * len(word) + rank
        by = np.argsort(key)
        order[tied] = order[tied][by]
        key = key[by]
        new[tied[1:]] |= key[1:] != key[:-1]
    return order


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Suffixes of `data` (bytes) in order of their first LENGTH bytes and more, by two-stage sorting."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64)
    # a suffix is small if it is less than its successor: the next other byte after its run is larger
    turns = np.flatnonzero(data[1:] != data[:-1])
    run_sizes = np.diff(np.r_[-1, turns, n - 1])
    rises = np.r_[data[turns + 1] > data[turns], False]
    small = np.repeat(rises, run_sizes)

    # stage 1: sort the small suffixes directly, by 7 words of 8 bytes
    words = _words(np.concatenate([data, np.zeros(64, np.uint8)]), ">u8")
    direct = np.flatnonzero(small)
    direct = _by_words(words, direct)
    heads = data[direct]
    bounds = np.searchsorted(heads, np.arange(257))

    # stage 2: scan the buckets in order; each suffix that is placed puts its predecessor, if large, next
    incoming: list[list[np.ndarray]] = [[] for _ in range(256)]
    incoming[data[n - 1]].append(np.array([n - 1]))  # the last suffix follows nothing
    out = []

    def pass_on(placed: np.ndarray, own: int) -> np.ndarray:
        """Deal the large predecessors to later buckets; returns those that stay in this one."""
        before = placed[placed > 0] - 1
        before = before[~small[before]]
        head = data[before]
        stay = before[head == own]
        go = head > own
        before, head = before[go], head[go]
        order = np.argsort(head, kind="stable")
        before, head = before[order], head[order]
        cuts = np.flatnonzero(head[1:] != head[:-1]) + 1
        if len(head):
            for piece, c in zip(np.split(before, cuts), head[np.r_[0, cuts]]):
                incoming[c].append(piece)
        return stay

    for c in range(256):
        for piece in [np.concatenate(incoming[c])] if incoming[c] else []:
            while len(piece):  # runs of one byte come back to their own bucket
                out.append(piece)
                piece = pass_on(piece, c)
        piece = direct[bounds[c] : bounds[c + 1]]
        if len(piece):
            out.append(piece)
            pass_on(piece, c)
    return np.concatenate(out)


def equal_windows(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For every suffix in the given order: has it a common prefix of LENGTH bytes with the one before it?"""
    words = _words(np.concatenate([data, np.zeros(64, np.uint8)]))
    same = np.ones(len(order), dtype=bool)
    same[:1] = False
    for offset in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        w = words[order + offset]
        same[1:] &= w[1:] == w[:-1]
    return same


_RUNS = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("windows", pa.int64())])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of windows that also start in a smaller document, for the segments of one partition."""
    held = []
    for batch in batches:
        settled = batch.filter(batch.column("segment").is_null())
        if settled.num_rows:
            yield pa.RecordBatch.from_arrays([settled.column(c) for c in ("doc", "th", "start", "windows")], schema=_RUNS)
        rest = batch.filter(batch.column("segment").is_valid())
        if rest.num_rows:
            held.append(rest)
    if not held:
        return
    table = pa.Table.from_batches(held).combine_chunks()
    del held
    key, doc, th, start, windows, at = (table[c].to_numpy() for c in ("key", "doc", "th", "start", "windows", "at"))
    order, heads, pieces, index = _grouped(key, table["segment"].combine_chunks(), doc)
    doc, th, start, windows = (x[order] for x in (doc, th, start, windows))
    sizes = np.diff(np.r_[heads, len(order)])
    least, group = doc[heads], np.repeat(np.arange(len(heads)), sizes)
    later = doc > least[group]
    yield from _run_batches(doc[later], th[later], start[later], windows[later])

    # a minimizer with one segment only has no other windows to compare
    of_group = order[heads]
    _, inverse, times = np.unique(key[of_group], return_inverse=True, return_counts=True)
    pick = np.flatnonzero(times[inverse] > 1)
    if not len(pick):
        return
    which, begin, end = _smallest(pieces, index[of_group[pick]], key[of_group[pick]], at[of_group[pick]], least[pick])
    # all rows of the smallest document of the group get its runs
    first_rows = heads[pick[which]]
    n = np.add.reduceat((~later).astype(np.int64), heads)[pick[which]]
    rows, run = _spans(first_rows, n), np.repeat(np.arange(len(which)), n)
    yield from _run_batches(doc[rows], th[rows], start[rows] + begin[run], (end - begin)[run])


def _run_batches(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 50_000]) for c in columns], schema=_RUNS)


def _joined_pieces(pieces: pa.BinaryArray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chosen pieces, each followed by 0xff, with their starts and sizes (with the separator)."""
    chosen = pieces.take(pa.array(index))
    offsets = np.frombuffer(chosen.buffers()[1], np.int32)[chosen.offset : chosen.offset + len(chosen) + 1].astype(np.int64)
    body = np.frombuffer(chosen.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets) + 1
    ends = np.cumsum(sizes)
    own = np.ones(int(ends[-1]), bool)
    own[ends - 1] = False
    data = np.full(len(own), 0xFF, np.uint8)
    data[own] = body
    return data, ends - sizes, sizes


def _smallest(
    pieces: pa.BinaryArray, index: np.ndarray, key: np.ndarray, at: np.ndarray, docs: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to): runs of windows that occur in a smaller document than the segment's own smallest.

    A window reaches at least _BESIDE bytes beyond its minimizer on one side. Only segments whose minimizer,
    with those bytes of a side, is also in a segment of another document go into the suffix array.
    """
    data, starts, sizes = _joined_pieces(pieces, index)
    words = _words(np.concatenate([data, np.zeros(64, np.uint8)]))
    numbers, sides, owners = [], [], []
    for side, there, place in ((0, at >= _BESIDE, starts + at - _BESIDE), (1, at + GRAM + _BESIDE < sizes, starts + at)):
        n = np.flatnonzero(there)
        code = _mixed(words, place[n], (0, 8, 16, 24, GRAM + _BESIDE - 8)) ^ (key[n].view(np.uint64) * _MIX[side])
        numbers.append(n)
        sides.append(code)
        owners.append(docs[n])
    n, code, owner = np.concatenate(numbers), np.concatenate(sides), np.concatenate(owners)
    order = np.argsort(code)
    heads = np.flatnonzero(np.r_[True, code[order][1:] != code[order][:-1]])
    spread = np.maximum.reduceat(owner[order], heads) != np.minimum.reduceat(owner[order], heads)
    met = np.unique(n[order][np.repeat(spread, np.diff(np.r_[heads, len(order)]))])
    empty = np.empty(0, np.int64)
    if not len(met):
        return empty, empty, empty

    data, starts, sizes = _joined_pieces(pieces, index[met])
    order = suffix_array(data)
    group_starts = np.flatnonzero(~equal_windows(data, order))
    of_suffix = np.repeat(docs[met], sizes)
    smallest = np.minimum.reduceat(of_suffix[order], group_starts)
    best = np.empty(len(data), dtype=np.int64)
    best[order] = np.repeat(smallest, np.diff(np.r_[group_starts, len(order)]))
    # suffixes shorter than a window reach into the next segment and do not count
    room = np.repeat(starts + sizes - 1, sizes) - np.arange(len(data))
    hit = (best < of_suffix) & (room >= LENGTH)
    edges = np.diff(np.r_[0, hit.astype(np.int8), 0])
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    part = np.searchsorted(starts, begins, side="right") - 1
    return met[part], begins - starts[part], ends - starts[part]


def remove_repeated_strings(docs: DataFrame, text: str = "text", out: str = "suffix_dedup") -> DataFrame:
    """All rows of `docs` with a struct column `out`: n_bytes, n_removed, n_spans and kept (bytes). A column of
    that name is replaced."""
    spark = docs.sparkSession
    ship_package(spark)
    width = partitions_for(spark, total_text_bytes(docs, text), _TASK_BYTES)
    body = F.col(text).cast("string")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(body).alias("th"), body.alias("text"))

    chunks = cut(
        plain.mapInArrow(_chunk_rows, "h1 long, h2 long, doc long, th long, start long, windows long"), "suffix_chunks"
    )
    first = chunks.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last")
    settled = cut(
        chunks.join(first, ["h1", "h2"]).filter("doc > first").select("doc", "th", "start", "windows"), "suffix_settled"
    )
    runs_of = F.collect_set(F.struct("start", "windows"))
    done = settled.groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th")).agg(runs_of.alias("settled"))
    spots = (
        plain.join(done.hint("merge"), (F.col("doc") == F.col("_doc")) & (F.col("th") == F.col("_th")), "left")
        .select("doc", "text", "settled")
        .mapInArrow(_spots, "key long, hash long, doc long, tag long")
    )
    repeated = cut(
        spots.repartition(width, "key").mapInArrow(_repeated, "doc long, place long, hash long"), "suffix_spots"
    )
    limit = max(HOT_ROWS, int(repeated.count() * HOT_SHARE))
    hot_rows = repeated.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).select("hash").collect()
    hot = np.array(sorted(r["hash"] for r in hot_rows), dtype=np.int64)

    per_doc = repeated.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("place", "hash"))).alias("spots"))
    touched = plain.join(per_doc.hint("merge"), "doc").select("doc", "th", "text", "spots")
    runs = cut(
        touched.mapInArrow(
            lambda batches: _segment_rows(batches, hot),
            "key long, segment binary, doc long, th long, start long, windows long, at long",
        )
        .repartition(width, "key")
        .mapInArrow(_match, "doc long, th long, start long, windows long"),
        "suffix_runs",
    )

    per_row = (
        runs.unionByName(settled)
        .groupBy(F.col("doc").alias("_doc"), F.col("th").alias("_th"))
        .agg(runs_of.alias("_runs"))
    )

    @F.arrow_udf("struct<n_bytes:long, n_removed:long, n_spans:long, kept:binary>")
    def without(bodies: pa.Array, found: pa.Array) -> pa.Array:
        kind = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
        step = max(1, len(bodies) * _PORTION // max(1, bodies.nbytes + found.nbytes))
        parts = [pa.array([], kind)]
        for a in range(0, len(bodies), step):  # a batch may be large, and its texts are held several times over
            some = zip(bodies.slice(a, step).to_pylist(), found.slice(a, step).to_pylist())
            parts.append(pa.array([_without((b or "").encode(), r) for b, r in some], kind))
        return pa.concat_arrays(parts)

    th, found = fresh(docs, "th", "runs")
    named = docs.withColumn(th, F.xxhash64(F.col(text).cast("string")))
    gone = per_row.withColumnRenamed("_runs", found)
    joined = named.join(gone.hint("merge"), (named["doc_id"] == gone["_doc"]) & (named[th] == gone["_th"]), "left")
    return joined.select(
        *[named[c] for c in docs.columns if c.lower() != out.lower()],
        without(named[text].cast("string"), F.col(found)).alias(out),
    )


def _without(body: bytes, runs: list[dict] | None) -> dict:
    spans = _merged([(r["start"], r["start"] + r["windows"] + LENGTH - 1) for r in runs or []])
    parts, at = [], 0
    for a, b in spans:
        parts.append(body[at:a])
        at = b
    kept = b"".join(parts) + body[at:]
    return {"n_bytes": len(body), "n_removed": len(body) - len(kept), "n_spans": len(spans), "kept": kept}
