"""Suffix-array dedup: windows of a fixed length that also start earlier, by depth-limited radix sort.

Only what can repeat is sorted.  Of each window the leftmost smallest hash of its
``GRAM``-byte strings is its anchor, so equal windows have equal anchors at equal places:

1. The windows of each text fall into runs with one anchor.  A run travels as two hashes (of the anchor's
   bytes and of all bytes of the run's windows) and its place; of runs with equal hashes within a task the two
   earliest go on, the others follow the first.
2. The runs are dealt by their anchor.  Where several have one, all are asked for in full; an anchor that one run has
   can't repeat and is done.
3. The texts answer with the bytes of those runs.  They are sorted by most significant digits, eight bytes a
   pass: first whole runs, of which equal ones leave but for the earliest, then the suffixes in them, no deeper than
   the window; what is alone in its group leaves at each pass.  The groups that remain are the repeated windows, and
   all but the earliest of each are repeats.  Hashes only say what meets; bytes say what is equal.
   An anchor with very many different runs has its windows dealt one by one, each with its bytes.
4. The repeats of each text are merged and its other bytes kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import dealt, stored
from .textblocks import blocks, mix, prefix_hash, ragged, range_hash

#: Bytes of a window and of an anchor.
WINDOW, GRAM = 100, 32
#: Bytes in which anchors are sought at once; runs that a task holds before it sends them.
SEGMENT, HELD = 1 << 20, 1_000_000
#: Different runs with one anchor from which its windows are dealt one by one: within a task, and in all.
HOT_HERE, HOT = 64, 4096
_PLACE = np.uint64((1 << 21) - 1)
_NO_KEY = -(1 << 63)
#: A place is one long: start of the anchor or span << 14 | first window's start before it << 7 | last one's.
_SPAN, _HOT = (127 << 7) | 127, (127 << 7) | 126


def anchor_runs(data: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first start, last start, place of the anchor; windows don't cross rows."""
    n = len(data) - window + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty
    at = np.arange(len(data) - gram + 1)
    low = (range_hash(prefix_hash(data), at, at + gram) & ~_PLACE) | at.astype(np.uint64)
    width, done = window - gram + 1, 1
    while 2 * done <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    if width > done:
        low = np.minimum(low[: len(low) - (width - done)], low[width - done :])
    count = np.maximum(np.diff(off) - window + 1, 0)
    start = np.repeat(off[:-1], count) + ragged(count)
    anchor = (low[start] & _PLACE).astype(np.int64)
    if not len(start):
        return empty, empty, empty
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.append(first[1:], len(start)) - 1
    return start[first], start[last], anchor[first]


def segments(data: np.ndarray, off: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A block as it is, or a single long text in overlapping parts that share no window: place, bytes, offsets."""
    if len(data) <= 2 * SEGMENT:
        yield 0, data, off
        return
    for a in range(0, len(data), SEGMENT):
        part = data[a : a + SEGMENT + window - 1]
        yield a, part, np.array([0, len(part)])


def merged(key: np.ndarray, mark: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Spans of each text, overlapping and touching ones made one."""
    if not len(key):
        return key, mark, start, end
    order = np.lexsort((start, mark, key))
    key, mark, start, end = key[order], mark[order], start[order], end[order]
    text = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (mark[1:] != mark[:-1]))))
    wide = np.int64(max(int(end.max()) + 1, 1))
    reach = np.maximum.accumulate(end + text * wide) - text * wide
    new = np.concatenate(([True], (text[1:] != text[:-1]) | (start[1:] > reach[:-1])))
    first = np.flatnonzero(new)
    return key[first], mark[first], start[first], reach[np.append(first[1:], len(key)) - 1]


_RUN = "h long, ctx long, key long, mark long, place long"
_FOUND = "kind int, h long, key long, mark long, start long, end long, anchor long"


def _batch(names: str, arrays: list) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, type=types[t]) for x, (_, t) in zip(arrays, fields, strict=True)], names=[n for n, _ in fields])


def _spans(key, mark, start, end) -> list:
    """Spans as runs that pass by: dealt by their text, with the end in place of the second hash."""
    return [mix(key.astype(np.uint64) ^ mix(mark.astype(np.uint64))).view(np.int64), end, key, mark, start << 14 | _SPAN]


def first_of(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before."""
    return np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))) if len(keys[0]) else np.zeros(0, bool)


def ranked(*keys: np.ndarray) -> np.ndarray:
    """The place of each row of sorted columns among those equal to it."""
    new = np.flatnonzero(first_of(*keys))
    return np.arange(len(keys[0])) - np.repeat(new, np.diff(np.append(new, len(keys[0]))))


def _runs(window: int, gram: int):
    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        h, ctx, key, mark, place = held
        order = np.lexsort((mark, place, key, ctx, h))
        order = order[first_of(*(x[order] for x in (h, ctx, key, mark, place)))]  # repeated rows are one
        h, ctx, key, mark, place = (x[order] for x in held)
        rank = ranked(h, ctx)
        again = rank > 1
        p, far, near = place[again] >> 14, place[again] >> 7 & 127, place[again] & 127
        spans = merged(key[again], mark[again], p - far, p - near + window)
        h, ctx, key, mark, place = (x[~again] for x in (h, ctx, key, mark, place))
        # An anchor with many runs here sends them as they are, but says so.
        group = np.cumsum(first_of(h)) - 1
        hot = np.bincount(group, weights=rank[~again] == 0, minlength=1)[group] > HOT_HERE if len(h) else np.zeros(0, bool)
        first_hot = hot & first_of(h)
        asked = [h[first_hot], np.zeros(first_hot.sum(), np.int64), key[first_hot], mark[first_hot], place[first_hot] & ~np.int64(0x3FFF) | _HOT]
        return _batch(_RUN, [np.concatenate(x) for x in zip([h, ctx, key, mark, place], asked, _spans(*spans), strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], [], [], [], []]
        size = 0
        for block in blocks(batches, "__text", SEGMENT):
            keys, marks = block.ints("__key"), block.ints("__mark")
            for base, data, off in segments(block.data, block.off, window):
                a, b, p = anchor_runs(data, off, window, gram)
                prefix = prefix_hash(data)
                row = np.searchsorted(off, a, "right") - 1
                far, near = p - a, p - b
                h = range_hash(prefix, p, p + gram)
                ctx = mix(range_hash(prefix, a, b + window) + (far * 1009 + near).astype(np.uint64))
                place = (p - off[row] + base) << 14 | far << 7 | near
                for x, y in zip(held, (h.view(np.int64), ctx.view(np.int64), keys[row], marks[row], place), strict=True):
                    x.append(y)
                size += len(a)
            if size > HELD:
                yield send([np.concatenate(x) for x in held])
                held, size = [[], [], [], [], []], 0
        if size:
            yield send([np.concatenate(x) for x in held])

    return run


def _table(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def _meeting(window: int):
    """Runs dealt by their anchor: spans that pass by (kind 0), runs of anchors that several have, asked for in full (1; 2: window by window)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(batches)
        if table is None:
            return
        h, ctx, key, mark, place = (table.column(c).to_numpy() for c in ("h", "ctx", "key", "mark", "place"))
        span = (place & 0x3FFF) == _SPAN
        spans = merged(key[span], mark[span], place[span] >> 14, ctx[span])
        zero = np.zeros(len(spans[0]), np.int64)
        yield _batch(_FOUND, [zero, zero, *spans, zero])
        hot = np.unique(h[~span & ((place & 0x3FFF) == _HOT)])
        own = ~span & ((place & 0x3FFF) != _HOT)
        h, ctx, key, mark, place = (x[own] for x in (h, ctx, key, mark, place))
        order = np.lexsort((mark, place, key, ctx, h))
        order = order[first_of(*(x[order] for x in (h, ctx, key, mark, place)))]
        h, ctx, key, mark, place = (x[order] for x in (h, ctx, key, mark, place))
        p = place >> 14
        start, end = p - (place >> 7 & 127), p - (place & 127) + window
        group = np.cumsum(first_of(h)) - 1
        count, classes = (np.bincount(group, weights=w, minlength=1)[group] if len(h) else np.zeros(0, int) for w in (None, first_of(h, ctx)))
        many = count > 1
        kind = np.where((classes > HOT) | np.isin(h, hot), 2, 1)
        yield _batch(_FOUND, [x[many] for x in (kind, h, key, mark, start, end, p)])

    return run


_ANSWER = "kind int, h long, key long, mark long, start long, anchor long, bytes binary"


def _answers(window: int):
    """Texts with the runs asked of them: the runs' bytes, or each window's as a run of its own (equal ones of a task: the two earliest; others are spans, kind 0)."""

    def windows(held: list[np.ndarray], raw: bytes) -> pa.RecordBatch:
        h, key, mark, start, at = held
        order = np.lexsort((mark, start, key, h))
        order = order[first_of(*(x[order] for x in (h, key, mark, start)))]
        h, key, mark, start, at = (x[order] for x in held)
        again = ranked(h) > 1
        spans = merged(key[again], mark[again], start[again], start[again] + window)
        once = ~again
        rows = [np.concatenate(x) for x in zip((h[once], key[once], mark[once], start[once]), (mix(spans[0].astype(np.uint64)).view(np.int64), *spans[:3]), strict=True)]
        kind = np.repeat([1, 0], [once.sum(), len(spans[0])])
        pieces = [raw[a : a + window] for a in at[once].tolist()]
        return _batch(_ANSWER, [kind, *rows, np.concatenate([start[once], spans[3]]), pieces + [None] * len(spans[0])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text", SEGMENT):
            keys, marks = block.ints("__key"), block.ints("__mark")
            asked = block.column("asked")
            row = np.repeat(np.arange(len(block)), np.diff(asked.offsets.to_numpy()))
            items = asked.flatten()
            kind, h, start, end, anchor = (items.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            raw = block.data.tobytes()
            at = block.off[row]
            one = kind == 1
            if one.any():
                pieces = [raw[a:b] for a, b in zip((at + start)[one].tolist(), (at + end)[one].tolist(), strict=True)]
                yield _batch(_ANSWER, [kind[one], h[one], keys[row][one], marks[row][one], start[one], anchor[one], pieces])
            if not one.all():
                two = ~one
                count = (end - start - window + 1)[two]
                begin = np.repeat(start[two], count) + ragged(count)
                there = np.repeat(at[two], count) + begin
                prefix = prefix_hash(block.data)
                name = mix(range_hash(prefix, there, there + window) ^ np.repeat(h[two], count).view(np.uint64))
                yield windows([name.view(np.int64), np.repeat(keys[row][two], count), np.repeat(marks[row][two], count), begin, there], raw)

    return run


def radix_groups(data: np.ndarray, start: np.ndarray, group: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes at ``start`` within their groups through ``depth`` bytes, most significant digits first.

    Returns which suffixes are equal to another through that depth, and the group of each of those.
    """
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    left = np.arange(len(start))
    for d in range(0, depth + 8, 8):
        _, inverse, count = np.unique(group, return_inverse=True, return_counts=True)
        keep = count[inverse] > 1  # alone in its group: no repeat
        left, group = left[keep], inverse[keep]
        if d >= depth or not len(left):
            break
        digit = np.zeros(len(left), np.uint64)
        for i in range(8):
            byte = wide[start[left] + d + i].astype(np.uint64) if d + i < depth else np.uint64(0)
            digit = digit << np.uint64(8) | byte
        order = np.lexsort((digit, group))
        left, group, digit = left[order], group[order], digit[order]
        group = np.cumsum(first_of(group, digit))
    return left, group


def equal_runs(data: np.ndarray, begin: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort whole runs of bytes within their groups: which are equal to another of their length, and the group of each of those."""
    which, groups, used = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for n in np.unique(length).tolist():
        rows = np.flatnonzero(length == n)
        left, own = radix_groups(data, begin[rows], group[rows], n)
        which.append(rows[left])
        groups.append(own + used)
        used += len(rows) + 1
    return np.concatenate(which), np.concatenate(groups)


def _later(group: np.ndarray, key: np.ndarray, mark: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows of a group aren't its earliest."""
    order = np.lexsort((mark, start, key, group))
    later = np.zeros(len(group), bool)
    later[order] = ~first_of(group[order])
    return later


def _sorted_runs(window: int):
    """The radix passes: spans of runs, and of windows, that aren't the first of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(batches)
        if table is None:
            return
        kind, h, key, mark, start, anchor = (table.column(c).to_numpy() for c in ("kind", "h", "key", "mark", "start", "anchor"))
        found = [(key[kind == 0], mark[kind == 0], start[kind == 0], anchor[kind == 0])]
        one = np.flatnonzero(kind == 1)
        one = one[np.argsort(h[one], kind="stable")]
        column = table.column("bytes").combine_chunks() if table.num_rows else None
        lo = 0
        while lo < len(one):
            hi = min(lo + 20_000, len(one))
            while hi < len(one) and h[one[hi]] == h[one[hi - 1]]:
                hi += 1
            rows = one[lo:hi]
            lo = hi
            pieces = column.take(pa.array(rows))
            pieces = pieces.combine_chunks() if isinstance(pieces, pa.ChunkedArray) else pieces
            raw = pieces.to_pylist()
            length = np.array([len(x) for x in raw])
            data, begin = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(length) - length
            shape = np.unique(mix(h[rows].view(np.uint64)) + (anchor[rows] - start[rows]).astype(np.uint64), return_inverse=True)[1]
            same, group = equal_runs(data, begin, length, shape)
            own = rows[same]
            later = _later(group, key[own], mark[own], start[own])
            found.append(merged(key[own][later], mark[own][later], start[own][later], start[own][later] + length[same][later]))
            left = np.ones(len(rows), bool)
            left[same[later]] = False
            # Of the runs left, those that share their anchor with another.
            _, inverse, count = np.unique(h[rows[left]], return_inverse=True, return_counts=True)
            left[np.flatnonzero(left)[count[inverse] < 2]] = False
            rows, length, begin = rows[left], length[left], begin[left]
            count = length - window + 1
            nth = ragged(count)
            row = np.repeat(rows, count)
            place = start[row] + nth
            group = np.unique(mix(h[row].view(np.uint64)) + (anchor[row] - place).astype(np.uint64), return_inverse=True)[1]
            kept, group = radix_groups(data, np.repeat(begin, count) + nth, group, window)
            k, m, s = key[row[kept]], mark[row[kept]], place[kept]
            later = _later(group, k, m, s)
            found.append(merged(k[later], m[later], s[later], s[later] + window))
        spans = merged(*(np.concatenate(x) for x in zip(*found, strict=True)))
        zero = np.zeros(len(spans[0]), np.int64)
        yield _batch(_FOUND, [zero, zero, *spans, zero])

    return run


def dedup_substrings(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove from every whole text, as UTF-8 bytes, what a ``window``-byte string that also starts earlier covers.

    Earlier is a smaller key, or the same key and an earlier start; a null key comes before all others.
    Strings are judged on the input.  Returns one row per row of ``df``: the key, ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs), ``kept_sha256`` (of the remaining bytes) and, if ``with_text``, ``kept``
    (the remaining text; characters cut in two are dropped), and the columns in ``carry`` as they are.  A null or empty text has no bytes.  Repeated rows count
    as one document; different texts under one key are told apart, the one of the smaller hash coming first where both start alike.
    Other columns are ignored; an empty table gives no rows.
    """
    if window < GRAM + 1 or window > GRAM + 95:
        raise ValueError(f"window must be {GRAM + 1} to {GRAM + 95} bytes")
    carried = [f"__c{i}" for i in range(len(carry))]
    body = F.coalesce(F.col(text), F.lit(""))
    # Texts under one key are told apart by a 64-bit hash; rows without a key are dealt by it.
    docs = df.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_KEY)).alias("__key"), F.xxhash64(body).alias("__mark"), body.alias("__text"), *(F.col(c).alias(n) for c, n in zip(carry, carried, strict=True)))
    runs = docs.select("__key", "__mark", "__text").mapInArrow(_runs(window, GRAM), _RUN)
    found = stored(dealt(runs, "h", source=docs, times=2.0).mapInArrow(_meeting(window), _FOUND))
    asked = found.filter("kind > 0").groupBy("key", "mark").agg(F.collect_list(F.struct("kind", "h", "start", "end", "anchor")).alias("asked"))
    whole = dealt(docs, "__key", "__mark", source=docs)
    answers = whole.join(asked, (whole["__key"] == asked["key"]) & (whole["__mark"] == asked["mark"])).select("__key", "__mark", "__text", "asked").mapInArrow(_answers(window), _ANSWER)
    more = dealt(answers, "h", source=docs).mapInArrow(_sorted_runs(window), _FOUND)
    spans = found.filter("kind = 0").unionByName(more).groupBy(F.col("key").alias("__of"), F.col("mark").alias("__with")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    schema = f"`{key}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text
    schema = ", ".join([schema, *(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text", SEGMENT):
            raw = memoryview(block.data.tobytes())
            out: list[tuple] = []
            for k, a, b, spans in zip(block.ints("__key").tolist(), block.off[:-1].tolist(), block.off[1:].tolist(), block.column("spans").to_pylist(), strict=True):
                own = sorted((s["start"], s["end"]) for s in spans or ())
                kept, at, removed, n = [], 0, 0, 0
                for start, end in own:
                    if start > at or not n:
                        kept.append(raw[a + at : a + start])
                        n += 1
                        at = start
                    if end > at:
                        removed += end - at
                        at = end
                kept.append(raw[a + at : b])
                rest = b"".join(kept)
                out.append((None if k == _NO_KEY else k, b - a, removed, n, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
            columns = list(zip(*out, strict=True))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            arrays = [pa.array(x, type=t) for x, t in zip(columns, types, strict=True)][: 5 + with_text]
            yield pa.RecordBatch.from_arrays(arrays + [block.column(c) for c in carried], names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + with_text] + list(carry))

    return whole.join(spans, (whole["__key"] == spans["__of"]) & (whole["__mark"] == spans["__with"]), "left").select("__key", "__text", "spans", *carried).mapInArrow(cut, schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
