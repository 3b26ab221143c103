"""Periodic runs: stretches of words that repeat with one period, by the runs theorem.

Every run has a root that is the longest Lyndon word from its place on, under an order of the words or under the
reversed one.  For all texts of a block at once, each closed by a mark that is smaller than any word:

1. Suffixes are sorted by doubling; only groups that are still equal are sorted again.
2. The next smaller value of the inverse suffix array ends the longest Lyndon word of each place; both orders are taken.
3. A run of ``exponent`` roots has at least exponent - 1 of them one after another as longest Lyndon words, so only
   such chains are extended, each from its first root, to the right by the longest common extension (minimum of LCP values, from a
   sparse table) of the root and what follows it, to the left by the same on the reversed texts.

A text none of whose short word strings occurs twice has no run and is left out before 1; so is, before 3, one without
a chain.  A block holds at most 1 MB of text, or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblocks import blocks, mix, ragged, word_strings, words

#: A run's least number of periods and of words.
EXPONENT, LEAST = 4, 6
BLOCK = 1 << 20
#: Odd multiplier of the words of a string (fixed value).
_K = np.uint64(0x9E3779B97F4A7C15)


def _begins(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns differs from the one before."""
    return np.concatenate(([True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))


def suffix_ranks(x: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Inverse suffix array, texts one after another: ``text`` numbers them; the last value of each is its smallest and occurs once in it."""
    order = np.lexsort((x, text))
    rank, h = np.empty(len(x), np.int64), 1
    place, split = np.arange(len(x)), _begins(text[order], x[order])
    rank[order] = np.maximum.accumulate(np.where(split, place, 0))
    left = order
    while True:
        width = np.diff(np.append(np.flatnonzero(split), len(left)))
        left = left[np.repeat(width, width) > 1]
        if not len(left):
            return rank
        low, ahead = rank[left], rank[left + h]
        order = np.lexsort((ahead, low))
        left, low, ahead = left[order], low[order], ahead[order]
        place, old, split = np.arange(len(left)), _begins(low), _begins(low, ahead)
        rank[left] = low + np.maximum.accumulate(np.where(split, place, 0)) - np.maximum.accumulate(np.where(old, place, 0))
        h *= 2


def longest_lyndon(rank: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word from each place on: up to the next smaller suffix of its text (0 at its closing mark)."""
    a, n = rank.tolist(), len(rank)
    following = list(range(n))
    closing = np.zeros(n, bool)
    closing[last] = True
    for i in np.flatnonzero(~closing)[::-1].tolist():
        v, j = a[i], i + 1
        while a[j] > v:
            j = following[j]
        following[i] = j
    return np.array(following, np.int64) - np.arange(n)


class Extensions:
    """Longest common extensions of texts one after another: minima of LCP values, from a sparse table."""

    def __init__(self, x: np.ndarray, rank: np.ndarray, first: np.ndarray):
        n = len(x)
        sa = np.empty(n, np.int64)
        sa[rank] = np.arange(n)
        before = np.full(n, -1)
        before[1:] = sa[:-1]
        before = before[rank]  # the suffix before each one
        before[sa[first]] = -1  # the smallest of each text has none
        words, prior, lcp, h = x.tolist(), before.tolist(), [0] * n, 0
        for i, j in enumerate(prior):
            if j < 0:
                h = 0
                continue
            while words[i + h] == words[j + h]:
                h += 1
            lcp[i] = h
            if h:
                h -= 1
        self.rank, self.table = rank, [np.array(lcp, np.int32)[sa]]
        while 2 << (len(self.table) - 1) <= n:
            half, row = 1 << (len(self.table) - 1), self.table[-1]
            self.table.append(np.minimum(row[:-half], row[half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from places i and j (others of the same text) are equal."""
        lo, hi = np.minimum(self.rank[i], self.rank[j]) + 1, np.maximum(self.rank[i], self.rank[j])
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][lo[at]], self.table[k][hi[at] - (1 << k) + 1])
        return out


def _closed(x: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, ...]:
    """The texts ``keep`` of ``x`` (``first`` has where each begins), a closing 0 after each: values, number of each value's text, where each begins and closes."""
    length = np.diff(first)[keep]
    begin = np.cumsum(length + 1) - (length + 1)
    out = np.zeros(int(length.sum()) + len(keep), np.int64)
    out[np.repeat(begin, length) + ragged(length)] = x[np.repeat(first[:-1][keep], length) + ragged(length)]
    return out, np.repeat(np.arange(len(keep)), length + 1), begin, begin + length


def repeating(x: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Texts in which some string of ``size`` words occurs twice (by hashes: perhaps some more)."""
    full = len(x) - size + 1
    if full <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(full, np.uint64)
    for i in range(size):
        h = mix(h * _K + x[i : i + full].astype(np.uint64))
    text = np.searchsorted(first, np.arange(full), "right") - 1
    within = np.arange(full) + size <= first[text + 1]
    h, text = mix(h[within] ^ mix(text[within].astype(np.uint64))), text[within]
    order = np.argsort(h)
    h, text = h[order], text[order]
    return np.unique(text[1:][h[1:] == h[:-1]])


def runs(x: np.ndarray, first: np.ndarray, exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Runs of at least ``least`` words and ``exponent`` periods in texts of words (numbers from 1): text, start in it, length, period; in that order."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    # A run of period q has two equal strings of max(least, exponent * q) - q words, q apart.
    string = min(max(least, exponent * q) - q for q in range(1, least + 1))
    kept = repeating(x, first, string)
    if not len(kept):
        return none
    y, text, begin, last = _closed(x, first, kept)
    falling = np.where(y > 0, y.max() + 1 - y, 0)
    rank = suffix_ranks(y, text)
    found = []
    for order in (rank, suffix_ranks(falling, text)):
        root = longest_lyndon(order, last)
        at = np.flatnonzero(root)
        for k in range(1, exponent - 1):  # exponent - 1 roots one after another
            ahead = at + k * root[at]
            inside = ahead < len(y)
            at, ahead = at[inside], ahead[inside]
            at = at[root[ahead] == root[at]]
        found.append((at, root[at]))
    at, period = (np.concatenate(c) for c in zip(*found, strict=True))
    if not len(at):
        return none
    # Only texts with such roots are extended: their places and ranks are slices.
    some = np.unique(text[at])
    length = (last - begin + 1)[some]
    new = np.cumsum(length) - length
    shift = np.zeros(len(begin), np.int64)
    shift[some] = new - begin[some]
    slices = np.repeat(begin[some], length) + ragged(length)
    at = at + shift[text[at]]
    y, rank = y[slices], rank[slices] + np.repeat(shift[some], length)
    owner = np.repeat(np.arange(len(some)), length)
    after = Extensions(y, rank, new).common(at, at + period)
    turned = np.zeros(len(y), np.int64)  # each text reversed, its closing mark in place
    mirror = np.repeat(new, length) + np.repeat(length - 2, length) - ragged(length)
    mirror[new + length - 1] = new + length - 1
    turned[mirror] = y
    inner = np.flatnonzero(at > new[owner[at]])
    before = np.zeros(len(at), np.int64)
    if len(inner):
        before[inner] = Extensions(turned, suffix_ranks(turned, owner), new).common(mirror[at[inner] - 1], mirror[at[inner] + period[inner] - 1])
    start, size = at - before, before + period + after
    long = size >= np.maximum(least, exponent * period)
    start, size, period = start[long], size[long], period[long]
    own = owner[start]
    rows = np.unique(np.stack([own, start - new[own], period, size], axis=1), axis=0)
    return kept[some][rows[:, 0]], rows[:, 1], rows[:, 3], rows[:, 2]


def collapsed(lengths: np.ndarray, begin: np.ndarray, data: np.ndarray, keep: np.ndarray, first: np.ndarray) -> pa.StringArray:
    """Kept words of each text, joined by one space."""
    which = np.flatnonzero(keep)
    size = lengths[which] + 1
    at = np.cumsum(size) - size
    out = np.full(int(size.sum()), 32, np.uint8)
    out[np.repeat(at, size - 1) + ragged(size - 1)] = data[np.repeat(begin[which], size - 1) + ragged(size - 1)]
    ends = np.append(at, len(out))[np.searchsorted(which, first)]
    raw = out.tobytes()
    return pa.array([raw[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary()).cast(pa.string())


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """One row for each row of ``df``: the key, ``n_words``, ``runs`` and ``collapsed``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text.  ``runs`` are the maximal stretches of words whose smallest
    period q repeats at least ``exponent`` times and that have at least ``least`` words: start, length, period, in
    that order.  ``collapsed`` has the words, joined by one space, that no run contains after its first q words.
    Null and empty texts have no words, no runs and an empty text; repeated rows and rows without a key each have their
    row; an empty table gives no rows.  Other columns are ignored.
    """
    if exponent < 2 or least < exponent:
        raise ValueError("a run has at least two periods, and at least one word a period")
    body = F.coalesce(F.col(text), F.lit(""))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text", BLOCK):
            start, end, first = words(block.data, block.off)
            x = word_strings(block.data, start, end).dictionary_encode().indices.to_numpy().astype(np.int64) + 1
            own, at, length, period = runs(x, first, exponent, least)
            cover = np.zeros(len(x) + 1, np.int64)
            np.add.at(cover, first[own] + at + period, 1)
            np.add.at(cover, first[own] + at + length, -1)
            rest = collapsed(end - start, start, block.data, np.cumsum(cover)[:-1] == 0, first)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(block) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in (at, length, period)], fields=list(run_type)))
            yield pa.RecordBatch.from_arrays([block.column("__key"), pa.array(np.diff(first)), lists, rest], names=[key, "n_words", "runs", "collapsed"])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return df.select(F.col(key).alias("__key"), body.alias("__text")).mapInArrow(run, schema)


def planted(df: DataFrame) -> DataFrame:
    """``doc_id`` and text of documents; in those whose hash of the id says so, the words from one place on repeat with one period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    split = df.select("doc_id", "text", h.alias("h"), g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)).alias("w")).withColumn("n", F.size("w"))
    placed = split.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    repeated = F.expr("array_join(transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE element_at(w, CAST(1 + a + (i - a) % p AS INT)) END), ' ')")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.expr("element_at(array_sort(runs, (x, y) -> CASE WHEN x.length <> y.length THEN CAST(sign(y.length - x.length) AS INT) WHEN x.start <> y.start THEN CAST(sign(x.start - y.start) AS INT) ELSE CAST(sign(x.period - y.period) AS INT) END), 1)")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
