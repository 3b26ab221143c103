"""Byte-level BPE: pre-tokens cut by array operations, each distinct one merged once.

A text is cut into pre-tokens by the vocabulary's rule
(``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|space+(?!S)|space+``), expressed
as boundary flags over arrays of code points.  Each distinct pre-token is then
encoded once and kept in a bounded pool, from which the ids of whole texts are
gathered.  ``MergeQueue`` encodes by a priority queue of merge ranks over a
doubly linked list of symbols; ``LibraryEncoder`` asks the tokenizers library.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblocks import Block, blocks, prefix_hash, range_hash

#: Pre-tokens that a worker's pool may hold before it starts anew.
POOL_WORDS = 1_500_000
#: The letters that follow an apostrophe in a pre-token of its own (fixed values).
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")
#: Code points that the rule counts as white space (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    import regex

    out = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = (i + (0x800 if i >= 0xD800 else 0) for i in m.span())
            out[a:b] = kind
    out[WHITE_SPACE] = SPACE
    return out


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    known = set(plain)
    return [chr(b) if b in known else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """What a byte-level BPE file holds: ids, bytes, merge ranks and special strings."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        names: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        to_byte = {c: b for b, c in enumerate(symbols)}
        self.byte_ids = [names[c] for c in symbols]
        self.ranks: dict[int, int] = {}  # of a pair of ids, as one integer
        self.merged: list[int] = []  # what the pair of a rank becomes
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[names[a] << 20 | names[b]] = rank
            self.merged.append(names[a + b])
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        strings = {i: bytes(to_byte[c] for c in s) for s, i in names.items() if i not in self.special.values()}
        strings |= {i: s for s, i in self.special.items()}
        size = max(strings) + 1
        lengths = np.array([len(strings.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.length = lengths
        self.start = np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(strings.get(i, b"") for i in range(size)), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The vocabulary's strings of ``ids``, concatenated."""
        n = self.length[ids]
        where = np.repeat(self.start[ids] - (np.cumsum(n) - n), n)
        where += np.arange(len(where))
        return self.bytes[where]


class MergeQueue:
    """Encodes one pre-token: a heap of merge ranks over a doubly linked list of symbols.

    A heap entry is a rank and the place of its left symbol, as one integer.  It is
    stale, and skipped, if the pair that now stands there has another rank.
    """

    def __init__(self, path: str):
        vocabulary = load_vocabulary(path)
        self.ranks, self.merged, self.byte_ids = vocabulary.ranks, vocabulary.merged, vocabulary.byte_ids

    def __call__(self, word: bytes) -> list[int]:
        byte_ids, rank_of, merged = self.byte_ids, self.ranks.get, self.merged
        sym = [byte_ids[b] for b in word]
        n = len(sym)
        if n == 1:
            return sym
        bits = n.bit_length()
        heap = []
        left = sym[0]
        for i in range(1, n):
            right = sym[i]
            rank = rank_of(left << 20 | right)
            if rank is not None:
                heap.append(rank << bits | i - 1)
            left = right
        if not heap:
            return sym
        heapq.heapify(heap)
        pop, push, mask = heapq.heappop, heapq.heappush, (1 << bits) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = pop(heap)
            i, rank = entry & mask, entry >> bits
            j = after[i]
            if j >= n or sym[i] < 0 or rank_of(sym[i] << 20 | sym[j]) != rank:
                continue
            sym[i] = whole = merged[rank]
            sym[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                rank = rank_of(whole << 20 | sym[k])
                if rank is not None:
                    push(heap, rank << bits | i)
            h = before[i]
            if h >= 0:
                rank = rank_of(sym[h] << 20 | whole)
                if rank is not None:
                    push(heap, rank << bits | h)
        return [s for s in sym if s >= 0]

    def many(self, words: list[bytes]) -> list[list[int]]:
        return [self(w) for w in words]


class RankEncoder:
    """The same ids from tiktoken, which reads the vocabulary as a table of ranks."""

    def __init__(self, path: str):
        import tiktoken

        v = load_vocabulary(path)
        special = set(v.special.values())
        ranks = {v.bytes[a : a + n].tobytes(): i for i, (a, n) in enumerate(zip(v.start.tolist(), v.length.tolist(), strict=True)) if n and i not in special}
        self.one = tiktoken.Encoding("ranks", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def many(self, words: list[bytes]) -> list[list[int]]:
        return list(map(self.one, words))


class LibraryEncoder:
    """The same by the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def many(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]


@functools.lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pre_tokens(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte positions at which a pre-token starts; rows (or parts of rows) start at ``off[:-1]``."""
    if not len(data):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    kind = code_point_classes()[cp]
    n = len(cp)
    row = np.zeros(n + 1, dtype=bool)  # a row starts here
    row[np.searchsorted(lead, off[:-1][off[:-1] < len(data)])] = True
    row[n] = True
    start = row[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # White space that something follows: its last character goes with that, if it is a plain space, or else stands alone.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~row[1:n])
    start[last] = True
    start[last + 1] = cp[last] != 0x20
    # An apostrophe on its own before one of the endings.
    at = np.flatnonzero(cp[:-1] == 0x27)
    if len(at):
        at = at[start[at] & (kind[at + 1] == LETTER) & ~row[at + 1]]
        short = at[np.isin(cp[at + 1], [ord(c) for c in SHORT_ENDINGS])]
        at = at[(at + 2 < n)]
        at = at[~row[at + 2]]
        long = at[np.logical_or.reduce([(cp[at + 1] == ord(a)) & (cp[at + 2] == ord(b)) for a, b in LONG_ENDINGS])]
        start[short + 1] = False
        start[(short + 2)[short + 2 < n]] = True
        start[long + 1] = False
        start[(long + 3)[long + 3 < n]] = True
    return lead[start]


class Encoder:
    """Encodes blocks; keeps the ids of the pre-tokens seen in a pool of bounded size."""

    def __init__(self, path: str, words: Callable[[str], object], limit: int = POOL_WORDS):
        self.vocabulary, self.words, self.limit = load_vocabulary(path), words(path), limit
        self.reset()

    def reset(self) -> None:
        self.key = np.zeros(0, np.uint64)  # in order, with the place of each one's ids
        self.start = np.zeros(0, np.int32)
        self.length = np.zeros(0, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def add(self, keys: np.ndarray, lists: list[list[int]]) -> None:
        """Put new pre-tokens, in order of their keys, into the pool."""
        length = np.fromiter(map(len, lists), np.int32, len(lists))
        flat = np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(length.sum()))
        if self.used + len(flat) > len(self.ids):
            grown = np.zeros(max(self.used + len(flat), 2 * len(self.ids)), np.uint32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(flat)] = flat
        start = (self.used + np.cumsum(length) - length).astype(np.int32)
        at = np.searchsorted(self.key, keys)
        self.key, self.start, self.length = np.insert(self.key, at, keys), np.insert(self.start, at, start), np.insert(self.length, at, length)
        self.used += len(flat)

    def _specials(self, data: np.ndarray) -> list[tuple[int, int, int]]:
        """Places of special strings, leftmost first: start, end, id."""
        found, raw = [], None
        for text, i in self.vocabulary.special.items():
            raw = data.tobytes() if raw is None else raw
            at = raw.find(text)
            while at >= 0:
                found.append((at, at + len(text), i))
                at = raw.find(text, at + len(text))
        return sorted(found)

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows, and the place of each row's first (len n+1)."""
        data, off = block.data, block.off
        if len(self.key) > self.limit:
            self.reset()
        special = [s for s in self._specials(data) if np.searchsorted(off, s[0], "right") == np.searchsorted(off, s[1], "left")]
        parts = off
        if special:
            parts = np.unique(np.concatenate([off, [x for s in special for x in s[:2]]]))
        start = pre_tokens(data, parts)
        end = np.append(start[1:], len(data))[: len(start)]
        key = range_hash(prefix_hash(data), start, end)
        if special:
            begins = np.array([s[0] for s in special])
            key[np.isin(start, begins)] = 0
            start_keep = ~np.logical_or.reduce([(start > a) & (start < b) for a, b, _ in special])
            start, end, key = start[start_keep], end[start_keep], key[start_keep]
        distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.key, distinct), max(len(self.key) - 1, 0))
        missing = np.flatnonzero(((self.key[at] != distinct) if len(self.key) else np.ones(len(distinct), bool)) & (distinct != 0))
        if len(missing):
            raw, where = data.tobytes(), first[missing]
            self.add(distinct[missing], self.words.many([raw[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)]))
        at = np.minimum(np.searchsorted(self.key, distinct), max(len(self.key) - 1, 0))
        begin, length = (self.start[at], self.length[at]) if len(self.key) else (np.zeros(len(distinct), np.int32),) * 2
        if special:
            length = np.where(distinct == 0, 1, length)
        length = length[inverse].astype(np.int64)
        where = np.repeat(begin[inverse] - (np.cumsum(length) - length), length)
        where += np.arange(len(where))
        ids = self.ids[where]
        ends = np.concatenate(([0], np.cumsum(length)))
        if special:
            ids[ends[:-1][key == 0]] = [s[2] for s in special]
        return ids, ends[np.searchsorted(start, off)]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, words: Callable[[str], object]) -> Encoder:
    """This worker's encoder for a vocabulary; workers that are used again keep their pool."""
    key = (path, words.__name__)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, words)
    return _ENCODERS[key]


def bpe_encode(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """Encode and decode every whole text: the method is a merge queue over linked symbols.

    Returns the key columns, ``n_tokens`` (long), ``ids`` (array of int, if
    ``with_ids``), ``decoded`` (string, if ``with_ids``), ``ids_sha256`` and
    ``decoded_sha256`` (lowercase hex of the ids as little-endian unsigned 32-bit
    integers, and of the decoded text in UTF-8).  No row is dropped; a null or
    empty text has no tokens and decodes to the empty string; repeated rows are
    encoded like others; further columns of ``df`` are ignored.  An empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()
    narrow = df.select(*keys, F.col(text).alias("__text"))
    fields = [narrow.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(path, MergeQueue)
        for block in blocks(batches, "__text"):
            ids, ends = work.encode(block)
            out = work.vocabulary.decode(ids)
            places = np.concatenate(([0], np.cumsum(work.vocabulary.length[ids])))[ends]
            raw_ids, raw_out = memoryview(ids.astype("<u4").tobytes()), memoryview(out.tobytes())
            sha = lambda raw, at: [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            arrays = [block.column(k) for k in keys]
            arrays += [pa.array(np.diff(ends)), pa.array(sha(raw_ids, ends * 4)), pa.array(sha(raw_out, places))]
            names = [*keys, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                arrays.append(pa.array([bytes(raw_out[a:b]).decode("utf-8", "replace") for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)], type=pa.string()))
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return narrow.mapInArrow(run, schema)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_encode(docs, with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
