"""Quality rules: surface counts and how well public vocabularies fit a text.

Tokeniser fertility: each word, with the mark that stands for the space before
it, is encoded by two public vocabularies, one with byte fallback and one made for many
languages; a text's characters per token, the share of tokens that are (parts of)
single bytes and the entropy of its tokens are held against the bands of its script, or of
digits or symbols where these outnumber letters.  The bands are fixed, so a text's verdict depends on nothing else in
the table; texts of fewer than ``JUDGED`` tokens are not held against them.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblocks import Block, blocks, mix, prefix_hash, range_hash, words

#: Characters that count as symbols (fixed values).
SYMBOLS = b"#*$%&|<>"
#: Words of a repeated window; words that a document needs; largest share of repeated words, in per cent.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: Words whose counts a worker keeps before it starts anew.
POOL_WORDS = 1_000_000

#: Bands of scripts: characters per token of the first vocabulary from and to, and of the second; largest share of
#: byte tokens in the first and in the second; smallest entropy of tokens in bits.
BANDS = {
    "latin": (1.3, 6.0, 1.7, 7.0, 0.1, 0.15, 3.6),
    "greek": (0.5, 4.0, 0.5, 5.0, 0.9, 0.6, 3.6),
    "cyrillic": (1.0, 6.0, 0.5, 6.0, 0.35, 0.5, 3.6),
    "hebrew": (0.4, 4.0, 0.5, 5.0, 0.95, 0.7, 3.6),
    "arabic": (0.4, 4.0, 0.5, 5.0, 0.95, 0.7, 3.6),
    "indic": (0.25, 3.0, 0.25, 4.0, 1.0, 0.9, 3.0),
    "thai": (0.25, 3.0, 0.25, 4.0, 1.0, 0.9, 3.0),
    "kana": (0.3, 3.0, 0.3, 4.0, 0.95, 0.8, 3.6),
    "hangul": (0.25, 3.0, 0.25, 4.0, 1.0, 0.9, 3.6),
    "han": (0.3, 3.0, 0.25, 4.0, 0.95, 0.9, 3.6),
    "other": (0.2, 6.0, 0.2, 7.0, 0.9, 0.9, 3.0),
    "digits": (1.1, 6.0, 1.2, 7.0, 0.1, 0.15, 4.0),
    "symbols": (1.4, 6.0, 1.2, 7.0, 0.1, 0.15, 3.0),
}
#: Tokens of the first vocabulary from which on a text is held against its bands.
JUDGED = 64
#: Code points from which each script is told, ASCII first: first and last, script (fixed values of the standard's blocks).
SCRIPTS = (
    (0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0x30, 0x39, "digits"), (0x21, 0x2F, "symbols"), (0x3A, 0x40, "symbols"), (0x5B, 0x60, "symbols"), (0x7B, 0x7E, "symbols"), (0xC0, 0x24F, "latin"), (0x1E00, 0x1EFF, "latin"), (0x370, 0x3FF, "greek"), (0x400, 0x52F, "cyrillic"),
    (0x590, 0x5FF, "hebrew"), (0x600, 0x77F, "arabic"), (0x900, 0xDFF, "indic"), (0xE00, 0xEFF, "thai"), (0x3040, 0x30FF, "kana"), (0x1100, 0x11FF, "hangul"),
    (0xAC00, 0xD7AF, "hangul"), (0x3400, 0x9FFF, "han"),
)


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class _Pieces:
    """A vocabulary with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.processor.is_byte(i) or self.processor.is_unknown(i) for i in range(self.processor.get_piece_size())])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


class _Bytes:
    """A vocabulary of byte strings: a token that is no whole character counts as bytes."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.is_byte = np.zeros(max(ranks.values()) + 1, bool)
        for token, rank in ranks.items():
            try:
                token.decode()
            except UnicodeDecodeError:
                self.is_byte[rank] = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.coder.encode_ordinary(f" {t}") for t in texts]


@functools.lru_cache(maxsize=4)
def _vocabulary(path: str):
    return _Bytes(path) if path.endswith(".tiktoken") else _Pieces(path)


class WordTokens:
    """The vocabulary's tokens of distinct words, kept in a pool of bounded size."""

    def __init__(self, path: str, limit: int = POOL_WORDS):
        self.vocabulary, self.limit = _vocabulary(path), limit
        self.is_byte = self.vocabulary.is_byte
        self.reset()

    def reset(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int32)
        self.length = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.int32)

    def of(self, key: np.ndarray, start: np.ndarray, end: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words in order, and each word's number of tokens."""
        if len(self.key) > self.limit:
            self.reset()
        distinct, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        at = np.searchsorted(self.key, distinct)
        new = np.flatnonzero(np.append(self.key, np.uint64(0))[at] != distinct) if len(self.key) else np.arange(len(distinct))
        if len(new):
            where = first[new]
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)]
            lists = self.vocabulary.encode(texts)
            length = np.fromiter(map(len, lists), np.int32, len(lists))
            flat = np.fromiter((x for one in lists for x in one), np.int32, int(length.sum()))
            begin = (len(self.ids) + np.cumsum(length) - length).astype(np.int32)
            at = np.searchsorted(self.key, distinct[new])
            self.key, self.start, self.length = np.insert(self.key, at, distinct[new]), np.insert(self.start, at, begin), np.insert(self.length, at, length)
            self.ids = np.concatenate([self.ids, flat])
        at = np.searchsorted(self.key, distinct)
        length = self.length[at][inverse].astype(np.int64)
        where = np.repeat(self.start[at][inverse] - (np.cumsum(length) - length), length)
        return self.ids[where + np.arange(len(where))], length


_TOKENS: dict[str, WordTokens] = {}


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of ``flags`` each row has."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


def repeated_words(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row how many of its words stand in a window of WINDOW words found twice or more in it."""
    n, rows = len(h), len(first) - 1
    covered = np.zeros(n + 1, np.int64)
    if n >= WINDOW:
        acc = np.zeros(n - WINDOW + 1, np.uint64)
        for i in range(WINDOW):
            acc = mix(acc + h[i : n - WINDOW + 1 + i] + np.uint64(i + 1))
        row = np.repeat(np.arange(rows), np.diff(first))
        valid = np.flatnonzero(row[: len(acc)] == row[WINDOW - 1 :])
        key = mix(acc[valid] + row[valid].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = valid[count[inverse] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + WINDOW, -1)
    return per_row(np.cumsum(covered)[:n] > 0, first)


def duplicate_lines(data: np.ndarray, off: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each row how many of its lines hold a word and equal an earlier line."""
    cut = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([off[:-1], cut + 1]))
    begin = begin[begin < len(data)]
    row = np.searchsorted(off, begin, "right") - 1
    stop = np.minimum(off[row + 1], np.append(cut, len(data))[np.searchsorted(cut, begin)])
    has_word = np.searchsorted(start, stop) > np.searchsorted(start, begin)
    begin, stop, row = begin[has_word], stop[has_word], row[has_word]
    key = mix(range_hash(prefix_hash(data), begin, stop) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[at] = False
    return np.bincount(row[again], minlength=len(off) - 1)


def code_points(data: np.ndarray) -> np.ndarray:
    """The code point that starts at each byte of UTF-8; 0 at bytes that start none."""
    wide = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    a, b, c, d = wide[:-3], wide[1:-2] & 63, wide[2:-1] & 63, wide[3:] & 63
    return np.select([a < 0x80, a < 0xC0, a < 0xE0, a < 0xF0], [a, 0, (a & 31) << 6 | b, (a & 15) << 12 | b << 6 | c], (a & 7) << 18 | b << 12 | c << 6 | d)


def scripts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The place in BANDS of the commonest script of each row's letters (the first of equals; without any, "other")."""
    names = list(BANDS)
    point = code_points(data)
    counts = np.zeros((len(names), len(off) - 1), np.int64)
    ascii_only = (data < 0x80).all()
    for first, last, name in SCRIPTS[:7] if ascii_only else SCRIPTS:
        counts[names.index(name)] += per_row((point >= first) & (point <= last), off)
    return np.where(counts.any(axis=0), counts.argmax(axis=0), names.index("other"))


def fertility(tokens: WordTokens, h: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, raw: bytes, chars: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each row: tokens, characters per token, share of byte tokens, entropy of tokens in bits."""
    n = len(first) - 1
    ids, length = tokens.of(h, start, end, raw)
    total = np.diff(np.concatenate(([0], np.cumsum(length)))[first])
    row = np.repeat(np.arange(n), total)
    distinct, count = np.unique(row * len(tokens.is_byte) + ids, return_counts=True)
    of = distinct // len(tokens.is_byte)
    share = count / total[of]
    some = np.maximum(total, 1)
    return total, chars / some, np.bincount(row, weights=tokens.is_byte[ids], minlength=n) / some, np.bincount(of, weights=-share * np.log2(share), minlength=n).astype(float)


def measure(block: Block, tokens: tuple[WordTokens, WordTokens], bands: np.ndarray) -> dict[str, np.ndarray]:
    data, off = block.data, block.off
    start, end, first = words(data, off)
    prefix = prefix_hash(data)
    h = range_hash(prefix, start, end)
    n = np.diff(first)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = lead[end] - lead[start]
    sums = np.concatenate(([0], np.cumsum(chars)))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {
        "n_words": n,
        "word_chars": sums[first[1:]] - sums[first[:-1]],
        "n_symbols": per_row(symbol[data], off),
        "n_dup_lines": duplicate_lines(data, off, start),
        "n_repeat_words": repeated_words(h, first),
    }
    raw = data.tobytes()
    one, two = (fertility(t, h, start, end, first, raw, out["word_chars"]) for t in tokens)
    out["n_tokens"], out["chars_per_token"], out["byte_share"], out["token_entropy"] = one
    _, out["chars_per_token_multi"], out["byte_share_multi"], _ = two
    out["script"] = scripts(data, off)
    limit = bands[out["script"]]
    out["base_failed"] = (n < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * n)
    odd = (out["chars_per_token"] < limit[:, 0]) | (out["chars_per_token"] > limit[:, 1]) | (out["chars_per_token_multi"] < limit[:, 2]) | (out["chars_per_token_multi"] > limit[:, 3])
    odd |= (out["byte_share"] > limit[:, 4]) | (out["byte_share_multi"] > limit[:, 5])
    odd |= out["token_entropy"] < limit[:, 6]
    out["kept"] = ~(out["base_failed"] | (odd & (out["n_tokens"] >= JUDGED)))
    return out


_TYPES = {"chars_per_token": "double", "byte_share": "double", "token_entropy": "double", "chars_per_token_multi": "double", "byte_share_multi": "double", "script": "int", "base_failed": "boolean", "kept": "boolean"}
COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "chars_per_token", "byte_share", "token_entropy", "chars_per_token_multi", "byte_share_multi", "script", "base_failed", "kept"]


def _measured(df: DataFrame, text: str, keys: tuple[str, ...], paths: tuple[str, str], bands: np.ndarray) -> DataFrame:
    narrow = df.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(text).alias("__text"))
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), *(f"{c} {_TYPES.get(c, 'long')}" for c in COLUMNS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tuple(_TOKENS.setdefault(path, None) or WordTokens(path) for path in paths)
        _TOKENS.update(zip(paths, tokens, strict=True))
        for block in blocks(batches, "__text"):
            out = measure(block, tokens, bands)
            arrays = [pa.array(out[c], type=pa.int32() if c == "script" else None) for c in COLUMNS]
            yield pa.RecordBatch.from_arrays([*(block.column(f"__k{i}") for i in range(len(keys))), *arrays], names=[*keys, *COLUMNS])

    return narrow.mapInArrow(run, schema)


def quality_rules(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), vocabularies: tuple[str, str] | None = None) -> DataFrame:
    """Counts, vocabulary fit and verdict of every whole text, one row each.

    A null or empty text has no words and fails the base rules.  Repeated rows are
    measured each; a null key is kept; other columns are ignored, whatever their names;
    an empty table gives no rows.
    """
    paths = vocabularies or default_vocabularies()
    return _measured(df, text, keys, paths, np.array(list(BANDS.values())))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
