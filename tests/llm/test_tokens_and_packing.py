from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from docfathom.llm import bpe, packing
from docfathom.llm.textblocks import blocks

from .conftest import corpus


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_vocabulary())


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def test_encoding_equals_the_library(spark, docs, library):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"]), r["decoded"]) for r in bpe.bpe_encode(docs).collect())
    want = []
    for i, t in corpus():
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        said = library.decode(ids, skip_special_tokens=False)
        want.append((i is None, i or 0, len(ids), sha(raw), sha(said.encode()), tuple(ids), said))
    assert got == sorted(want)


def test_random_texts_with_every_rule(library):
    rng = random.Random(9)
    parts = ["a", "s", "t", "re", "'", "'s", "'ll", " ", "  ", "\n", "\t", "1", "²", "é", "!", "?", "日本", "　", "\xa0", "\x1c", "\x85", "<|endoftext|>", "<|endof", "😀", "ß", "م", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    for words in (bpe.MergeQueue, bpe.RankEncoder, bpe.LibraryEncoder):
        work, got = bpe.Encoder(bpe.default_vocabulary(), words, limit=500), []
        for block in blocks([pa.RecordBatch.from_pydict({"text": pa.array(texts)})], limit=2000):
            ids, ends = work.encode(block)
            got += [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_packing_is_whole_and_tight(docs, library):
    rows = packing.pack(docs, max_tokens=64).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] <= 64
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    for i, t in corpus():
        if i in (None, 63):  # a null key and repeated rows: counted below
            continue
        ids = [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [x for r in own for x in r["ids"]] == ids
        assert [r["piece"] for r in own] == list(range(len(own))) and all(r["length"] == 64 for r in own[1:])
    assert len(by_doc[63]) % 2 == 0 and len(by_doc[None]) >= 2
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= math.ceil(total / 64) * 1.05 + 2


@pytest.mark.parametrize("lengths", [[1], [1024] * 5, [700] * 50, [512] * 7 + [300] * 9 + [212] * 9, list(range(1, 1025)) * 3, [3] * 5000])
def test_plan_places_every_piece_once(lengths):
    histogram = Counter(lengths)
    slots = packing.plan(dict(histogram))
    seen: dict = {}
    used: Counter = Counter()
    for length, first, end, sequence, offset in slots:
        for k in range(first, end):
            assert (length, k) not in seen
            seen[length, k] = 1
            used[sequence + k - first] = max(used[sequence + k - first], offset + length)
    assert len(seen) == len(lengths) and max(used.values()) <= 1024
    plain: list[int] = []  # best fit, longest first
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(plain) if room >= n]
        if fits:
            best = min(fits, key=lambda i: plain[i])
            plain[best] -= n
        else:
            plain.append(1024 - n)
        if len(lengths) > 2000:
            plain = [1024] * math.ceil(sum(lengths) / 1024)
            break
    assert len(used) <= len(plain) * 1.05 + 3


def test_empty_tables(empty):
    assert bpe.bpe_encode(empty).count() == 0
    assert packing.pack(empty).count() == 0
