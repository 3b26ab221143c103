"""Sets of hashed word shingles of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .textblocks import Block, ascii_lower, mix, prefix_hash, range_hash, words

_U = np.uint64
#: Odd multipliers, one for each word of a shingle (fixed values).
_K = [_U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9C6E6877736C46E3)]


def shingle_hashes(block: Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the ``size`` words from each word on, over a whole block; hashes of the words; the index of each row's first word.

    Row r of b - a words (a, b its first word and the next row's) has max(0, b - a - size + 1) shingles, from a on.
    """
    data = ascii_lower(block.data)
    start, end, first = words(data, block.off)
    h = range_hash(prefix_hash(data), start, end)
    full = max(0, len(h) - size + 1)
    acc = np.full(full, size * int(_K[-1]) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(size):
        acc += h[i : i + full] * _K[i]
    return mix(acc), h, first


def shingle_sets(block: Block, size: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct 64-bit hashes of its ``size``-word shingles.

    Words are maximal runs of bytes other than ASCII white space, A-Z lower-cased.
    A text of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    acc, h, first = shingle_hashes(block, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        n = b - a
        if n >= size:
            s = np.sort(acc[a : b - size + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
        elif n:
            yield mix(np.array([sum((int(x) * int(k) for x, k in zip(h[a:b], _K, strict=False)), n * int(_K[-1])) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)
