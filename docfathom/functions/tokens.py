"""Estimates of tokens and splitting of text by a token budget.

Two estimates exist and differ on purpose: ``estimate`` (pieces of words and signs, for chunks) and
``code_points`` (one token a character, for an answer's context).
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Name of the estimate, kept with what was split by it.
VERSION = "estimate-v1"
#: Pieces of a text; parts of a word; where a text may be cut (after a sentence, at a blank line, after a full
#: stop before a capital or digit); signs at which a long sentence is cut, if they stand in the last part of what fits.
_PIECE = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[a-zA-Z0-9_]+|[^\s]")
_PART = re.compile(r"[A-Z]?[^A-Z_]+|[A-Z]")
_SENTENCE = re.compile(r"(?<=[。！？!?；;])\s*|\n{2,}|(?<=\.)\s+(?=[A-Z0-9])")
_FREE = re.compile(r"[\s_]*")
_SIGNS, _LAST_PART = " \n，,", 0.6


def estimate(text: str | None) -> int:
    """Ideographs and signs count 1; words by parts (at capitals and underscores), four characters a token."""
    total = 0
    for piece in _PIECE.findall(unicodedata.normalize("NFKC", text or "")):
        if piece[0].isascii() and (piece[0].isalnum() or piece[0] == "_"):
            total += sum(-(-len(part) // 4) for part in _PART.findall(piece))
        else:
            total += 1
    return total


def token_ends(text: str) -> np.ndarray:
    """Where each token of the estimate ends; a word's tokens end after every four characters of a part and at its end."""
    ends: list[int] = []
    for piece in re.finditer(r"[a-zA-Z0-9_]+|\S", text):
        if piece[0].isascii() and (piece[0][0].isalnum() or piece[0][0] == "_"):
            for part in _PART.finditer(piece[0]):
                at, end = piece.start() + part.start(), piece.start() + part.end()
                ends += [*range(at + 4, end, 4), end]
        else:
            ends += [piece.end()] * estimate(piece[0])
    return np.array(ends, np.int64)


def _sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences; of lines where there is but one sentence."""
    for pattern in (_SENTENCE, re.compile("\n")):
        marks = [(0, 0), *(m.span() for m in pattern.finditer(text)), (len(text), len(text))]
        spans = [(a, b) for (_, a), (b, _) in zip(marks, marks[1:], strict=False) if text[a:b].strip()]
        if len(spans) > 1:
            break
    return spans


def split_by_budget(text: str | None, most: int) -> list[str]:
    """Parts of at most ``most`` tokens: whole sentences joined while they fit; a longer one is cut at a space or comma if near.

    A comma right after what fits stays with it, so a cut part may have one token more.
    """
    whole, most = (text or "").strip(), max(1, int(most or 1))
    ends = token_ends(whole)
    if len(ends) <= most:
        return [whole] if whole else []
    parts: list[list[str]] = [[]]
    left = most
    for start, stop in _sentences(whole):
        first, last = np.searchsorted(ends, (start, stop), side="right").tolist()
        fits = last - first <= left
        while True:
            if not fits and parts[-1]:
                parts.append([])
                left = most
            reach = stop
            if last - first > most:  # up to the last sign that stands late enough in what fits, else all of it
                reach = int(ends[first + most - 1])
                if ends[first + most] == reach:  # one character of several tokens: it goes as a whole, alone if it must
                    reach = int(ends[max(first, int(np.searchsorted(ends, reach)) - 1)])
                reach = min(_FREE.match(whole, reach).end(), stop)
                sign = max(whole.rfind(c, start, reach + 1) for c in _SIGNS)
                if sign - start >= int((reach - start) * _LAST_PART):
                    reach = sign + 1
            parts[-1].append(whole[start:reach].strip())
            now = int(np.searchsorted(ends, reach, side="right"))
            left, start, first, fits = left - (now - first), reach, now, False
            if first >= last:
                break
    return ["\n\n".join(filter(None, p)) for p in parts if any(p)]


@F.pandas_udf(IntegerType())
def token_estimate(texts: pd.Series) -> pd.Series:
    return texts.map(estimate)


def code_points(c: Column) -> Column:
    return F.length(F.coalesce(c, F.lit("")))


def ascii_slug(text: str | None) -> str:
    """Lower-case ASCII words joined by hyphens."""
    plain = unicodedata.normalize("NFKD", text or "").encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")


def assign_slugs(names: list[tuple[str, str]], manual: dict[str, str] | None = None) -> dict[str, str]:
    """A unique slug for each (path, name), in order of path; later ones of the same base are numbered from 2."""
    import hashlib

    taken: set[str] = set()
    out = {}
    for path, name in sorted(names):
        base = (manual or {}).get(path) or ascii_slug(name) or hashlib.sha1(path.encode()).hexdigest()[:10]
        slug, n = base, 1
        while slug in taken:
            n += 1
            slug = f"{base}-{n}"
        taken.add(slug)
        out[path] = slug
    return out
