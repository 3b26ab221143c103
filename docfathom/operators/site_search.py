"""Keyword search over a feed: hits of words, best first, and slices of text around them."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def search(items: DataFrame, words: list[str], most: int) -> DataFrame:
    """``items`` (id, content) that hold a word: by number of different words, then of hits, then id, descending."""
    low = F.lower("content")
    count = lambda w: ((F.length("low") - F.length(F.replace("low", F.lit(w), F.lit("")))) / len(w)).cast("long")
    out = items.withColumn("low", low)
    counts = F.array(*(count(w.lower()) for w in words if w))
    out = out.withColumn("counts", counts).select("id", "content", F.size(F.filter("counts", lambda n: n > 0)).cast("long").alias("hit_words"), F.aggregate("counts", F.lit(0).cast("long"), lambda s, n: s + n).alias("hits")).filter("hits > 0")
    top = out.orderBy(F.desc("hit_words"), F.desc("hits"), F.desc("id")).limit(most)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("hit_words"), F.desc("hits"), F.desc("id"))).cast("long"))


#: Characters before and after the start of a slice's first hit; searches and their characters at once.
BEFORE, AFTER, SEARCHES, CHARACTERS = 20, 80, 2_000, 200_000


def keywords(search: str) -> list[str]:
    """The words of a search, at spaces and hyphens, and the whole search if there are several."""
    whole = search.strip().lower()
    words = re.split(r"[-\s]+", whole)
    return [w for w in [*words, *([whole] if len(words) > 1 else [])] if w]


def hits(low: str, words: list[str], found: dict[str, list[int]] | None = None) -> tuple[int, list[tuple[int, str]]]:
    """How many hits the words have, each by itself, and those that are shown: from left to right, the longest first, none overlapping."""
    found = {} if found is None else found
    for w in words:
        if w not in found:
            found[w] = [m.start() for m in re.finditer(re.escape(w), low)]
    every = sorted((a, -len(w), w) for w in words for a in found[w])
    shown: list[tuple[int, str]] = []
    end = 0
    for a, size, w in every:
        if a >= end:
            shown.append((a, w))
            end = a - size
    return len(every), shown


def slices(shown: list[tuple[int, str]], length: int, whole: str) -> list[tuple[int, int, int, list[tuple[int, int]]]]:
    """Stretches of a text of ``length`` characters: start, end, hits of ``whole``, hits (start, end).

    A stretch goes from BEFORE before its first hit to AFTER behind that hit's start and takes the hits that end within
    it.  Most hits of the whole search come first, then most hits, then the earlier.
    """
    out: list[list] = []
    for a, w in shown:
        if not out or a + len(w) > out[-1][1]:
            out.append([max(0, a - BEFORE), min(max(a + AFTER, a + len(w)), length), 0, []])
        out[-1][2] += w == whole
        out[-1][3].append((a, a + len(w)))
    return sorted(map(tuple, out), key=lambda s: (-s[2], -len(s[3]), s[0]))


_SLICE = "struct<start:long,stop:long,whole:long,hits:array<struct<start:long,stop:long>>>"
_FOUND = f"id {{}}, search_id long, hits long, whole_hits long, title_hits array<struct<start:long,stop:long>>, slices array<{_SLICE}>"


def places(automaton, low: str) -> dict[str, list[int]]:
    """Where each word of the automaton that stands in a text begins, as a search that goes on behind each hit finds them."""
    out: dict[str, list[int]] = {}
    for end, w in automaton.iter(low):
        start = end + 1 - len(w)
        held = out.setdefault(w, [])
        if not held or start >= held[-1] + len(w):
            held.append(start)
    return out


def best(known: list[tuple[int, str, list[str]]], most: int, slices_each: int, arrow: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches (id, title, content) to the ``most`` best of them for each of ``known`` (search_id, search, words).

    Words are counted once a text; hits that overlap are sorted out, and slices cut, only for what may be among the best so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        number = {w: i for i, w in enumerate(dict.fromkeys(w for _, _, words in known for w in words))}
        if not number or most < 1:
            return
        automaton = ahocorasick.Automaton()
        for w in number:
            automaton.add_word(w, w)
        automaton.make_automaton()
        wide = max(len(words) for _, _, words in known)
        # Numbers of each search's words; the last one stands for none.
        inside = np.array([[*(number[w] for w in words), *[len(number)] * (wide - len(words))] for _, _, words in known])
        entire = np.array([number[whole] if whole in words else len(number) for _, whole, words in known])
        heaps: list[list[tuple]] = [[] for _ in known]
        least = np.full((2, len(known)), -1)
        seen = 0
        for batch in batches:
            for key, title, content in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:]), strict=True):
                both = places(automaton, title), places(automaton, content)
                count = np.zeros(len(number) + 1, np.int64)
                for found in both:
                    for w, at in found.items():
                        count[number[w]] += len(at)
                n, at_most = count[inside].sum(axis=1), count[entire]
                some = (n > 0) & ((at_most > least[0]) | (at_most == least[0]) & (n >= least[1]))
                key = key.as_py()
                for i in np.flatnonzero(some).tolist():
                    search, whole, words = known[i]
                    _, shown = hits(title, words, {w: both[0].get(w, []) for w in words})
                    _, more = hits(content, words, {w: both[1].get(w, []) for w in words})
                    of_whole = sum(w == whole for _, w in (*shown, *more))
                    rank, seen = (of_whole, int(n[i]), key is not None, key, seen), seen + 1
                    heap = heaps[i]
                    if len(heap) == most and rank < heap[0][0]:
                        continue
                    cuts = slices(more, len(content), whole)
                    kept = [{"start": a, "stop": b, "whole": k, "hits": [{"start": x, "stop": y} for x, y in h]} for a, b, k, h in cuts[:slices_each]]
                    row = {"id": key, "search_id": search, "hits": int(n[i]), "whole_hits": of_whole, "title_hits": [{"start": a, "stop": a + len(w)} for a, w in shown], "slices": kept}
                    (heapq.heapreplace if len(heap) == most else heapq.heappush)(heap, (rank, row))
                    if len(heap) == most:
                        least[:, i] = heap[0][0][:2]
        for heap in heaps:
            if heap:
                yield pa.RecordBatch.from_pylist([row for _, row in heap], schema=arrow)

    return run


def ranked(items: DataFrame, searches: DataFrame, most: int, slices_each: int = 1) -> DataFrame:
    """The ``most`` best ``items`` (id, title, content) of each of ``searches`` (search_id, search), with their slices.

    Best: most hits of the whole search among those shown, then most hits of its words, then the larger id.  Gives
    search_id, id, place (from 1), hits, whole_hits, title_hits and the ``slices_each`` best ``slices`` of the content
    (start, stop, whole, hits), in code points of the lower-case text.  Each text is read once for all searches, whose
    words are found in one pass; a task sends its ``most`` best of each search.  There may be at most SEARCHES searches of CHARACTERS characters together:
    more is an error, to be asked in parts.  Null texts are empty, null and empty searches find nothing; items of
    the same id stand beside each other; other columns are ignored.  Ids are numbers or strings.
    """
    asked = searches.filter(F.trim("search") != "").select("search_id", "search").limit(SEARCHES + 1).collect()
    if len(asked) > SEARCHES or sum(len(r["search"]) for r in asked) > CHARACTERS:
        raise ValueError(f"more than {SEARCHES} searches or {CHARACTERS} characters of them")
    known = [(r["search_id"], r["search"].strip().lower(), keywords(r["search"])) for r in asked]

    schema = _FOUND.format(items.schema["id"].dataType.simpleString())
    narrow = items.select("id", *(F.lower(F.coalesce(c, F.lit(""))).alias(c) for c in ("title", "content")))
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    order = Window.partitionBy("search_id").orderBy(F.desc("whole_hits"), F.desc("hits"), F.desc("id"))
    top = narrow.mapInArrow(best(known, most, slices_each, arrow), schema).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return top.select("search_id", "id", F.col("place").cast("long").alias("place"), "hits", "whole_hits", "title_hits", "slices")
