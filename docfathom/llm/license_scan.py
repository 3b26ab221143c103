"""License scans by diagonal voting.

1. Every text is split into words; the hash of each rolling string of ``GRAM`` words that any template has goes on
   with its place and its words (others can't join, so they stay behind; the summary of each text goes on as one row).
2. These join the templates' places by hash, and their words must be the template's words: a place in a text less the
   place in the template is a diagonal, and each joined string is a vote for its diagonal.
3. Diagonals with enough votes are elected.  Elected diagonals of a template at most ``NEAR`` apart are one span:
   words that were put in or left out move the rest of a license to a neighbouring diagonal.
4. A span is verified by the template's words that its strings cover: all of a short template, most of a long one.

Work follows the words of the texts once; votes, spans and labels are of the size of what was found.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .license_templates import PHRASES, TEMPLATES
from .store import stored
from .textblocks import ascii_lower, blocks, mix, prefix_hash, range_hash, word_strings, words

#: Words of a string that votes; votes that elect a diagonal (all of a shorter template); largest distance of neighbouring diagonals.
GRAM, VOTES, NEAR = 3, 4, 8
#: Words from which on a template is long, and the share of a long template's words that must be covered, in per cent.
LONG, COVERED = 32, 80
#: Entries of templates that are sent to every task; more are joined by a shuffle.
SENT = 200_000

_U = np.uint64
#: Odd multipliers of the words of a string (fixed values).
_K = (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB))
_FOUND = "mark long, place long, h long, gram string, n_words long, n_base long, first_word long, last_word long, base array<string>"


def license_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of lower-cased rows: starts, ends, index of each row's first word."""
    solid = (data >= 0x80) | ((data >= 0x30) & (data <= 0x39)) | ((data >= 0x61) & (data <= 0x7A))
    return words(data, off, solid)


def gram_hashes(h: np.ndarray) -> np.ndarray:
    """Hashes of ``GRAM`` words from each word on."""
    full = max(0, len(h) - GRAM + 1)
    out = np.zeros(full, np.uint64)
    for i in range(GRAM):
        out += h[i : i + full] * _K[i]
    return mix(out)


def _split(text: str) -> tuple[list[str], np.ndarray]:
    data = ascii_lower(np.frombuffer(text.encode(), np.uint8))
    start, end, _ = license_words(data, np.array([0, len(data)]))
    return word_strings(data, start, end).to_pylist(), range_hash(prefix_hash(data), start, end)


def template_rows(templates: Sequence[tuple[str, str]]) -> list[tuple]:
    """For each string of each template: its hash, words, template, label, place, the template's words and how many must be covered."""
    rows = []
    for i, (label, text) in enumerate(templates):
        split, h = _split(text)
        n = len(split)
        if n < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {text!r}")
        need = n if n < LONG else -(-n * COVERED // 100)
        rows += [(int(x), " ".join(split[t : t + GRAM]), i, label, t, n, need) for t, x in enumerate(gram_hashes(h).view(np.int64).tolist())]
    return rows


def _scan(phrases: Sequence[tuple[str, str]], known: np.ndarray):
    """Each text's summary (no place), and its strings of words that templates have."""
    looked = [(label, [w.encode() for w in text.split()], _split(text)[1]) for label, text in phrases]
    maybe = np.zeros(1 << 16, bool)
    maybe[(known & _U(0xFFFF)).astype(np.int64)] = True

    def places(data, start, end, h, first, want: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Words from which on a phrase stands in one row: found by hashes, told by bytes."""
        last = len(h) - len(want) + 1
        if last <= 0:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(h[:last] == hashes[0])
        at = at[np.searchsorted(first, at, "right") == np.searchsorted(first, at + len(want) - 1, "right")]
        for i, word in enumerate(want):
            at = at[(end[at + i] - start[at + i]) == len(word)]
            at = at[(data[start[at + i][:, None] + np.arange(len(word))] == np.frombuffer(word, np.uint8)).all(axis=1)]
        return at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text"):
            data, n = ascii_lower(block.data), len(block)
            start, end, first = license_words(data, block.off)
            h = range_hash(prefix_hash(data), start, end)
            base, labels = [], [[] for _ in range(n)]
            for label, want, hashes in looked:
                at = places(data, start, end, h, first, want, hashes)
                base.append(at)
                for row in np.unique(np.searchsorted(first, at, "right") - 1).tolist():
                    if label not in labels[row]:
                        labels[row].append(label)
            at = np.sort(np.concatenate(base)) if base else np.zeros(0, np.int64)
            lo, hi = np.searchsorted(at, first[:-1]), np.searchsorted(at, first[1:])
            some = hi > lo
            low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
            low[some], high[some] = at[lo[some]] - first[:-1][some], at[hi[some] - 1] - first[:-1][some]
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [block.column("__key"), block.column("__mark"), none, none, pa.nulls(n, pa.string()), pa.array(np.diff(first)), pa.array(hi - lo), pa.array(low, mask=~some), pa.array(high, mask=~some), pa.array(labels, pa.list_(pa.string()))],
                names=_NAMES,
            )
            grams = gram_hashes(h)
            hit = np.flatnonzero(maybe[(grams & _U(0xFFFF)).astype(np.int64)])
            hit = hit[np.isin(grams[hit], known)]
            row = np.searchsorted(first, hit, "right") - 1
            within = hit + GRAM <= first[row + 1]
            hit, row = hit[within], row[within]
            if not len(hit):
                continue
            parts = [word_strings(data, start[hit + i], end[hit + i]) for i in range(GRAM)]
            m, none = len(hit), pa.nulls(len(hit), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [block.column("__key").take(pa.array(row)), block.column("__mark").take(pa.array(row)), pa.array(hit - first[row]), pa.array(grams[hit].view(np.int64)), pc.binary_join_element_wise(*parts, " "), none, none, none, none, pa.nulls(m, pa.list_(pa.string()))],
                names=_NAMES,
            )

    return run


_NAMES = ["key", "mark", "place", "h", "gram", "n_words", "n_base", "first_word", "last_word", "base"]


def _found(df: DataFrame, key: str, text: str, templates: list[tuple], phrases: Sequence[tuple[str, str]]) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).alias("__key"), F.xxhash64(body).alias("__mark"), body.alias("__text"))
    known = np.unique(np.array([r[0] for r in templates], np.int64).view(np.uint64))
    return stored(docs.mapInArrow(_scan(phrases, known), f"key {df.schema[key].dataType.simpleString()}, {_FOUND}"))


def _spans(found: DataFrame, templates: list[tuple]) -> DataFrame:
    known = found.sparkSession.createDataFrame(templates, "h long, own string, template int, label string, t int, n int, need int")
    if len(templates) <= SENT:
        known = F.broadcast(known)
    doc = ["key", "mark", "template", "label", "n", "need"]
    votes = found.filter("place IS NOT NULL").join(known, "h").filter("gram = own").withColumn("diagonal", F.col("place") - F.col("t"))
    elected = votes.groupBy(*doc, "diagonal").agg(F.collect_set("t").alias("ts")).filter(F.size("ts") >= F.least(F.lit(VOTES), F.col("n") - (GRAM - 1)))
    by = Window.partitionBy("key", "mark", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(by) > NEAR).cast("int")
    span = elected.withColumn("apart", F.coalesce(apart, F.lit(0))).withColumn("span", F.sum("apart").over(by))
    word = span.select(*doc, "span", "diagonal", F.explode("ts").alias("t")).select(*doc, "span", "diagonal", F.explode(F.sequence("t", F.col("t") + (GRAM - 1))).alias("t"))
    place = F.col("diagonal") + F.col("t")
    seen = word.groupBy(*doc, "span").agg(F.countDistinct("t").alias("covered"), F.min(place).alias("start_word"), (F.max(place) + 1).alias("end_word"))
    return seen.filter("covered >= need").withColumn("share", F.col("covered") / F.col("n"))


def license_spans(df: DataFrame, key: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Verified spans of license passages in every whole text: key, label, template, first word, word after the last, share covered.

    Texts under one key are told apart by a 64-bit hash of the text; repeated rows give their spans once.  A null key is a
    key like others.  Null and empty texts, and an empty table, give no rows.  Other columns are ignored.
    """
    rows = template_rows(templates)
    return _spans(_found(df, key, text, rows, ()), rows).select(F.col("key").alias(key), "label", "template", "start_word", "end_word", "share")


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """One row for each row of ``df``: its words, the places of phrases and the labels of phrases and of verified spans.

    ``n_base`` places of phrases, overlapping ones too, with the first and the last (null without any); ``base_labels``
    those of phrases, ``labels`` with those of spans; ``score`` 1 with a phrase, else the largest covered share of a
    verified span, else 0.  A null text is an empty one: no words, no labels, score 0.  Repeated rows and rows without a
    key each have their row.  An empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = template_rows(templates)
    found = _found(df, key, text, rows, phrases)
    by = _spans(found, rows).groupBy(F.col("key").alias("of"), F.col("mark").alias("of_mark")).agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    docs = found.filter("place IS NULL")
    both = docs.join(by, docs["key"].eqNullSafe(by["of"]) & (docs["mark"] == by["of_mark"]), "left")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return both.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word", joined("base").alias("base_labels"),
        joined(F.concat("base", F.coalesce("own", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
