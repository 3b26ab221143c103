"""Quality classifier: votes of the nearest labelled latent-semantic vectors.

A text's terms are its words and its strings of three bytes (A-Z lower-cased, digits alike), hashed; those in most texts
of a bounded sample of labelled rows are the vocabulary, half of each kind.  One more column counts words that repeat
the word before.  Truncated singular vectors of the sample's weighted terms give the latent space.
The labelled vectors are broadcast; every document's cosines with all of them are computed in blocks and the nearest
vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import fold, learnable, sampled
from .store import stored
from .textblocks import Block, ascii_lower, blocks, prefix_hash, range_hash, words

#: Labelled rows learnt from at most; terms of the vocabulary; dimensions; neighbours; power of the similarity that weighs a vote.
SAMPLE, TERMS, DIMENSIONS, NEIGHBOURS, POWER = 2500, 4096, 64, 15, 8
#: Hashed names of terms of one kind (a power of 2, as its logarithm), and names whose counts travel together.
NAMES_LOG, NAMES_ROW = 18, 1 << 15
#: Weight of the column of repeated words (in place of a weight by frequency); score from which a text is accepted.
REPEAT_WEIGHT, ACCEPT = 3.0, 0.3
#: Rows whose terms are held at once.
ROWS = 256
SEED = 5


def named_terms(block: Block) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Row and name of each word, row and name of each string of three bytes, and each row's share of words that repeat the one before."""
    n = len(block)
    data = ascii_lower(block.data)
    start, end, first = words(data, block.off)
    h = range_hash(prefix_hash(data), start, end)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[first[:-1][first[:-1] < len(h)]] = False
    sums = np.concatenate(([0], np.cumsum(again)))
    repeated = np.sqrt((sums[first[1:]] - sums[first[:-1]]) / np.maximum(np.diff(first), 1))
    by_word = np.repeat(np.arange(n), np.diff(first)), (h >> np.uint64(64 - NAMES_LOG)).astype(np.int64) + (1 << NAMES_LOG)
    if len(data) < 3:
        return by_word, (np.zeros(0, np.int64), np.zeros(0, np.int64)), repeated
    data = np.where((data >= 48) & (data <= 57), np.uint8(48), data).astype(np.uint32)
    code = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    row = np.repeat(np.arange(n), np.diff(block.off))
    inside = row[:-2] == row[2:]
    name = (code[inside] * np.uint32(2654435761)) >> np.uint32(32 - NAMES_LOG)
    return by_word, (row[:-2][inside], name.astype(np.int64)), repeated


class Vocabulary:
    """Columns of the commonest names: TERMS of them and one for repeated words."""

    def __init__(self, texts: np.ndarray):
        """``texts``: for each name how many texts have it; ties go to the smaller name."""
        self.column = np.full(2 << NAMES_LOG, -1, np.int32)
        half = 1 << NAMES_LOG
        chosen = np.concatenate([base + np.argsort(-texts[base : base + half], kind="stable")[: TERMS // 2] for base in (0, half)])
        chosen = np.sort(chosen[texts[chosen] > 1])
        self.column[chosen] = np.arange(len(chosen))
        self.width = len(chosen) + 1

    def vectors(self, block: Block) -> np.ndarray:
        """Square roots of the shares that terms have in the words, or strings, of each row."""
        n, width = len(block), self.width
        *kinds, repeated = named_terms(block)
        out = np.zeros((n, width), np.float32)
        for row, name in kinds:
            total = np.bincount(row, minlength=n)
            column = self.column[name]
            known = column >= 0
            counts = np.bincount(row[known] * width + column[known], minlength=n * width).reshape(n, width)
            out += np.sqrt(counts / np.maximum(total, 1)[:, None]).astype(np.float32)
        out[:, -1] = repeated
        return out


def texts_with(docs: DataFrame) -> np.ndarray:
    """For each name how many texts of ``docs`` (a sample) have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 << NAMES_LOG, np.int64)
        for block in blocks(batches, "__text", 1 << 20):
            for row, name in named_terms(block)[:2]:
                total += np.bincount(np.unique(row << np.int64(NAMES_LOG + 1) | name) & ((2 << NAMES_LOG) - 1), minlength=len(total))
        for part, counts in enumerate(total.reshape(-1, NAMES_ROW)):
            if counts.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts.as_py(), np.int64)
        for part, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([counts.tobytes()], pa.binary())], names=["part", "counts"])

    out = np.zeros((2 << NAMES_LOG) // NAMES_ROW * NAMES_ROW, np.int64).reshape(-1, NAMES_ROW)
    for r in docs.select("__text").mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(add, "part int, counts binary").collect():
        out[r["part"]] = np.frombuffer(r["counts"], np.int64)  # fixed size, whatever the table's
    return out.ravel()


class Model:
    """Latent vectors of labelled rows; with no rows, every score is ``prior``."""

    def __init__(self, vocabulary: Vocabulary, terms: np.ndarray, y: np.ndarray):
        self.vocabulary = vocabulary
        self.prior = float(y.mean()) if len(y) else 0.5
        self.idf = (np.log((1.0 + len(y)) / (1.0 + (terms > 0).sum(axis=0))) + 0.1).astype(np.float32)
        self.idf[-1] = REPEAT_WEIGHT
        weighted = terms * self.idf
        dims = max(1, min(DIMENSIONS, *weighted.shape)) if len(y) else 1
        # Singular vectors by power iteration of a random subspace.
        basis = np.random.default_rng(SEED).standard_normal((vocabulary.width, dims + 8)).astype(np.float32)
        for _ in range(6 if len(y) else 0):
            basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
        if len(y):
            _, _, vt = np.linalg.svd(weighted @ basis, full_matrices=False)
            basis = basis @ vt.T[:, :dims]
        self.basis, self.y = basis.astype(np.float32), y.astype(np.float32)
        self.vectors = self.latent(terms)

    def latent(self, terms: np.ndarray) -> np.ndarray:
        z = (terms * self.idf) @ self.basis
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def of(self, block: Block) -> np.ndarray:
        return self.score(self.vocabulary.vectors(block))

    def score(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.y):
            return np.full(len(terms), self.prior)
        out = []
        for part in np.array_split(terms, max(1, len(terms) // 256)):
            cosine = self.latent(part) @ self.vectors.T
            k = min(NEIGHBOURS, len(self.y))
            # Ties at the edge vote too, as all of the least similarity that the k nearest have.
            edge = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
            weight = np.where(cosine >= edge, np.maximum(cosine, 0.0) ** POWER, 0.0)
            total = weight.sum(axis=1)
            score = np.where(total > 1e-9, weight @ self.y / np.maximum(total, 1e-9), self.prior)
            out.append(np.where(part.any(axis=1), score, self.prior))
        return np.clip(np.concatenate(out).astype(float), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, kept_out, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled rows that ``kept_out`` (a column of the labels) doesn't hold back."""
    chosen = sampled(learnable(labels, key, label, kept_out), key, sample)
    # A key that several rows have lends its label to the first of their texts.
    rows = docs.select(F.col(key), F.col(text).alias("__text")).join(F.broadcast(chosen), key).groupBy(key).agg(F.min(F.struct("__text", "y")).alias("r"))
    rows = stored(rows.select("r.*"))
    vocabulary = Vocabulary(texts_with(rows))
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in (part for whole in blocks(batches, "__text", 1 << 20) for part in parts(whole)):
            found = [(np.flatnonzero(v).astype(np.uint16), v[v != 0]) for v in sent.value.vectors(block)]
            arrays = [block.column("y"), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in zip(*found, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["y", "at", "weight"])

    # At most ``sample`` rows of at most TERMS + 1 columns, sent without their zeros.
    got = rows.mapInArrow(terms, "y int, at binary, weight binary").toArrow().sort_by([("y", "ascending"), ("at", "ascending"), ("weight", "ascending")])
    vectors = np.zeros((len(got), vocabulary.width), np.float32)
    for v, at, weight in zip(vectors, got.column("at"), got.column("weight"), strict=True):
        v[np.frombuffer(at.as_py(), np.uint16)] = np.frombuffer(weight.as_py(), np.float32)
    return Model(vocabulary, vectors, got.column("y").to_numpy().astype(float) if len(got) else np.zeros(0))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """Score every whole text: the key, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from ACCEPT on).

    Labels of rows whose fold is 0 are not learnt from.  A null or empty text, one without any term of the vocabulary, or a table without
    labels get the share of label 1 among the rows learnt from (0.5 if there are none).  Repeated rows score alike; a null key is kept,
    never held out and never learnt from.  Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, key, text, label, fold(key, folds) == 0, sample))
    narrow = docs.select(F.col(key), F.col(text).alias("__text"))
    schema = f"`{key}` {narrow.schema[key].dataType.simpleString()}, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text", 1 << 20):
            scores = [model.value.of(part) for part in parts(block)]
            yield pa.RecordBatch.from_arrays([block.column(key), pa.array(np.concatenate(scores))], names=[key, "score"])

    scored = narrow.mapInArrow(run, schema)
    return scored.select(key, F.coalesce(fold(key, folds) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``classify`` predicts to be good, as they are; texts stay where they are read."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, key, text, label, fold(key, folds) == 0, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text, 1 << 20):
            scores = np.concatenate([model.value.of(part) for part in parts(block)])
            yield block.batch.slice(block.lo, len(block)).filter(pa.array(scores >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)


def parts(block: Block, rows: int = ROWS) -> Iterator[Block]:
    """A block by at most ``rows`` rows: many short texts would make wide tables."""
    for lo in range(0, len(block), rows):
        hi = min(lo + rows, len(block))
        yield Block(block.batch, block.lo + lo, block.lo + hi, block.data[block.off[lo] : block.off[hi]], block.off[lo : hi + 1] - block.off[lo])


def op7_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
