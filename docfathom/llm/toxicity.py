"""Toxicity by compression distance: windows of text under a dictionary of ordinary and one of toxic text.

Two zstandard dictionaries are trained, each on runs of words of labelled texts of its kind.  A window is WINDOW
pieces (words, long ones by parts, so that text without spaces has windows too), every STRIDE pieces.  It is
compressed with the ordinary dictionary, and with the toxic one before the ordinary one under the same entropy
tables: the bytes that toxic text saves are its evidence, and what ordinary text has saves none.

Two calibrations follow, on labelled texts that the dictionaries don't know: how much likelier each evidence is in
toxic texts (its log-ratio), and what share of texts is toxic by a text's sum of these over the root of its windows.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .labelled import fold, isotonic, learnable, sampled
from .store import stored

#: Labelled rows of each kind learnt from at most; tenths of them that make the dictionaries.
TOXIC_ROWS, ORDINARY_ROWS, DICTIONARY_TENTHS = 2000, 5000, 7
#: Words of a run that is a sample for the dictionaries, runs of a text and bytes of runs of a kind (beyond that, those of the least checksums).
RUN, TEXT_RUNS, TRAINED_BYTES = 40, 100, 12_000_000
#: Bytes of the dictionaries, and of the segments that they are made of.
TOXIC_BYTES, ORDINARY_BYTES, TOXIC_SEGMENT, ORDINARY_SEGMENT, STRING = 16_384, 262_144, 32, 200, 8
#: Pieces of a window, pieces from one window to the next, characters of a piece.
WINDOW, STRIDE, PIECE = 10, 8, 16
#: Evidence beyond which windows count alike.
LEAST, MOST = -3, 10
#: Score from which a text counts as toxic; added to a text's number of windows, so that very short texts don't decide by one.
TOXIC_FROM, SMOOTH = 0.3, 5.0
#: Pieces that are compressed at once.
AT_ONCE = 1 << 15
_NO_LETTERS, _PIECES = re.compile(r"[\W\d_]+"), re.compile(rf" ?[^ ]{{1,{PIECE}}}")
#: What stands before a trained dictionary's content: the three offsets that a frame starts with (fixed value of the format).
_BEFORE_CONTENT = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def spelled(text: str | None) -> str:
    """Lower-case letters, all else one space."""
    return " " + _NO_LETTERS.sub(" ", (text or "").lower()).strip()


def windows(text: str | None) -> Iterator[list[bytes]]:
    """All windows of a whole text, some at a time; a text without letters has none."""
    pieces = (m.group(0) for m in _PIECES.finditer(spelled(text)))
    held: list[str] = []
    while part := list(itertools.islice(pieces, AT_ONCE)):
        held += part
        full = (len(held) - WINDOW) // STRIDE + 1 if len(held) > WINDOW else 0
        yield [f"{''.join(held[a : a + WINDOW])} ".encode("utf-8", "replace") for a in range(0, full * STRIDE, STRIDE)]
        held = held[full * STRIDE :]
        if full and len(held) <= WINDOW - STRIDE and len(part) < AT_ONCE:
            return  # what is left is in the last window
    if held:
        yield [f"{''.join(held)} ".encode("utf-8", "replace")]


def runs(text: str | None) -> list[bytes]:
    """The samples of a text: runs of RUN words."""
    words = spelled(text).split()
    return [f" {' '.join(words[a : a + RUN])} ".encode("utf-8", "replace") for a in range(0, len(words), RUN)]


def trained(samples: list[bytes], size: int, segment: int) -> tuple[bytes, bytes]:
    """Entropy tables and content of a dictionary; too little text for a training is the content itself."""
    size = max(256, min(size, sum(map(len, samples)) // 8))
    try:
        made = zstandard.train_dictionary(size, samples, k=segment, d=STRING, f=20, accel=1, level=6).as_bytes()
        at = made.index(_BEFORE_CONTENT) + len(_BEFORE_CONTENT)
    except (zstandard.ZstdError, ValueError):
        return b"", b"".join(samples)[-8 * size :]
    return made[:at], made[at:]


class Distance:
    """Bytes that windows save with the toxic dictionary before the ordinary one."""

    def __init__(self, toxic: bytes, ordinary: bytes, tables: bytes):
        self.parts = (toxic, ordinary, tables)
        self.plain, self.toxic = (self._compressor(x, tables) for x in (ordinary, toxic + ordinary))

    @staticmethod
    def _compressor(content: bytes, tables: bytes) -> zstandard.ZstdCompressor:
        kind = zstandard.DICT_TYPE_FULLDICT if tables else zstandard.DICT_TYPE_RAWCONTENT
        data = zstandard.ZstdCompressionDict(tables + content.ljust(8), dict_type=kind)
        how = zstandard.ZstdCompressionParameters(window_log=19, hash_log=17, chain_log=18, search_log=5, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
        data.precompute_compress(compression_params=how)  # or each call would digest it anew
        return zstandard.ZstdCompressor(dict_data=data, compression_params=how)

    def __reduce__(self):
        return Distance, self.parts

    def saved(self, some: list[bytes]) -> np.ndarray:
        plain, toxic = (np.fromiter(map(len, c.multi_compress_to_buffer(some, threads=1)), np.int64, len(some)) for c in (self.plain, self.toxic))
        return plain - toxic

    def histogram(self, text: str | None) -> np.ndarray:
        """How many windows of a text save LEAST, ..., MOST bytes."""
        out = np.zeros(MOST - LEAST + 1, np.int64)
        for some in windows(text):
            if some:
                out += np.bincount(np.clip(self.saved(some), LEAST, MOST) - LEAST, minlength=len(out))
        return out


class Model:
    """Evidence of texts, and its two calibrations."""

    def __init__(self, distance: Distance, weights: np.ndarray, knots: np.ndarray, values: np.ndarray):
        self.distance, self.weights, self.knots, self.values = distance, weights, knots, values

    def evidence(self, histogram: np.ndarray) -> np.ndarray:
        """Rows of window counts to each text's evidence."""
        return histogram @ self.weights / np.sqrt(histogram.sum(axis=1) + SMOOTH)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(evidence, self.knots, self.values), 0.0, 1.0)


def log_ratios(histogram: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each evidence how much likelier toxic texts' windows have it than others'; unseen ones none."""
    both = np.stack([histogram[y == k].sum(axis=0) for k in (0, 1)]).astype(float)
    if not both.sum(axis=1).all():
        return np.zeros(histogram.shape[1])
    prior = both.sum(axis=0) / both.sum()
    share = (both + 40 * prior) / (both.sum(axis=1, keepdims=True) + 40)
    return np.where(prior > 0, np.log(np.maximum(share[1], 1e-300) / np.maximum(share[0], 1e-300)), 0.0)


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, kept_out) -> Model:
    """Dictionaries and calibrations from a bounded sample of labelled rows (TOXIC_ROWS, ORDINARY_ROWS, TRAINED_BYTES)."""
    spark = docs.sparkSession
    rows = learnable(labels, key, label, kept_out)
    counts = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    share = np.full(1, counts.get(1, 0) / max(sum(counts.values()), 1))
    chosen = sampled(rows.filter("y = 1"), key, TOXIC_ROWS).unionByName(sampled(rows.filter("y = 0"), key, ORDINARY_ROWS))
    chosen = chosen.withColumn("makes", F.pmod(F.xxhash64(key, F.lit("dictionary")), F.lit(10)) < DICTIONARY_TENTHS)
    texts = stored(docs.select(F.col(key), F.col(text).alias("__text")).join(F.broadcast(chosen), key).select("__text", "y", "makes"))
    size = {r["y"]: r["n"] for r in texts.filter("makes").groupBy("y").agg(F.sum(F.octet_length(F.coalesce("__text", F.lit("")))).alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return Model(Distance(b"", b"", b""), np.zeros(MOST - LEAST + 1), np.zeros(1), share)
    limit = [min(1.0, TRAINED_BYTES / size[y]) * (1 << 32) for y in (0, 1)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = runs(t)
                name, most = zlib.crc32(b"".join(own)), sorted(map(zlib.crc32, own))[: TEXT_RUNS][-1:]
                out += [(y, name, i, r) for i, r in enumerate(own) if zlib.crc32(r) <= min(limit[y], most[0])]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["y", "name", "nth", "run"])

    # At most about TRAINED_BYTES of each kind, whatever the tables' size.  The training goes along the samples part by
    # part and takes the best segment of each: texts stay whole there, one after another.
    samples = texts.filter("makes").select("__text", "y").mapInArrow(cut, "y int, name long, nth long, run binary").toArrow()
    samples = samples.sort_by([(c, "ascending") for c in ("y", "name", "nth", "run")])
    by = [samples.filter(pa.compute.equal(samples.column("y"), k)).column("run").to_pylist() for k in (0, 1)]
    tables, ordinary = trained(by[0], ORDINARY_BYTES, ORDINARY_SEGMENT)
    distance = Distance(trained(by[1], TOXIC_BYTES, TOXIC_SEGMENT)[1], ordinary, tables)
    sent = spark.sparkContext.broadcast(distance)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.histogram(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], names=["y", "histogram"])

    got = texts.filter("not makes").select("__text", "y").mapInArrow(measure, "y int, histogram binary").toArrow().sort_by([("y", "ascending"), ("histogram", "ascending")])
    y = got.column("y").to_numpy()
    histogram = np.frombuffer(b"".join(got.column("histogram").to_pylist()), np.int64).reshape(len(y), -1) if len(y) else np.zeros((0, MOST - LEAST + 1), np.int64)
    model = Model(distance, log_ratios(histogram, y), np.zeros(1), share)
    if len(y):
        weight = np.where(y == 1, counts.get(1, 0) / max((y == 1).sum(), 1), counts.get(0, 0) / max((y == 0).sum(), 1))
        model.knots, model.values = isotonic(model.evidence(histogram), y.astype(float), weight)
    return model


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, kept_out: int = 2) -> DataFrame:
    """Score every whole text: the key, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from TOXIC_FROM on), ``evidence``.

    Labels of rows whose fold is ``kept_out`` are not learnt from.  A null or empty text, or one without letters, has no
    windows, evidence 0 and the score of that; without labels of both kinds every score is the share of label 1.
    Repeated rows score alike; a key that several rows have lends its label to all of them; a null key is kept, never held
    out and never learnt from.  Very long texts are compressed some windows at a time.  Other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(fit(docs, labels, key, text, label, fold(key, folds) == kept_out))
    narrow = docs.select(F.col(key), F.col(text).alias("__text"))
    schema = f"`{key}` {narrow.schema[key].dataType.simpleString()}, evidence double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            if batch.num_rows:
                found = model.evidence(np.stack([model.distance.histogram(t.as_py()) for t in batch.column(1)]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array(model.score(found))], names=[key, "evidence", "score"])

    scored = narrow.mapInArrow(run, schema)
    return scored.select(key, F.coalesce(fold(key, folds) == kept_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "evidence")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
