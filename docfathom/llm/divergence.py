"""Source divergence audit: which terms set a source apart within its language, and how far sources are from each other.

1. Terms are counted in each task by language and source, then summed; a language keeps those that enough of its
   documents have.
2. A smoothed share p of each kept term is compared by f = floor((p - q)^2 / (p + q)); all arithmetic is on integers.
3. Ranking by radix select: histograms over the bits of the values, high bits first, find each group's threshold; of the
   values equal to it, histograms over the bytes of the terms find those that are still wanted.  Only what is left is ranked.
4. Pairs are sparse.  A term that neither source has adds f of the two shares of an absent term, the baseline; terms that
   one has or both have are counted as corrections to it.  One source's corrections follow from the histogram of its shares;
   those of terms that both have are summed in the tasks that hold the terms, and only the sums of pairs are exchanged.

No task holds more than a language's sources, a histogram, or a bounded table of counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import stored
from .textblocks import ascii_lower, blocks, word_strings, words

#: Documents of a language that a term needs; ranks of terms.
LEAST_DOCS, TOP = 10, 10
#: Bits of values that a histogram takes, high ones first; bytes of terms through which later ones look.
SHIFTS, DEPTHS = (16, 0), (4,)
#: Rows of counts, and sums of pairs, that a task holds before it sends them.
HELD = 1_000_000
_COUNTED = "lang string, source string, term string, n long, docs long"
_NAMES = ["lang", "source", "term", "n", "docs"]
#: Bits of a source's number within its language.
_BITS = 21


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each term in each language and source, and documents that have it: one row each for what a task holds."""
    held: list[pa.Table] = []
    size = 0

    def merged() -> pa.Table:
        table = pa.concat_tables(held).combine_chunks()
        return table.group_by(_NAMES[:3], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(_NAMES)

    for block in blocks(batches, "__text"):
        data = ascii_lower(block.data)
        start, end, first = words(data, block.off, (data >= 0x80) | ((data >= 0x61) & (data <= 0x7A)))
        if not len(start):
            continue
        seen = word_strings(data, start, end).dictionary_encode()
        term, size_terms = seen.indices.to_numpy().astype(np.int64), len(seen.dictionary)
        row = np.repeat(np.arange(len(block)), np.diff(first))
        langs, sources = block.column("lang").dictionary_encode(), block.column("source").dictionary_encode()
        pair = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        key, n = np.unique(pair[row] * size_terms + term, return_counts=True)
        once = np.unique(row * size_terms + term)  # a document's terms
        docs = np.unique(pair[once // size_terms] * size_terms + once % size_terms, return_counts=True)[1]
        where = key // size_terms
        arrays = [langs.dictionary.take(pa.array(where // len(sources.dictionary))), sources.dictionary.take(pa.array(where % len(sources.dictionary))), seen.dictionary.take(pa.array(key % size_terms)), pa.array(n), pa.array(docs)]
        held.append(pa.table(arrays, names=_NAMES))
        size += len(key)
        if size > HELD:
            held = [merged()]
            size = held[0].num_rows
            if 2 * size > HELD:
                yield from held[0].to_batches(100_000)
                held, size = [], 0
    if held:
        yield from merged().to_batches(100_000)


def _share(n: str, total: str, kept: str) -> str:
    """1 + floor(1000000000 * (n + 2) / (total + 2 * kept)) in SQL, null where nothing is kept."""
    return f"((CAST(1000000000 AS DECIMAL(10,0)) * CAST({n} + 2 AS DECIMAL(20,0))) DIV CAST(NULLIF({total} + 2 * {kept}, 0) AS DECIMAL(20,0)) + 1)"


def _apart(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)) in SQL."""
    return f"((({p} - {q}) * ({p} - {q})) DIV ({p} + {q}))"


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); 0 where both are 0."""
    d = p - q
    return d * d // np.maximum(p + q, 1)


def _narrowed(rows: DataFrame, digit: Column, *carried: str, descending: bool) -> DataFrame:
    """A pass: for each group the digit at which the wanted rows are reached (or the last one), and how many are wanted of it."""
    seen = rows.groupBy("lang", "source", digit.alias("digit")).agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("want", *carried)))
    by = Window.partitionBy("lang", "source").orderBy(F.col("digit").desc() if descending else F.col("digit"))
    before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = seen.withColumn("before", before).withColumn("last", F.lead("digit").over(by).isNull())
    return steps.filter("before < want AND (before + n >= want OR last)").select("lang", "source", F.col("digit").alias("at"), (F.col("want") - F.col("before")).alias("want"), *carried)


def radix_top(rows: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each lang and source by value (not negative, under 2 ** 33), then UTF-8 bytes of term, with ranks.

    ``rows`` (lang, source, term, value) are read once a pass and should be a table.
    """
    group = ["lang", "source"]
    state = _narrowed(rows.withColumn("want", F.lit(top).cast("long")), F.shiftright("value", SHIFTS[0]), descending=True)
    for before, shift in zip(SHIFTS, SHIFTS[1:], strict=False):
        same = rows.join(state, group).filter(F.shiftright("value", before) == F.col("at"))
        state = _narrowed(same, F.shiftright("value", shift), descending=True)
    state = state.withColumnRenamed("at", "least")
    start = lambda n: F.substring(F.encode("term", "utf-8"), 1, n)
    for i, depth in enumerate(DEPTHS):
        ties = rows.join(state, group).filter("value = least")
        state = _narrowed(ties.filter(start(DEPTHS[i - 1]) == F.col("at")) if i else ties, start(depth), "least", descending=False)
    left = rows.join(state, group).filter((F.col("value") > F.col("least")) | ((F.col("value") == F.col("least")) & (start(DEPTHS[-1]) <= F.col("at"))))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("value").desc(), "term"))
    return left.withColumn("rank", rank).filter(F.col("rank") <= top).select(*group, "term", "value", "rank")


_SUMS = "lang string, a int, b int, amount long"


def _sums(lang, a, b, amount) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(amount, pa.int64())], names=["lang", "a", "b", "amount"])


def shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms with their sources (number, share, share of an absent term): what terms of both sources add to each pair, summed.

    A source is compared with the one ``lag`` places after it in the term's list, for each lag in turn.
    """
    known: dict[str, int] = {}
    codes: list[np.ndarray] = []
    sums: list[np.ndarray] = []
    size = 0

    def merged() -> None:
        nonlocal size
        code, place = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.zeros(len(code), np.int64)
        np.add.at(total, place, np.concatenate(sums))
        codes[:], sums[:], size = [code], [total], len(code)

    def sent() -> pa.RecordBatch:
        names, mask = list(known), (1 << _BITS) - 1
        code = codes[0]
        return _sums([names[i] for i in (code >> 2 * _BITS).tolist()], code >> _BITS & mask, code & mask, sums[0])

    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column(batch.schema.get_field_index("counts"))
        number, p, absent = (lists.flatten().field(i).to_numpy().astype(np.int64) for i in range(3))
        length = np.diff(lists.offsets.to_numpy())
        lang = np.array([known.setdefault(x, len(known)) for x in batch.column(batch.schema.get_field_index("lang")).to_pylist()], np.int64)
        rest = np.repeat(np.cumsum(length), length) - np.arange(len(p))  # entries of the list from each one on
        lang = np.repeat(lang, length)
        for lag in range(1, int(length.max())):
            i = np.flatnonzero(rest > lag)
            j = i + lag
            codes.append(lang[i] << 2 * _BITS | number[i] << _BITS | number[j])
            sums.append(apart(p[i], p[j]) - apart(p[i], absent[j]) - apart(absent[i], p[j]) + apart(absent[i], absent[j]))
            size += len(i)
            if size > HELD:
                merged()
                if 2 * size > HELD:
                    yield sent()
                    codes.clear()
                    sums.clear()
                    size = 0
    if codes:
        merged()
        yield sent()


def one_sided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sources with the histogram of their shares, and all sources of the language: baselines of pairs, and what terms of one source add."""
    for batch in batches:
        for r in batch.to_pylist():
            numbers, absent = (np.array([x[k] for x in r["others"]], np.int64) for k in ("number", "absent"))
            own = int(r["absent"] or 0)
            level = apart(np.full(len(absent), own), absent)
            amount = np.where(numbers > r["number"], level * r["kept"], 0)
            for x in r["shares"] or ():
                amount += x["m"] * (apart(np.full(len(absent), x["p"]), absent) - level)
            other = numbers != r["number"]
            numbers, amount = numbers[other], amount[other]
            yield _sums([r["lang"]] * len(numbers), np.minimum(numbers, r["number"]), np.maximum(numbers, r["number"]), amount)


def divergence(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """The ``top`` terms that set each source apart within its language, and the distance of each pair of sources: lang, source, part, item, value, rank.

    Part ``term``: kept terms that the source uses more than the language does.  Part ``pair``: every other source of the
    language, by the sum over all kept terms.  Ranks go by value, high ones first, then by the item's UTF-8 bytes.
    Every language and source that occurs has its pairs, without any term too (then 0); null texts, languages and sources
    are empty ones; repeated rows are documents like others; an empty table gives no rows.  Other columns are ignored.
    """
    column = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = df.select(column(lang).alias("lang"), column(source).alias("source"), column(text).alias("__text"))
    group = ["lang", "source"]
    terms = docs.mapInArrow(counted, _COUNTED).groupBy(*group, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts"))
    kept = stored(by_term.filter(F.col("docs") >= least_docs).select("lang", "term", "total", "counts"))
    each = kept.select("lang", "term", "total", F.inline("counts"))
    own = each.groupBy(*group).agg(F.sum("n").alias("own_total"))
    whole = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    filled = docs.select(*group).distinct().join(own, group, "left").join(whole, "lang", "left").fillna(0, ["own_total", "kept", "lang_total"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    groups = stored(filled.withColumn("number", number).withColumn("absent", F.expr(_share("0", "own_total", "kept"))))

    shares = each.join(groups, group).withColumn("p", F.expr(_share("n", "own_total", "kept"))).withColumn("q", F.expr(_share("total", "lang_total", "kept")))
    rows = stored(shares.filter("p > q").select(*group, "term", F.expr(_apart("p", "q")).alias("value")))
    found = radix_top(rows, top).select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    both = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("number", "p", "absent"))).alias("counts")).filter(F.size("counts") > 1)
    common = both.select("lang", "counts").mapInArrow(shared_terms, _SUMS)
    histogram = shares.groupBy(*group, "p").agg(F.count("*").alias("m")).groupBy(*group).agg(F.collect_list(F.struct("p", "m")).alias("shares"))
    others = groups.groupBy("lang").agg(F.collect_list(F.struct("number", F.coalesce("absent", F.lit(0)).alias("absent"))).alias("others"))
    sided = groups.join(histogram, group, "left").join(others, "lang").select("lang", "number", "absent", "kept", "shares", "others").mapInArrow(one_sided, _SUMS)
    pairs = common.unionByName(sided).groupBy("lang", "a", "b").agg(F.sum("amount").alias("value"))
    ways = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("of"), F.col("b").alias("to")), F.struct(F.col("b").alias("of"), F.col("a").alias("to")))).alias("way"), "value").select("lang", "way.*", "value")
    names = groups.select("lang", "number", "source")
    named = ways.join(names.withColumnRenamed("number", "of"), ["lang", "of"]).join(names.select("lang", F.col("number").alias("to"), F.col("source").alias("item")), ["lang", "to"])
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("value").desc(), "item"))
    return found.unionByName(named.select(*group, F.lit("pair").alias("part"), "item", "value", rank.alias("rank")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))
