"""Personal data by candidate boosting, in DataFrame functions only.

Base rules find spans by fixed patterns.  High-recall generators propose more, where a base match fails because
it swallows what stands next to it, or forms that the base rules don't know.  Boosted trees on format and context
score each proposal; a threshold calibrated for precision selects.  The trees are fitted once on made-up examples
(``examples``), so no label of any table is needed, and become one SQL expression.

A text's pieces between matches give the matches' places, as running sums.  All of it is done within the row, by functions
of arrays in time about proportional to the text and its matches: nothing is exchanged between tasks.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import boost, log_odds, log_odds_column

KINDS = ("email", "ip", "card", "phone")
#: Base patterns.  Possessive repeats match what greedy ones do here, without a stack for long runs; the looks
#: behind (or at the end of the last match) keep a run from being tried at each of its characters.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of proposals.
PROPOSED = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]{1,63}){1,6}",
    "ip": r"(?<![0-9])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:\x20[0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}|[0-9]{13,19})(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|(?<![0-9])[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: Words that speak for or against personal data when they stand before it.
FOR_IT = r"(?i)\b(?:card|visa|mastercard|amex|credit|tel|phone|call|mobile|cell|fax|mail|contact|ip|host|server|address)\b"
AGAINST_IT = r"(?i)\b(?:version|isbn|order|invoice|license|section|serial|token|hash|sku|ref|release|build|figure|table)\b"
#: Characters of context before and after.
BEFORE, AFTER = 24, 4
#: Number of features of a proposal.
FEATURES = 16
#: Precision on held-out examples that the threshold is calibrated for.
PRECISION = 0.99


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    n = F.length(d)
    total = F.lit(0)
    for i in range(19):  # i-th from the right
        x = F.when(n > i, F.substring(d, n - i, F.lit(1)).cast("int")).otherwise(0)
        total = total + (x if i % 2 == 0 else F.when(x > 4, 2 * x - 9).otherwise(2 * x))
    return (n > 0) & (n <= 19) & (total % 10 == 0)


def octets(m: Column) -> Column:
    """Whether all dotted parts are at most 255."""
    return F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.lit(False)) & (F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def valid(kind: Column, m: Column) -> Column:
    d = digits(m)
    n = F.length(d)
    return (
        F.when(kind == "card", n.between(14, 19) & luhn(F.substring(d, 1, 19)))
        .when(kind == "phone", n.between(10, 15))
        .when(kind == "ip", octets(m))
        .otherwise(F.lit(True))
    )


def features(kind: Column, m: Column, before: Column, after: Column) -> list[Column]:
    d = digits(m)
    n = F.length(d)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return [
        F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("double"),
        n.cast("double"),
        F.length(m).cast("double"),
        flag(F.when(n.between(13, 19), luhn(F.substring(d, 1, 19)))),
        F.coalesce(F.substring(d, 1, 1).try_cast("double"), F.lit(-1.0)),
        flag(before.rlike(r"[A-Za-z0-9]$")),
        flag(after.rlike(r"^[A-Za-z0-9]")),
        flag(before.rlike(r"[._/=-]$")),
        flag(after.rlike(r"^[._/=-][0-9A-Za-z]")),
        flag(before.rlike(FOR_IT)),
        flag(before.rlike(AGAINST_IT)),
        F.length(F.regexp_replace(m, r"[^\x20().-]", "")).cast("double"),
        flag(F.when(kind == "ip", octets(m))),
        flag(m.contains("@")),
        flag(m.startswith("+")),
        F.size(F.array_distinct(F.split(F.substring(d, 1, 19), ""))).cast("double"),
    ]


def examples(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Made-up proposals (kind, match, before, after, is personal data) for the trees."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))

    def checked(k: int, ok: bool, first: str) -> str:
        few = "".join(rng.choice("0123456789") for _ in range(2))
        body = first + (num(k - 2) if rng.random() < 0.6 else "".join(rng.choice(few + first) for _ in range(k - 2)))
        total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(body))))
        last = -total % 10
        return body + str(last if ok else (last + rng.randint(1, 9)) % 10)

    def grouped(d: str, sep: str) -> str:
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    out = []
    for _ in range(n):
        kind, good = rng.choice(KINDS), rng.random() < 0.5
        before = f"{word()} {word()} "
        after = rng.choice([" " + word()[:3], ". " + word()[:2], ", ", "", "\n", "!! ", "### ", " | "])
        hint = rng.random()
        if kind == "card":
            if good:
                d = checked(rng.choice([16, 16, 16, 15, 13, 19]), True, rng.choice("123456789"))
                m = grouped(d, rng.choice(["", "", " ", "-"])) if len(d) == 16 else d
                before = rng.choice([before, "card ", "visa: ", f"{num(16)} ", f"{num(3)}.{num(2)} "]) if hint < 0.6 else before
                after = rng.choice([after, f" {num(3)}", f" {num(4)}"])
            else:
                m = rng.choice([checked(16, False, "4"), checked(13, False, "9"), checked(14, False, "2"), checked(18, False, "7"), num(1) * 16, checked(16, True, "5")])
                if m[:2] == "5" + m[1] or hint < 0.5:
                    before = rng.choice(["order ", "token ", "serial ", "isbn ", f"{word()}=0x", f"{word()}a", f"{num(2)}."])
                    after = rng.choice([after, "ab3f", ".25", "e7"])
        elif kind == "phone":
            if good:
                area, a, b = num(3), num(3), num(4)
                m = rng.choice([f"+1 ({area}) {a}-{b}", f"({area}) {a}-{b}", f"+1-{area}-{a}-{b}", f"{area}-{a}-{b}", f"+44 {area} {a} {b}"])
                before = rng.choice([before, "call ", "tel. ", "phone: "]) if hint < 0.5 else before
                after = rng.choice([after, f" {num(3)}", f" {num(3)}"])
            else:
                m = rng.choice([f"{num(3)} {num(3)} {num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"{num(3)}-{num(3)}-{num(4)}"])
                before = rng.choice(["order ", "isbn ", "version ", f"{num(2)}-", f"{num(3)}.", "ref ", f"{word()}-", "serial ", f"{num(4)} "])
                after = rng.choice([after, f".{num(3)}", f"-{num(2)}"])
        elif kind == "ip":
            if good:
                m = ".".join(str(rng.randint(0, 255)) for _ in range(4))
                before = rng.choice([before, "host ", "ip ", "server "]) if hint < 0.5 else before
                after = rng.choice([after, ":80", f" {num(3)}"])
            else:
                m = rng.choice([".".join(str(rng.randint(0, 9)) for _ in range(4)), ".".join(str(rng.randint(256, 999)) for _ in range(4))])
                before = rng.choice(["version ", "section ", "release ", f"{num(1)}.", "build ", f"{word()}-"])
                after = rng.choice([after, ".1", ".2", "-b", "a"])
        else:
            host = rng.choice([f"{word()}.com", f"mail.{word()}.org", f"{word()}.co.uk"])
            if good:
                m = rng.choice([f"{word()}.{word()}@{host}", f"{word()}{num(2)}@{host}", f"{word()} (at) {host.replace('.', ' (dot) ')}", f"{word()}[at]{host}", f"{word()} [at] {host}"])
            else:
                m = rng.choice([f"{word()} @ {num(1)}.{num(2)}", f"{word()}@{num(1)}.{num(1)}.{num(1)}", f"{word()} @{num(2)}.{num(2)}", f"{num(2)} @ {num(3)}.{num(2)}"])
                before = rng.choice([before, "version ", "build ", "order "])
        out.append((kind, m, before[-BEFORE:], after[:AFTER], int(good)))
    return out


@functools.lru_cache(maxsize=1)
def trained(spark: SparkSession) -> tuple[list, float]:
    """The trees, and the log-odds from which a proposal is taken: fitted on two thirds of the examples, calibrated on the rest."""
    rows = spark.createDataFrame(examples(), "kind string, m string, b string, a string, y int")
    got = rows.select(F.array(*features(F.col("kind"), F.col("m"), F.col("b"), F.col("a"))).alias("x"), "y").collect()
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float)
    fit = np.arange(len(y)) % 3 != 0
    trees = boost(x[fit], y[fit])
    odds, truth = log_odds(trees, x[~fit]), y[~fit]
    order = np.argsort(-odds, kind="stable")
    precision = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    return trees, max(0.0, float(odds[order[good[-1]]]) if len(good) else 0.0)


_FOUND = "array<struct<code:int,source:int,whole:bigint,wide:int,tail:string,head:string,m:string>>"
_SPANS = "array<struct<start:bigint,code:int,end:bigint>>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is made once, however often it is used."""
    return F.transform(F.array(value), lambda v: then(v))[0]


def running(values: Column, start: int, step: Callable[[Column, Column], Column]) -> Column:
    """The running ``step`` of an array of longs (an associative one, of which ``start`` is neutral), by blocks of BLOCK values."""

    zero = F.lit(start).cast("long")
    along = lambda some, of: F.slice(F.aggregate(some, F.array(zero), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), of(x))))), F.lit(2), F.lit(BLOCK))
    cuts = lambda v: F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
    within = lambda v: F.transform(cuts(v), lambda c: along(F.slice(v, c * BLOCK + 1, F.lit(BLOCK)), lambda x: x))
    before = lambda w: F.aggregate(w, F.array(zero), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), F.element_at(x, -1)))))
    whole = lambda w: let(before(w), lambda b: F.flatten(F.transform(w, lambda some, i: let(b[i], lambda carried: F.transform(some, lambda x: step(carried, x))))))
    return let(values, lambda v: F.when(F.size(v) > 0, let(within(v), whole)).otherwise(F.array().cast("array<bigint>")))


def _sets(text: Column, pattern: str, code: int, source: int) -> Column:
    """Matches in order, each with the lengths of what stands before it and of itself; the last entry is the piece after all."""
    one = lambda p, m: F.struct(
        F.lit(code).alias("code"), F.lit(source).alias("source"), (F.length(p) + F.coalesce(F.length(m), F.lit(0))).cast("long").alias("whole"),
        F.length(m).alias("wide"), F.right(p, F.lit(BEFORE)).alias("tail"), F.left(p, F.lit(AFTER)).alias("head"), m.alias("m"),
    )
    return F.when(text.rlike(pattern), F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one)).otherwise(F.array().cast(_FOUND))


#: A cheap sign that a text can hold a span at all.
_ANY = r"[0-9@]|\(at\)|\[at\]"
#: Values of an array that are summed up at once, characters of a text that are cut at once.
BLOCK, CUT = 128, 1024
#: Places of one kind come before those of the next (a text has fewer characters).
_LINE = 1 << 40


def _with_spans(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``__base`` and ``__spans``."""
    trees, threshold = trained(df.sparkSession)
    rows = df.withColumn("__some", F.when(F.col(text).rlike(_ANY), F.col(text)).otherwise(F.lit("")))
    sets = [_sets(F.col("__some"), pattern, KINDS.index(kind), source) for source, patterns in enumerate((BASE, PROPOSED)) for kind, pattern in patterns.items()]
    rows = rows.withColumn("__sets", F.array(*sets))

    def placed(found: Column) -> Column:
        def at(ends: Column) -> Column:
            return F.transform(found, lambda r, i: F.struct(r["code"].alias("code"), r["source"].alias("source"), (ends[i] - r["wide"]).alias("start"), ends[i].alias("end"), r["m"].alias("m"), r["tail"].alias("tail"), F.coalesce(F.try_element_at(found, i + 2)["head"], F.lit("")).alias("after")))

        return F.filter(let(running(F.transform(found, lambda r: r["whole"]), 0, lambda x, y: x + y), at), lambda r: r["m"].isNotNull())

    kind = lambda r: F.element_at(F.array(*map(F.lit, KINDS)), r["code"] + 1)
    span = lambda r: F.struct(r["start"], r["code"], r["end"])
    rows = rows.withColumn("__all", F.flatten(F.transform("__sets", placed)))
    rows = rows.withColumn("__base", F.array_sort(F.transform(F.filter("__all", lambda r: (r["source"] == 0) & valid(kind(r), r["m"])), span)))
    # Features in an array of their own: written out in each node of the trees, they would be made for each.
    scored = F.transform(F.filter("__all", lambda r: r["source"] == 1), lambda r: F.struct(r["start"].alias("start"), r["code"].alias("code"), r["end"].alias("end"), F.array(*features(kind(r), r["m"], r["tail"], r["after"])).alias("x")))
    rows = rows.withColumn("__more", F.transform(F.filter(scored, lambda r: log_odds_column(trees, [r["x"][j] for j in range(FEATURES)]) >= threshold), span))
    # A proposal that overlaps a base span of its kind goes.  In one line of all spans by kind and place, that is one
    # where the furthest end of base spans before, or the nearest start of those after, is inside.
    flat = lambda spans, base: F.transform(spans, lambda r: F.struct((r["code"] * F.lit(_LINE) + r["start"]).alias("start"), (r["code"] * F.lit(_LINE) + r["end"]).alias("end"), F.lit(base).alias("base"), span(r).alias("span")))
    rows = rows.withColumn("__line", F.array_sort(F.concat(flat(F.col("__base"), True), flat(F.col("__more"), False))))
    far = running(F.transform("__line", lambda r: F.when(r["base"], r["end"]).otherwise(F.lit(-1).cast("long"))), -1, lambda x, y: F.greatest(x, y))
    near = F.reverse(running(F.reverse(F.transform("__line", lambda r: F.when(r["base"], r["start"]).otherwise(F.lit(1 << 60)))), 1 << 60, lambda x, y: F.least(x, y)))
    # What a function of elements looks up is bound by ``let``: a column would be made again for each element.
    kept = let(far, lambda f: let(near, lambda n: F.filter("__line", lambda r, i: r["base"] | ((f[i] <= r["start"]) & (n[i] >= r["end"])))))
    spans = F.array_sort(F.transform(kept, lambda r: r["span"]))
    return rows.withColumn("__spans", F.when(F.size("__more") > 0, spans).otherwise(F.col("__base")))


def find_spans(df: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``df``: the ``carry`` columns, ``base`` and ``spans``, ordered arrays of (start, code, end).

    ``code`` is a place in KINDS; places are code points, ends exclusive.  Base spans are always among ``spans``.
    A null or empty text has no spans.  Repeated rows and null keys are kept; an empty table gives no rows.
    """
    named = df.select(*(F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return _with_spans(named, "__text").select(*(F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)), F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def joined(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["code"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of base spans by kind, ``base_sha256`` and all ``spans`` of every whole text (see ``find_spans``)."""
    found = find_spans(df, text, (key,))
    count = lambda i: F.size(F.filter("base", lambda s: s["code"] == i)).cast("long")
    return found.select(key, *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span in ``text`` replaced by its kind in angle brackets; overlapping spans are one, named by the first.

    A null text stays null, an empty one empty; repeated rows, null keys and extra columns, whatever their names, stay as
    they are; an empty table gives no rows.
    """
    columns = df.columns
    own = [f"__k{i}" for i in range(len(columns))]  # names that clash with nothing
    body = F.col(own[columns.index(text)])
    rows = _with_spans(df.toDF(*own).withColumn("__text", F.coalesce(body, F.lit(""))), "__text")
    # Where a span starts beyond all ends before it, a replaced stretch starts; before that, one ends.
    ends = running(F.transform("__spans", lambda r: r["end"]), -1, lambda x, y: F.greatest(x, y))

    def stretches(ends: Column, spans: Column) -> Column:
        last = F.size(ends) - 1
        head = lambda i: (i == 0) | (spans[i]["start"] >= ends[F.greatest(i - 1, F.lit(0))])
        heads = F.filter(spans, lambda r, i: head(i))
        stops = F.filter(ends, lambda e, i: (i == last) | head(F.least(i + 1, last)))
        return F.zip_with(heads, stops, lambda r, e: F.struct(r["start"].alias("start"), r["code"].alias("code"), e.alias("end")))

    rows = rows.withColumn("__stretches", let(ends, lambda e: let(F.col("__spans"), lambda spans: stretches(e, spans))))

    def between(blocks: Column, a: Column, b: Column) -> Column:
        part = lambda k: F.substring(blocks[k.cast("int")], (F.greatest(a - k * CUT, F.lit(0)) + 1).cast("int"), (F.least(b, (k + 1) * CUT) - F.greatest(a, k * CUT)).cast("int"))
        return F.when(a < b, F.array_join(F.transform(F.sequence(F.floor(a / CUT), F.floor((b - 1) / CUT)), part), "")).otherwise(F.lit(""))

    names = F.array(*(F.lit(f"<{k}>") for k in KINDS))

    def filled(blocks: Column, some: Column, wide: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(some[F.greatest(i - 1, F.lit(0))]["end"])
        pieces = F.transform(some, lambda r, i: F.concat(between(blocks, before(i), r["start"]), F.element_at(names, r["code"] + 1)))
        return F.concat(F.array_join(pieces, ""), between(blocks, F.element_at(some, -1)["end"], wide))

    cut = F.regexp_extract_all("__text", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    new = F.when(F.size("__spans") == 0, body).otherwise(let(cut, lambda blocks: let(F.col("__stretches"), lambda some: let(F.length("__text").cast("long"), lambda wide: filled(blocks, some, wide)))))
    return rows.select(*(new.alias(c) if c == text else F.col(k).alias(c) for k, c in zip(own, columns, strict=True)))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
