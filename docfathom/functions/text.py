"""Text as columns: normal forms, terms, snippets, addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as retrieval understands it (fixed values).
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Terms that carry no meaning in a question (fixed values).
NOISE_TERMS = ("什么", "么是", "什么是", "是什", "介绍", "一下", "解释", "如何", "怎么", "为啥", "为什么", "请问", "告诉")
LATIN_TERM = r"[a-z0-9][a-z0-9_.+#-]*"
HAN_RUN = r"[\x{4e00}-\x{9fff}]+"


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def condensed(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text(c), SPACE + "+", " "))


def normalized(c: Column) -> Column:
    return condensed(F.lower(c))


def snippet(c: Column, most: int) -> Column:
    """At most ``most`` characters, marked if cut."""
    whole = condensed(c)
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.trim(F.substring(whole, 1, most)), F.lit("...")))


def terms(c: Column) -> Column:
    """Latin terms in order, then the pairs of neighbours in each run of Han characters (single ones as they are)."""
    return terms_of(normalized(c))


def terms_of(base: Column) -> Column:
    """``terms`` of a text that is in normal form."""
    runs = F.regexp_extract_all(base, F.lit(HAN_RUN), F.lit(0))
    pairs = F.transform(runs, lambda s: F.when(F.length(s) == 1, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(2)))))
    return F.concat(F.regexp_extract_all(base, F.lit(LATIN_TERM), F.lit(0)), F.flatten(pairs))


def question_terms(c: Column) -> Column:
    return F.array_except(F.array_distinct(terms(c)), F.array(*map(F.lit, NOISE_TERMS)))


def coverage(of_terms: Column, inside: Column) -> Column:
    """Share of terms that a normalized text contains; 0 without terms."""
    n = F.size(of_terms)
    return F.when(n > 0, F.size(F.filter(of_terms, lambda t: inside.contains(t))) / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0))


def clean_list(c: Column) -> Column:
    """Items trimmed, blank ones left out."""
    return F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(text(x))), lambda x: x != "")


def joined_nonblank(separator: str, *parts: Column) -> Column:
    return F.array_join(F.filter(F.array(*map(text, parts)), lambda x: F.trim(x) != ""), separator)


def allowed_url(c: Column, origin: str) -> Column:
    """A path or https address of our own origin, without credentials, double slash or backslash."""
    raw = F.trim(text(c))
    own = F.lower(raw).startswith(origin.lower())
    rest = F.substring(raw, len(origin) + 1, 2**31 - 1)
    return F.when(raw.startswith("/"), ~raw.startswith("//") & ~raw.contains("\\")).otherwise(own & ~raw.contains("\\") & rest.rlike(r"^(?:$|[/?#])"))


def normal_url(c: Column, origin: str) -> Column:
    """Origin and path with one slash at the end; empty if it isn't allowed."""
    raw = F.trim(text(c))
    path = F.when(raw.startswith("/"), raw).otherwise(F.substring(raw, len(origin) + 1, 2**31 - 1))
    path = F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), "/+$", "")
    return F.when(allowed_url(c, origin), F.concat(F.lit(origin), path, F.lit("/"))).otherwise(F.lit(""))


def is_definition_question(c: Column) -> Column:
    return text(c).rlike("什么是|是什么|定义|指什么|指的是")


def question_mode(c: Column) -> Column:
    return F.when(text(c).rlike("总结|概括|摘要"), "page_summary").when(text(c).rlike("这篇|本文|本页|当前页|这一页"), "page").otherwise("site")


def published(c: Column) -> Column:
    """Front matter's flag: published unless it says false, no, off or 0 (comment and quotes aside)."""
    return ~_flag(c).rlike("(?i)^(false|no|off|0)$")


def draft(c: Column) -> Column:
    return _flag(c).rlike("(?i)^(true|yes|on|1)$")


def _flag(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text(c), r"\s+#.*$", ""), "^\\s*['\"]|['\"]\\s*$", ""))


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, *p), pairs, c)


def code_language(c: Column) -> Column:
    """First word of a fence's info string, safe characters only, at most 40; ``text`` if none."""
    word = F.substring(F.regexp_replace(F.lower(F.element_at(F.split(F.trim(text(c)), r"\s+"), 1)), "[^a-z0-9_+-]", ""), 1, 40)
    return F.when(word == "", "text").otherwise(word)


def safe_error_code(c: Column, fallback: str) -> Column:
    return F.when(text(c).rlike("^[A-Za-z0-9_.-]{1,64}$"), c).otherwise(F.lit(fallback))


def has_negation(c: Column) -> Column:
    """Word boundaries are those of ASCII, as in the studied behaviour and in SQL; Java's ``\\b`` takes accented letters for parts of words."""
    return text(c).rlike(r"(?i)(?:不是|没有|没(?:有|能|法)?|无|非|未|不能|不会|无法|禁止|避免|拒绝|(?<![0-9a-z_])(?:not|no|never|without)(?![0-9a-z_]))")


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(text(c), F.lit(r"\d+(?:\.\d+)?%?"), F.lit(0))


def parse_ordinal(c: Column) -> Column:
    """1 to 10 from a Chinese numeral or digits; 0 if unknown."""
    names = "一二三四五六七八九十"
    value = F.locate(F.trim(text(c)), F.lit(names))
    return F.when(F.length(F.trim(text(c))) == 1, F.when(value > 0, value).otherwise(F.coalesce(F.trim(text(c)).try_cast("int"), F.lit(0)))).otherwise(F.coalesce(F.when(F.trim(text(c)).rlike(r"^\d{1,9}$"), F.trim(text(c)).cast("int")), F.lit(0)))


def date_prefix(c: Column) -> Column:
    """The calendar day that a text begins with (``Y-M-D`` or ``Y/M/D``), without any time zone."""
    part = lambda i: F.regexp_extract(text(c), r"^\s*(\d{4})[-/](\d{1,2})[-/](\d{1,2})", i)
    return F.try_to_date(F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")), "yyyy-MM-dd")


def html_text(c: Column) -> Column:
    return F.regexp_replace(text(c), "<[^>]+>", "")
