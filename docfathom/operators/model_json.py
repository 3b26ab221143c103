"""JSON in the answers of language models: found in what is around it, read as VARIANT, its shape asserted path by path."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fence that an answer may stand in.
FENCE_BEFORE, FENCE_AFTER = r"(?i)^```(?:json)?\s*", r"\s*```$"
#: What a text is read by: an escaped character, a quote or brace, anything else up to the next of these.
_TOKEN = r'(?s)(\\.?|["{}]|[^\\"{}]+)'


@dataclass(frozen=True)
class Rule:
    """What stands at ``path`` (names joined by dots; ``[]`` is each element of a list) must be of ``kind``: string, boolean, number, array or object."""

    path: str
    kind: str
    needed: bool = True
    most: int | None = None


#: The shape of an answer made of claims, and of a verification of claims.
GROUNDED = (
    Rule("claims", "array", most=3), Rule("claims[]", "object"), Rule("claims[].id", "string"), Rule("claims[].subquestionId", "string"), Rule("claims[].text", "string"), Rule("claims[].quote", "string"),
    Rule("claims[].citationIds", "array"), Rule("claims[].citationIds[]", "string"), Rule("unansweredSubquestions", "array", needed=False), Rule("unansweredSubquestions[]", "string"),
)
VERIFICATION = (
    Rule("claims", "array"), Rule("claims[]", "object"), Rule("claims[].id", "string"), Rule("claims[].supported", "boolean"), Rule("claims[].directlyAnswers", "boolean"), Rule("claims[].reasonCode", "string"),
    Rule("subquestions", "array"), Rule("subquestions[]", "object"), Rule("subquestions[].id", "string"), Rule("subquestions[].covered", "boolean"), Rule("memoryDelta", "object"),
    Rule("memoryDelta.activeTopic", "string"), Rule("memoryDelta.summaryUpdate", "string"), Rule("memoryDelta.explicitLearningProgress", "array"), Rule("memoryDelta.responsePreferences", "array"),
)


def _once(c: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, however often it names it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def bare(c: Column) -> Column:
    """An answer without the fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), FENCE_BEFORE, ""), FENCE_AFTER, ""))


def first_object(c: Column) -> Column:
    """From the first opening brace to the one that closes it, braces in strings apart; null if none closes it."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(0).alias("at"), F.lit(-1).alias("start"), F.lit(-1).alias("stop"))

    def step(s: Column, t: Column) -> Column:
        inside = (s["start"] >= 0) & (s["stop"] < 0)
        opens, closes = (t == "{") & ~s["quoted"] & (s["stop"] < 0), (t == "}") & ~s["quoted"] & inside
        depth = s["depth"] + opens.cast("int") - closes.cast("int")
        return F.struct(
            depth.alias("depth"), F.when((t == '"') & inside, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), (s["at"] + F.length(t)).alias("at"),
            F.when(opens & (s["start"] < 0), s["at"]).otherwise(s["start"]).alias("start"), F.when(closes & (depth == 0), s["at"] + 1).otherwise(s["stop"]).alias("stop"),
        )

    cut = F.aggregate(F.regexp_extract_all(c, F.lit(_TOKEN), F.lit(1)), start, step, lambda s: F.struct(s["start"], s["stop"]))
    return _once(cut, lambda x: F.when(x["stop"] >= 0, F.substring(c, x["start"] + 1, x["stop"] - x["start"])))


def whole(c: Column) -> Column:
    """An answer that is JSON and nothing else, fence apart, as VARIANT; else null.

    The parser stops behind the first value, so the answer is read as a member with another one behind it.  An
    object that has a name twice is no VARIANT: null.
    """
    return _whole(bare(c))


def _whole(c: Column) -> Column:
    held = F.try_parse_json(F.concat(F.lit('{"value":'), c, F.lit(r',"\u0003":0}')))
    return _once(held, lambda h: F.when(F.try_variant_get(h, "$['\u0003']", "int") == 0, _at(h, "value")))


def parsed(c: Column) -> Column:
    """An answer as VARIANT: the whole of it, or else its first whole object; null if neither is JSON."""
    return _once(bare(c), lambda b: F.coalesce(_whole(b), F.try_parse_json(first_object(b))))


def kind(v: Column) -> Column:
    """string, boolean, number, array, object or null; SQL's null where there is no value."""
    name = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.when(name.isin("STRING", "BOOLEAN", "ARRAY", "OBJECT"), F.lower(name)).when(name == "VOID", "null").when(name.isNotNull(), "number")


def _at(v: Column, name: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}" if name else "$", as_type)


def _broken(v: Column, steps: list[str], path: Column, rule: Rule) -> Column:
    """The violations (path, rule) of what is reached from ``v`` by ``steps``; what can't be reached is another rule's matter."""
    if steps and steps[0] == "[]":
        each = lambda x, i: _broken(x, steps[1:], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), rule)
        return F.flatten(F.coalesce(F.transform(_at(v, "", "array<variant>"), each), F.array()))
    if steps:
        below = _broken(_at(v, steps[0]), steps[1:], F.concat(path, F.lit(f".{steps[0]}")), rule)
        return F.when(kind(v) == "object", below).otherwise(F.array().cast("array<struct<path:string,rule:string>>"))
    missing = F.lit("missing") if rule.needed else F.lit(None).cast("string")
    wrong = F.when(v.isNull(), missing).when(kind(v) != rule.kind, F.lit(f"not_{rule.kind}"))
    if rule.most is not None:
        wrong = wrong.when(F.size(_at(v, "", "array<variant>")) > rule.most, F.lit("too_many"))
    return F.filter(F.array(F.struct(path.alias("path"), wrong.alias("rule"))), lambda x: x["rule"].isNotNull())


def violations(rows: DataFrame, key: str, column: str, rules: tuple[Rule, ...]) -> DataFrame:
    """What is wrong with the VARIANT ``column``: key, path, rule (invalid_json, not_<kind>, missing, too_many).

    A row without a value is ``invalid_json`` at ``$``, one that is no object ``not_object``.  Rows of the same key stand
    beside each other; other columns are ignored; no wrong rows or no rows give none.
    """
    v = F.col("__v")
    found = F.flatten(F.array(*(_broken(v, rule.path.replace("[]", ".[]").split("."), F.lit("$"), rule) for rule in rules)))
    root = F.array(F.struct(F.lit("$").alias("path"), F.when(v.isNull(), "invalid_json").otherwise("not_object").alias("rule")))
    every = F.when(v.isNull() | (kind(v) != "object"), root).otherwise(found)
    return rows.select(F.col(key), F.col(column).alias("__v")).select(F.col(key), F.explode(every).alias("x")).select(key, "x.path", "x.rule")


def conforms(v: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether a VARIANT is an object without violations."""
    found = F.flatten(F.array(*(_broken(v, rule.path.replace("[]", ".[]").split("."), F.lit("$"), rule) for rule in rules)))
    return F.coalesce((kind(v) == "object") & (F.size(found) == 0), F.lit(False))


def answer_text(c: Column) -> Column:
    """The answer of a JSON object that has one, else the whole text."""
    text = F.trim(F.coalesce(c, F.lit("")))
    v = whole(c)
    answer = F.when(kind(_at(v, "answer")) == "string", F.trim(_at(v, "answer", "string")))
    return F.when(kind(v) == "object", F.coalesce(answer, text)).otherwise(text)


def claims(rows: DataFrame, key: str, column: str) -> DataFrame:
    """The claims of answers that have the shape GROUNDED: key, place (from 0), id, subquestion_id, text, quote, citation_ids."""
    v = F.col("__v")  # the shape is tested within the generator: a filter would be pushed below the parse and parse anew for each rule
    one = rows.select(F.col(key), F.col(column).alias("__v")).select(key, F.posexplode(F.when(conforms(v, GROUNDED), _at(v, "claims", "array<variant>"))).alias("place", "c"))
    get = lambda name, t="string": _at(F.col("c"), name, t)
    return one.select(key, F.col("place").cast("long").alias("place"), get("id").alias("id"), get("subquestionId").alias("subquestion_id"), get("text").alias("text"), get("quote").alias("quote"), get("citationIds", "array<string>").alias("citation_ids"))
