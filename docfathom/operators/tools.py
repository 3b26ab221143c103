"""The registry of tools: a fixed set of names, validated arguments, DataFrames out."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from types import MappingProxyType
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfathom.functions import text as X

from . import retrieval as R


class ToolError(ValueError):
    """A code that says what was wrong."""


def _text(most: int) -> Callable[[Any], bool]:
    return lambda v: isinstance(v, str) and 1 <= len(v.strip()) and len(v) <= most


def _list(n: int, most: int) -> Callable[[Any], bool]:
    return lambda v: isinstance(v, list) and len(v) <= n and all(map(_text(most), v))


def _int(low: int, high: int) -> Callable[[Any], bool]:
    return lambda v: isinstance(v, int) and not isinstance(v, bool) and low <= v <= high


#: Arguments by tool: checks, required names, default of top_k (fixed values).
SCHEMAS: Mapping[str, tuple[dict, tuple, int]] = MappingProxyType({
    "search_blog": ({"query": _text(500), "tags": _list(5, 100), "categories": _list(5, 100), "current_page_only": lambda v: isinstance(v, bool), "page_url": _text(2048), "top_k": _int(1, 20)}, ("query",), 12),
    "get_article": ({"url": _text(2048), "section": _text(200), "top_k": _int(1, 20)}, ("url",), 20),
    "get_related_articles": ({"url": _text(2048), "post_id": _text(300), "topic": _text(500), "top_k": _int(1, 20)}, (), 5),
    "compare_articles": ({"urls": lambda v: isinstance(v, list) and 2 <= len(v) <= 4 and len(set(v)) == len(v) and all(map(_text(2048), v)), "dimensions": lambda v: isinstance(v, list) and 1 <= len(v) <= 3, "query": _text(500), "top_k": _int(1, 3)}, ("urls",), 3),
    "recommend_learning_path": ({"topic": _text(300), "current_url": _text(2048), "level": lambda v: v in ("beginner", "intermediate", "advanced"), "goal": _text(300), "completed": _list(50, 2048), "top_k": _int(1, 8)}, (), 5),
    "explain_code_block": ({"url": _text(2048), "block_id": _text(64), "ordinal": _int(1, 1000), "section": _text(200), "query": _text(500)}, ("url",), 1),
})


def validated(name: str, args: Any) -> dict:
    """Arguments of a tool with its default, or ``ToolError``."""
    if name not in SCHEMAS:
        raise ToolError("UNKNOWN_AGENT_TOOL")
    checks, required, default = SCHEMAS[name]
    if not isinstance(args, dict):
        raise ToolError("INVALID_TOOL_ARGUMENTS")
    if set(args) - set(checks):
        raise ToolError("UNKNOWN_TOOL_ARGUMENT")
    if any(k not in args for k in required) or (name == "get_related_articles" and ("url" in args) == ("post_id" in args)):
        raise ToolError("MISSING_TOOL_ARGUMENT")
    for k, v in args.items():
        if not checks[k](v):
            raise ToolError(f"INVALID_{k.upper()}")
    return {"top_k": default, **args} if "top_k" in checks else dict(args)


class Registry:
    """Tools over a corpus of chunks (see ``retrieval.bm25``), with code blocks and learning steps where there are any."""

    def __init__(self, chunks: DataFrame, origin: str = "https://example.org", code: DataFrame | None = None, steps: DataFrame | None = None):
        self.chunks, self.origin, self.code, self.steps = chunks, origin, code, steps

    def execute(self, name: str, args: dict) -> DataFrame:
        a = validated(name, args)
        return getattr(self, f"_{name}")(a)

    def _page(self, url: str) -> DataFrame:
        return self.chunks.filter(X.normal_url(F.col("url"), self.origin) == X.normal_url(F.lit(url), self.origin))

    def _ask(self, chunks: DataFrame, query: str, k: int) -> DataFrame:
        asked = chunks.sparkSession.createDataFrame([(0, query)], "query_id long, question string")
        return R.bm25_best(chunks, asked, self.origin, k).drop("query_id")

    def _search_blog(self, a: dict) -> DataFrame:
        kept = self.chunks
        for name in ("tags", "categories"):
            if a.get(name):
                wanted = F.array(*(X.normalized(F.lit(v)) for v in a[name]))
                kept = kept.filter(F.size(F.array_except(wanted, F.transform(name, X.normalized))) == 0)
        if a.get("current_page_only"):
            kept = kept.filter(X.normal_url(F.col("url"), self.origin) == X.normal_url(F.lit(a.get("page_url", "")), self.origin))
        return self._ask(kept, a["query"], a["top_k"])

    def _get_article(self, a: dict) -> DataFrame:
        rows = self._page(a["url"])
        if a.get("section"):
            rows = rows.filter(X.normalized(F.col("section")).contains(X.normalized(F.lit(a["section"]))))
        return rows.orderBy("position").limit(a["top_k"])

    def _get_related_articles(self, a: dict) -> DataFrame:
        source = self._page(a["url"]) if "url" in a else self.chunks.filter(F.col("title") == a["post_id"])
        first = source.orderBy("position").select("url", F.concat_ws(" ", F.lit(a.get("topic", "")), "title", F.array_join("tags", " "), F.array_join("categories", " ")).alias("query")).first()
        if first is None:
            raise ToolError("ARTICLE_NOT_FOUND")
        hits = self._ask(self.chunks.filter(F.col("url") != first["url"]), first["query"], 20).withColumn("query_id", F.lit(0)).join(self.chunks.select("id", "url"), "id")
        return R.related(hits, F.lit(first["url"])).filter(F.col("related_rank") <= a["top_k"]).drop("query_id")

    def _compare_articles(self, a: dict) -> DataFrame:
        spark = self.chunks.sparkSession
        dims = ["core", *[d for d in a.get("dimensions", []) if d != "core"]][:3]
        grid = spark.createDataFrame([(u, i, d) for i, u in enumerate(a["urls"]) for d in dims], "asked string, article int, dimension string")
        cells = grid.join(self.chunks, X.normal_url(F.col("asked"), self.origin) == X.normal_url(F.col("url"), self.origin))
        hit = (F.col("dimension") == "core") | X.normalized(F.concat_ws(" ", "title", "content")).contains(X.normalized(F.col("dimension")))
        best = cells.filter(hit).groupBy("article", "dimension").agg(F.min_by("id", "position").alias("id"))
        return grid.join(best, ["article", "dimension"], "left").select("article", "dimension", "id", F.when(F.col("id").isNull(), "evidence_incomplete").otherwise("complete").alias("status"))

    def _recommend_learning_path(self, a: dict) -> DataFrame:
        from .graph import next_steps

        if self.steps is None:
            raise ToolError("LEARNING_PATH_NOT_CONFIGURED")
        rows = self.steps
        if a.get("topic"):
            rows = rows.filter(F.lower(F.col("track").cast("string")).contains(a["topic"].lower()) | F.lower("node").contains(a["topic"].lower()))
        return next_steps(rows, a.get("completed", []), a["top_k"])

    def _explain_code_block(self, a: dict) -> DataFrame:
        if self.code is None:
            raise ToolError("CODE_BLOCKS_NOT_CONFIGURED")
        rows = self.code.filter(X.normal_url(F.col("postUrl"), self.origin) == X.normal_url(F.lit(a["url"]), self.origin))
        for arg, column in (("block_id", "id"), ("ordinal", "ordinal")):
            if arg in a:
                rows = rows.filter(F.col(column) == a[arg])
        if a.get("section"):
            rows = rows.filter(X.normalized(F.col("sectionTitle")).contains(X.normalized(F.lit(a["section"]))))
        found = rows.limit(6).collect()  # a choice shown to a reader
        if not found:
            raise ToolError("CODE_BLOCK_NOT_FOUND")
        if len(found) > 1 and not {"block_id", "ordinal"} & set(a):
            return rows.limit(5).select("id", "sectionTitle", "ordinal", F.lit("ambiguous").alias("status"))
        return rows.limit(1).select("id", "sectionTitle", "ordinal", F.when(F.length("code") > 12000, "too_long").otherwise("found").alias("status"))
