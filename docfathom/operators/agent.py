"""Questions to plans: routes, rewritten follow-ups, subquestions, tools."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docfathom.functions import text as X

#: Patterns of the routes (fixed values), each as it is; those of a group are alternatives.
DIRECT = r"^(你好|您好|嗨|哈喽|hello|hi|你是谁|你能做什么|怎么使用|如何使用)[呀啊呢？?!！。.]*$"
COMPARE_CUE = (r"对比|比较|区别(?!度)|差异(?!化)|异同|相比|哪个(?:更|好|适合|应该)|哪篇更|如何选择", r"(?i:\bvs\.?\b|versus)")
COMPARE_PAIR = (r"[^，。；：！？?]{1,100}(?:与|和|及|(?i:\bvs\.?\b|versus))[^，。；：！？?]{1,100}", r"[^，。；：！？?]{1,100}相比[^，。；：！？?]{1,100}", r"这两篇(?:文章)?|两者|前者|后者")
CODE = (r"代码块|这段代码|该段代码", r"第\s*[一二两三四五六七八九十\d]+\s*段代码", r"解释.{0,30}代码|代码.{0,20}(?:解释|含义|作用|怎么(?:写|运行))", r"逐行(?:解释|讲解)")
NEXT = r"下一篇|下一步(?:该)?(?:看|学|读)|接下来(?:该)?(?:看|学|读)|后续(?:该)?(?:看|学|读)"
LEARN = (r"学习路径|学习路线|阅读顺序|学习计划|从零(?:开始)?(?:学|学习)|(?:先|应该先)(?:看|学|读)", r"(?:学|学习).{0,12}之前(?:先)?(?:看|学|读)", r"怎么(?:学|学习)|如何(?:学|学习)")
SUMMARY = "总结|概括|摘要"
RELATED = (r"相关文章|相关推荐|延伸阅读|类似文章", r"(?:请|帮我|给我|能否|可以|我想(?:看|读))[^。！？?!]{0,20}推荐", r"推荐(?:给我)?\s*(?:几|一|两|三|一些|若干)(?:篇|个|本)?", r"推荐(?:给我)?\s*(?:文章|阅读|一下)")
PAGE = "这篇|本文|本页|当前页|这一页|该文"
#: Patterns of follow-ups (fixed values): an ordinal, the former or the latter, both, this page, "it", "go on".
NTH_ARTICLE = r"第\s*([一二两三四五六七八九十\d]+)\s*(?:篇|个)(?:文章)?"
FORMER_LATTER = "前者|后者"
BOTH = r"(?:这|那)两(?:篇|个)(?:文章)?|两者|它们"
THIS_PAGE = "这篇(?:文章)?|本文|本页|当前页|这一页|该文"
IT = "(?:它|那它|那么它|这个|那个)(?=[的有是在能会怎如为])"
GO_ON = "(?:那|那么|还有|另外)?(?:继续|展开|详细(?:说说|讲讲)?|再(?:说说|讲讲))[。.！!]*$"
#: Patterns of special requests (fixed values): dimensions, levels, goal, number of a code block.
DIMENSIONS = {"performance": "性能|效率|速度", "structure": "结构|组成|架构", "usage": "场景|用途|适用", "tradeoff": "优缺点|优点|缺点|优势|劣势"}
LEVELS = {"beginner": "入门|零基础|初学|新手", "intermediate": "进阶|中级", "advanced": "高级|深入"}
GOAL = "(?:为了|目标是|想要?)([^，。；！？?]{1,40})"
NTH_CODE = r"第\s*([一二三四五六七八九十\d]+)\s*段代码"
#: Limits (fixed values).
MAX_PARTS, MAX_PART = 3, 500
TOOLS = {"article_compare": "compare_articles", "code_explanation": "explain_code_block", "learning_path": "recommend_learning_path", "page_summary": "get_article", "related_articles": "get_related_articles", "page_qa": "search_blog", "site_qa": "search_blog"}


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, map(c.rlike, patterns))


def route(question: Column, has_page: Column, n_refs: Column, mode: Column) -> Column:
    """One of eight routes, by fixed precedence."""
    q = X.text(question)
    pair = _any(q, COMPARE_PAIR) | (n_refs >= 2)
    return (
        F.when(F.lower(F.trim(q)).rlike(DIRECT), "direct")
        .when(_any(q, COMPARE_CUE) & pair, "article_compare")
        .when(_any(q, CODE) & has_page, "code_explanation")
        .when(q.rlike(NEXT) | _any(q, LEARN), "learning_path")
        .when(((mode == "page_summary") | q.rlike(SUMMARY)) & has_page, "page_summary")
        .when(_any(q, RELATED), "related_articles")
        .when(((mode == "page") | q.rlike(PAGE)) & has_page, "page_qa")
        .otherwise("site_qa")
    )


def subquestions(rows: DataFrame, key: str, question: str) -> DataFrame:
    """At most MAX_PARTS different parts of a question; what is over is joined into the last."""
    parts = F.filter(F.transform(F.split(X.text(F.col(question)), r"[；;]|[？?](?=.+)"), lambda p: F.trim(p)), lambda p: p != "")
    many = F.concat(F.slice(parts, 1, MAX_PARTS - 1), F.array(F.array_join(F.slice(parts, MAX_PARTS, 1000), "；")))
    kept = F.when(F.size(parts) > MAX_PARTS, many).when(F.size(parts) > 1, parts).otherwise(F.array(F.trim(X.text(F.col(question)))))
    bounded = F.transform(kept, lambda p: F.substring(p, 1, MAX_PART))
    once = F.filter(bounded, lambda p, i: ~F.exists(F.slice(bounded, 1, i), lambda o: X.normalized(o) == X.normalized(p)) & (F.trim(p) != ""))
    return rows.select(key, F.posexplode(once).alias("i", "part")).select(key, F.concat(F.lit("sq_"), F.col("i") + 1).alias("subquestion_id"), "part")


ORDINALS = "一二三四五六七八九十"


def rewrite(question: str, titles: list[str], page: str | None = None) -> tuple[str, bool]:
    """A follow-up made to stand alone, from the titles of the last answer in order; whether the reader must be asked back.

    Knows ordinals, the former and the latter, both, the page and "it"; a reference without its object asks back.
    """
    q = (question or "").strip()
    m = re.search(NTH_ARTICLE, q)
    if m:
        word = m.group(1).replace("两", "二")
        n = int(word) if word.isdigit() else ORDINALS.find(word) + 1 if len(word) == 1 else 0
        return (q.replace(m.group(0), f"《{titles[n - 1]}》"), False) if 1 <= n <= len(titles) else (q, True)
    if re.search(FORMER_LATTER, q):
        if len(titles) < 2:
            return q, True
        return q.replace("前者", f"《{titles[0]}》").replace("后者", f"《{titles[1]}》"), False
    m = re.search(BOTH, q)
    if m:
        return (q.replace(m.group(0), f"《{titles[0]}》和《{titles[1]}》"), False) if len(titles) >= 2 else (q, True)
    m = re.search(THIS_PAGE, q)
    if m:
        name = page or (titles[0] if len(titles) == 1 else None)
        return (q.replace(m.group(0), f"《{name}》"), False) if name else (q, True)
    m = re.match(IT, q)
    if m:
        name = titles[0] if titles else page
        return (f"《{name}》" + q[m.end() :], False) if name else (q, True)
    m = re.match(GO_ON, q)
    if m:
        name = titles[0] if titles else page
        return (f"{q} 《{name}》", False) if name else (q, True)
    return q, False


@F.pandas_udf(StringType())
def rewritten(question: pd.Series, titles: pd.Series, page: pd.Series) -> pd.Series:
    """``rewrite`` over columns; null where the reader must be asked back."""
    out = [rewrite(q, list(t) if t is not None else [], p) for q, t, p in zip(question, titles, page, strict=True)]
    return pd.Series([None if ask else text for text, ask in out])


def planned(rows: DataFrame) -> DataFrame:
    """The tool of each route (``direct`` has none)."""
    names = F.create_map(*(F.lit(x) for pair in TOOLS.items() for x in pair))
    return rows.withColumn("tool", F.element_at(names, F.col("route")))


def retry_query(query: Column, title: Column) -> Column:
    """A second attempt's query: the anchor's title, or a general hint, is added."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.when(query.contains(title), query).otherwise(F.concat_ws(" ", title, query))).otherwise(F.concat(query, F.lit(" 相关内容")))


def specialist(question: Column) -> dict[str, Column]:
    """What a special request asks for: dimensions of a comparison, level, goal, code selector."""
    dims = F.filter(F.array(*(F.when(X.text(question).rlike(p), F.lit(k)) for k, p in DIMENSIONS.items())), lambda x: x.isNotNull())
    return {
        "dimensions": F.slice(F.concat(F.array(F.lit("core")), dims), 1, 3),
        "level": F.coalesce(*(F.when(question.rlike(p), k) for k, p in LEVELS.items())),
        "goal": F.nullif(F.regexp_extract(question, GOAL, 1), F.lit("")),
        "ordinal": X.parse_ordinal(F.regexp_extract(question, NTH_CODE, 1)),
    }
