"""Choosing the best of candidates, and what of them may be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Beginnings of lines that are code rather than prose (a parameter).
CODE_BEGINNINGS = ("import ", "from ", "def ", "class ", "function ", "const ", "let ", "var ", "return ", "#", "//", "$", ">")
#: Letters that prose must have, and its shortest length (fixed values).
HAN, LEAST = r"[\x{4e00}-\x{9fff}]", 6


def matches_subquery(matched: Column, query: Column) -> Column:
    """Whether a candidate found by ``matched`` queries is one of ``query``: equal, or a longer retry of it."""
    normal = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    asked = normal(query)
    return F.exists(matched, lambda m: (normal(m) == asked) | normal(m).startswith(F.concat(asked, F.lit(" "))))


def best(candidates: DataFrame, by: str, *order: Column) -> DataFrame:
    """The first row of each ``by`` in the given order of keys (aggregated before it is exchanged)."""
    w = Window.partitionBy(by).orderBy(*order)
    return candidates.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def best_evidence(candidates: DataFrame, by: str = "query_id") -> DataFrame:
    """Of each query the candidate of the longest title that the question holds, then of most coverage, score, rank and the smallest id."""
    named = F.when(F.contains(F.lower("question"), F.lower("title")) & (F.length("title") > 0), F.length("title")).otherwise(0)
    return best(candidates.withColumn("__named", named), by, F.desc("__named"), F.desc("coverage"), F.desc("score"), F.asc("rank"), F.asc("id")).drop("__named")


def grounded(evidence: DataFrame, assignments: DataFrame) -> DataFrame:
    """Evidence of selected assignments only."""
    return evidence.join(assignments.filter("selected").select("chunk_id").distinct(), "chunk_id", "left_semi")


def chosen_track(tracks: DataFrame) -> DataFrame:
    """The track of the best score; of equal ones that of the smaller id."""
    return tracks.orderBy(F.desc("score"), "id").limit(1)


def is_prose(line: Column) -> Column:
    """Whether a line is substantive prose: Han letters, not too short, no beginning of code."""
    trimmed = F.trim(line)
    code = F.lit(False)
    for beginning in CODE_BEGINNINGS:
        code = code | trimmed.startswith(beginning)
    return trimmed.rlike(HAN) & (F.char_length(trimmed) >= LEAST) & ~code


def normalized_items(items: DataFrame, aliases: dict[str, list[str]], required: list[str]) -> DataFrame:
    """Results of tools under common names: the first alias that is there and not null; rows without a required field go.

    A null rank stays null.
    """
    have = set(items.columns)
    columns = []
    for name, others in aliases.items():
        there = [F.col(c) for c in (name, *others) if c in have]
        columns.append((F.coalesce(*there) if there else F.lit(None)).alias(name))
    out = items.select(*columns)
    for name in required:
        out = out.filter(F.trim(F.col(name).cast("string")) != "")
    return out


def sorted_tree(categories: DataFrame, articles: DataFrame) -> DataFrame:
    """Categories by name, each with its articles: newest first, then by title."""
    inside = articles.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros("date")).alias("age"), "title"))), lambda a: a["title"]).alias("titles"))
    return categories.join(inside, "category", "left").withColumn("titles", F.coalesce("titles", F.array().cast("array<string>"))).orderBy("category")
