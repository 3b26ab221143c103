"""Claims and their evidence: extractive checks, grounded checks in order, numbering of citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfathom.functions import text as X

#: Limits and verdicts (fixed values).
MAX_CLAIMS, MAX_TEXT, MAX_QUOTE, MIN_QUOTE = 6, 600, 360, 6
VERDICTS = ("supported", "quote_mismatch", "not_entailed", "does_not_answer_question", "scope_expansion", "negation_mismatch", "duplicate", "unknown_subquestion")


def bounded(c: Column, most: int) -> Column:
    whole = X.condensed(c)
    return F.when(F.length(whole) > most, "").otherwise(whole)


def cited(claims: DataFrame) -> DataFrame:
    ids = F.array_distinct(X.clean_list(F.col("citation_ids")))
    return claims.withColumns({"text": bounded(F.col("text"), MAX_TEXT), "quote": bounded(F.col("quote"), MAX_QUOTE), "n_citations": F.size(ids), "chunk_id": F.element_at(F.concat(ids, F.array(F.lit(""))), 1)})


def _shape() -> Column:
    return (
        F.when(F.col("text") == "", "invalid_claim_text").when(F.length("quote") < MIN_QUOTE, "invalid_evidence_quote").when(F.col("n_citations") != 1, "claim_requires_one_citation")
    )


def extractive(claims: DataFrame, chunks: DataFrame, deterministic: bool = False) -> DataFrame:
    """Each claim with why it fails (null if it holds) and whether its answer stands: any failure rejects all.

    ``claims``: answer_id, position, text, quote, citation_ids; ``chunks``: id, title, content (those selected for the answer).
    A claim must be its quote (or, in an answer made by rule, title and quote) and the quote must stand in the one cited chunk.
    """
    rows = cited(claims).join(chunks.select(F.col("id").alias("chunk_id"), F.col("title").alias("__title"), X.condensed(F.col("content")).alias("__content")), "chunk_id", "left")
    own = F.col("text") == F.col("quote")
    if deterministic:
        own = own | (F.col("text") == F.concat(F.lit("《"), X.condensed(F.col("__title")), F.lit("》："), F.col("quote")))
    reason = F.coalesce(_shape(), F.when(F.col("__content").isNull(), "unknown_or_unselected_citation").when(~F.col("__content").contains(F.col("quote")), "quote_not_in_cited_chunk").when(~own, "claim_not_extractive"))
    w = Window.partitionBy("answer_id")
    out = rows.withColumn("reason", reason).withColumn("__n", F.count("*").over(w))
    out = out.withColumn("reason", F.when(F.col("__n") > MAX_CLAIMS, "too_many_claims").otherwise(F.col("reason")))
    return out.withColumn("answer_valid", F.count("reason").over(w) == 0).drop("__title", "__content", "__n", "n_citations")


def grounded(claims: DataFrame, chunks: DataFrame, assignments: DataFrame, verdicts: DataFrame, covered: DataFrame) -> DataFrame:
    """Claims one by one in order: accepted ones, and why others aren't.

    ``claims`` as above with source_id and subquestion_id; ``assignments``: answer_id, subquestion_id, chunk_id; ``verdicts``: answer_id,
    source_id, supported, direct, code; ``covered``: answer_id, subquestion_id, covered (all subquestions).  A repeated source id is a duplicate;
    a repeated text or quote is one only if the claim before was accepted, which needs a fold over the answer's few claims.
    """
    rows = cited(claims)
    rows = rows.join(chunks.select(F.col("id").alias("chunk_id"), X.condensed(F.col("content")).alias("__content")), "chunk_id", "left")
    rows = rows.join(covered.select("answer_id", "subquestion_id", F.col("covered").alias("__covered"), F.lit(True).alias("__known")), ["answer_id", "subquestion_id"], "left")
    rows = rows.join(assignments.select("answer_id", "subquestion_id", "chunk_id", F.lit(True).alias("__assigned")).distinct(), ["answer_id", "subquestion_id", "chunk_id"], "left")
    rows = rows.join(verdicts.select("answer_id", "source_id", "supported", "direct", "code", F.lit(True).alias("__said")), ["answer_id", "source_id"], "left")
    shape = F.when(~F.coalesce("source_id", F.lit("")).rlike("^[A-Za-z0-9_-]{1,64}$"), "invalid_claim_id").when(F.trim(X.text(F.col("subquestion_id"))) == "", "unknown_subquestion")
    shaped = F.coalesce(shape, _shape())
    seen = F.row_number().over(Window.partitionBy("answer_id", "source_id", shaped.isNull()).orderBy("position")) > 1
    extra = F.size(F.array_except(X.numbers(F.col("text")), X.numbers(F.col("quote")))) > 0
    before = F.coalesce(
        shaped,
        F.when(seen, "duplicate").when(F.col("__known").isNull(), "unknown_subquestion").when(F.col("__content").isNull(), "unknown_or_unselected_citation").when(F.col("__assigned").isNull(), "citation_not_assigned")
        .when(~F.col("__content").contains(F.col("quote")), "quote_not_in_cited_chunk").when(X.has_negation(F.col("text")) != X.has_negation(F.col("quote")), "negation_mismatch").when(extra, "scope_expansion"),
    )
    good = F.coalesce(F.col("supported") & F.col("direct") & (F.col("code") == "supported") & F.col("__covered"), F.lit(False))
    after = F.when(~good, F.when(F.coalesce(F.col("code").isin(*VERDICTS), F.lit(False)), F.col("code")).otherwise("not_entailed"))
    item = F.struct("position", before.alias("before"), after.alias("after"), X.normalized(F.col("text")).alias("t"), X.normalized(F.col("quote")).alias("q"), "source_id", "subquestion_id", "chunk_id", "text", "quote")
    lists = rows.withColumn("__item", item).groupBy("answer_id").agg(F.array_sort(F.collect_list("__item")).alias("items"), F.count("*").alias("n"))
    start = F.array().cast("array<struct<position:int,reason:string,t:string,q:string>>")

    def step(acc: Column, x: Column) -> Column:
        taken = F.exists(acc, lambda y: y["reason"].isNull() & ((y["t"] == x["t"]) | (y["q"] == x["q"])))
        reason = F.coalesce(x["before"], F.when(taken, "duplicate"), x["after"])
        return F.concat(acc, F.array(F.struct(x["position"].cast("int").alias("position"), reason.alias("reason"), x["t"].alias("t"), x["q"].alias("q"))))

    folded = lists.withColumn("out", F.aggregate("items", start, step)).select("answer_id", "n", F.explode(F.arrays_zip("items", "out")).alias("z"))
    reason = F.when(F.col("n") > MAX_CLAIMS, "too_many_claims").otherwise(F.col("z.out.reason"))
    return folded.select("answer_id", "z.items.position", "z.items.source_id", "z.items.subquestion_id", "z.items.chunk_id", "z.items.text", "z.items.quote", reason.alias("reason"))


def numbered(accepted: DataFrame) -> DataFrame:
    """Citations of each answer by first appearance: answer_id, chunk_id, number."""
    first = accepted.groupBy("answer_id", "chunk_id").agg(F.min("position").alias("first"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy("answer_id").orderBy("first", "chunk_id"))).drop("first")


def answers(accepted: DataFrame) -> DataFrame:
    """Accepted claims as text, each with the number of its citation."""
    rows = accepted.join(numbered(accepted), ["answer_id", "chunk_id"])
    line = F.struct("position", F.concat("text", F.lit(" ["), F.col("number").cast("string"), F.lit("]")).alias("line"))
    return rows.groupBy("answer_id").agg(F.array_sort(F.collect_list(line)).alias("l")).select("answer_id", F.array_join(F.transform("l", lambda x: x["line"]), " ").alias("answer"))


def finalised(attempts: DataFrame) -> DataFrame:
    """The grounded answer, else the one made by rule, else a refusal, with where it came from."""
    source = F.when(F.col("grounded").isNotNull(), "grounded_v2").when(F.col("deterministic").isNotNull(), "deterministic").otherwise("refusal")
    return attempts.withColumn("answer", F.coalesce("grounded", "deterministic", "refusal")).withColumn("answer_source", source)
