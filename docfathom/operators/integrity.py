"""Index maintenance and audits: change capture, completeness, duplicates, anomalies, reports, manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docfathom.functions import text as X
from docfathom.functions.vectors import finite, nonzero

from .metrics import percentile


def changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """Each id as reused, updated, added or deleted, by content hash and fingerprint.

    ``now``: id, content_hash; ``before``: id, content_hash and, if known, ok (whether its vector can be used).
    """
    old = before.select("id", F.col("content_hash").alias("__old"), (F.col("ok") if "ok" in before.columns else F.lit(True)).alias("__ok"))
    both = now.select("id", F.col("content_hash").alias("__new")).join(old, "id", "full_outer")
    status = F.when(F.col("__new").isNull(), "deleted").when(F.col("__old").isNull(), "added").when((F.col("__new") == F.col("__old")) & F.col("__ok"), "reused").otherwise("updated")
    return both.select("id", status.alias("status"))


def usable_vectors(chunks: DataFrame, vectors: DataFrame, fingerprint: str | None = None, dimensions: int | None = None) -> DataFrame:
    """Vectors that belong to a chunk as it is now: same id, same content, same fingerprint, finite."""
    kept = vectors.filter(finite(F.col("values"), dimensions))
    if fingerprint is not None:
        kept = kept.filter(F.col("fingerprint") == fingerprint)
    return kept.join(chunks.select("id", "content_hash"), ["id", "content_hash"], "left_semi")


def completeness(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Whether an index covers exactly the chunks with vectors that aren't zero: counts of what is missing, extra, stale or zero."""
    v = vectors.select("id", F.col("content_hash").alias("__h"), nonzero(F.col("values")).alias("__nonzero"))
    both = chunks.select("id", "content_hash").join(v.withColumn("__v", F.lit(1)), "id", "full_outer")
    has_chunk, has_vector = F.col("content_hash").isNotNull(), F.col("__v").isNotNull()
    out = both.agg(
        F.count_if(has_chunk & ~has_vector).alias("missing"), F.count_if(~has_chunk & has_vector).alias("extra"),
        F.count_if(has_chunk & has_vector & (F.col("content_hash") != F.col("__h"))).alias("stale"), F.count_if(has_vector & ~F.coalesce("__nonzero", F.lit(False))).alias("zero"),
    )
    return out.withColumn("complete", F.expr("missing + extra + stale + zero = 0"))


def id_churn(before: DataFrame, now: DataFrame) -> DataFrame:
    """How two sets of ids differ: counts and ratios (0 of nothing)."""
    counts = changes(now, before).agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("added", "deleted", "updated", "reused")))
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    old, new = F.col("deleted") + F.col("updated") + F.col("reused"), F.col("added") + F.col("updated") + F.col("reused")
    return counts.select("*", (F.col("updated") + F.col("reused")).alias("retained"), F.round(rate(F.col("deleted"), old), 6).alias("deleted_ratio"), F.round(rate(F.col("added"), new), 6).alias("added_ratio"))


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def mismatches(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Fields that differ between rows of the same key; two nulls don't."""
    r = right.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    both = left.select(key, *columns).join(r, key)
    wrong = F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"__{c}")), F.lit(c)) for c in columns)), lambda x: x.isNotNull())
    return both.select(key, F.explode(wrong).alias("field"))


def duplicate_content(rows: DataFrame, key: str, content: str, samples: int = 20) -> DataFrame:
    """Groups of equal normalized content: its hash, size and first keys (collected by smallest, never the whole group)."""
    hashed = rows.select(F.col(key).alias("k"), F.md5(X.normalized(F.col(content)).cast("binary")).alias("content_key"))
    sizes = hashed.groupBy("content_key").agg(F.count("*").alias("size"), F.min("k").alias("first")).filter("size > 1")
    top = hashed.join(sizes.select("content_key"), "content_key", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("content_key").orderBy("k"))).filter(F.col("n") <= samples)
    return sizes.join(top.groupBy("content_key").agg(F.array_sort(F.collect_list("k")).alias("sample")), "content_key")


def report(rows: DataFrame, group: str | None = None) -> DataFrame:
    """Totals, kinds and spread of tokens (column ``tokens``) and duplicated content (column ``content``)."""
    base = rows.groupBy(group) if group else rows.groupBy()
    out = base.agg(
        F.count("*").alias("chunks"), F.count_distinct("source").alias("sources"), F.min("tokens").alias("tokens_min"), percentile("tokens", 0.5).alias("tokens_p50"),
        percentile("tokens", 0.95).alias("tokens_p95"), F.max("tokens").alias("tokens_max"), (F.count("*") - F.count_distinct("content")).alias("duplicated"),
    )
    return out


def anomalies(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows each rule finds: rule, n; one pass over the rows."""
    counts = rows.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in rules.items()))
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*rules))).alias("rule", "n"))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Rows that break a rule: rule, id."""
    broken = F.filter(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items())), lambda x: x.isNotNull())
    return rows.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("id"))


def chunk_rules(profile_max: dict[str, int]) -> dict[str, Column]:
    """What every chunk must satisfy."""
    most = F.element_at(F.create_map(*(F.lit(x) for pair in profile_max.items() for x in pair)), F.col("profile"))
    return {
        "id_format": F.col("id").rlike("^chunk_[a-f0-9]{24}$"), "parent_format": F.col("parentId").rlike("^parent_[a-f0-9]{24}$"),
        "hash_format": F.col("contentHash").rlike("^sha256:[a-f0-9]{64}$"), "content": F.trim(X.text(F.col("content"))) != "",
        "hash_matches": F.col("contentHash") == F.concat(F.lit("sha256:"), F.sha2(F.col("content").cast("binary"), 256)),
        "tokens": (F.col("tokenCount") > 0) & ((F.col("tokenCount") <= most) | F.col("overflowReason").isNotNull()),
        "lines": F.col("sourceLines").isNotNull() | F.array_contains("blockTypes", "metadata"),
    }


def manifest(files: DataFrame) -> DataFrame:
    """One row: the version is a hash over the sorted names and hashes of the files (name, hash, rows)."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "hash"))), lambda x: F.concat(x["name"], F.lit(":"), x["hash"])), "\n")
    return files.agg(F.sha2(lines.cast("binary"), 256).alias("v"), F.count("*").alias("files"), F.sum("rows").alias("rows")).select(F.concat(F.lit("corpus_"), F.substring("v", 1, 24)).alias("version"), "files", "rows")


def rebuilt_equal(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids whose fields differ between two builds, or that only one has."""
    same = [c for c in left.columns if c != key]
    both = left.alias("l").join(right.alias("r"), key, "full_outer")
    ok = reduce(lambda a, c: a & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), same, F.lit(True))
    return both.filter(~ok).select(key)


def first_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Keep the first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def legacy_corpus(posts: DataFrame, chunks: DataFrame, origin: str) -> tuple[DataFrame, DataFrame]:
    """Posts that are published with an allowed address, first of each address; chunks of those."""
    kept = first_by(posts.filter(F.coalesce("published", F.lit(True)) & X.allowed_url(F.col("url"), origin)).withColumn("__u", X.normal_url(F.col("url"), origin)), ["__u"], "position")
    mine = chunks.withColumn("__u", X.normal_url(F.col("url"), origin)).join(kept.select("__u"), "__u", "left_semi")
    return kept.drop("__u"), mine.drop("__u")
