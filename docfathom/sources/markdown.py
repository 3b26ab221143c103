"""Folders of Markdown posts to posts, chunks, code blocks and links."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docfathom import schemas
from docfathom.functions.tokens import ascii_slug
from docfathom.operators import markdown as M


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Path and whole text of each ``.md`` file below a folder."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


@functools.cache
def glob_pattern(glob: str) -> str:
    """A path pattern (``**/``, ``**``, ``*``, ``?``) as a regular expression."""
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    rule = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(rule.get(p) or re.escape(p) for p in parts) + "$"


def resolve_profile(fields: dict, path: str, registry: dict) -> tuple[str, str]:
    """Profile and where it comes from: front matter, a rule for the document, the first pattern that fits, or the default."""
    known = set(M.PROFILES)
    for name, source in (
        (fields.get("rag_profile"), "front-matter"), ((registry.get("documents") or {}).get(path), "document-rule"),
        (next((r["profile"] for r in registry.get("paths") or [] if re.match(glob_pattern(r["glob"]), path)), None), "path-rule"), (registry.get("default") or "generic-article", "migration-fallback"),
    ):
        if name:
            if name not in known:
                raise ValueError(f"unknown profile {name!r} for {path}")
            return name, source
    raise AssertionError


def flag(value: object, pattern: str) -> bool:
    return bool(re.fullmatch(pattern, re.sub(r"\s+#.*$", "", "" if value is None else str(value)).strip(" '\""), re.I))


def as_list(value: object) -> list[str]:
    items = value if isinstance(value, list) else [] if value is None else [value]
    return [str(x).strip() for x in items if x is not None and str(x).strip()]


def read(path: str, text: str, registry: dict, origin: str) -> tuple[dict, str, int]:
    """One file to its post, body and the line on which the body begins; a fault names the file."""
    try:
        fields, body, line = M.front_matter(text)
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from e
    short = re.sub(r"^.*/_posts/", "", path)
    profile, source = resolve_profile(fields, short, registry)
    title = str(fields.get("title") or short.rsplit("/", 1)[-1].removesuffix(".md")).strip()
    slug = str(fields.get("slug") or "").strip() or ascii_slug(title) or ascii_slug(short)
    post = {
        "id": title, "title": title, "url": f"{origin}/{slug}/", "sourcePath": short, "slug": slug, "date": str(fields.get("date") or ""), "published": not flag(fields.get("published"), "false|no|off|0"),
        "draft": flag(fields.get("draft"), "true|yes|on|1"), "tags": as_list(fields.get("tags")), "categories": as_list(fields.get("categories")), "profile": profile, "profileSource": source, "content": body, "bodyLine": line,
    }
    return post, body, line


def chunks_of(post: dict, body: str, line: int, parsed: list[M.Section]) -> list[dict]:
    chunks = M.chunk_post(post, body, line, parsed)
    if not chunks:  # a post that is only a resource still gets a chunk
        links = re.findall(r"\]\(([^)\s]+)\)", body)
        meta = M.chunk_post(post, "\n\n".join([post["title"], *links]), line)[:1]
        chunks = [{**c, "metadataOnly": True, "blockTypes": ["metadata"], "sourceLines": None} for c in meta]
    return chunks


def _code(post: dict, body: str, line: int) -> list[dict]:
    parsed = M.sections(body, line)
    if not any(b.type == "code" for s in parsed for b in s.blocks):
        return []
    return M.code_blocks(post, body, chunks_of(post, body, line, parsed), line, parsed=parsed)


def _links(post: dict, body: str, origin: str) -> list[dict]:
    return [{"sourcePostId": post["id"], "sourceUrl": post["url"], "label": a, "target": b, "anchor": c} for a, b, c in M.internal_links(body, origin)]


#: Characters of text that are parsed before their rows are sent.
CHARACTERS = 1 << 20
_LINKS = "sourcePostId string, sourceUrl string, label string, target string, anchor string"


def pieces(batches: Iterator[pa.RecordBatch], of: Callable[[str, str], list[dict]], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Files (path, text) to the rows that ``of`` makes of each, sent every CHARACTERS of text: memory follows these, not the batch."""
    rows: list[dict] = []
    size = 0
    for batch in batches:
        for path, text in zip(*batch.columns, strict=True):
            whole = text.as_py() or ""
            rows += of(path.as_py(), whole)
            size += len(whole)
            if size >= CHARACTERS:
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)


def corpus(rows: DataFrame, origin: str = "https://example.org", registry: dict | None = None) -> dict[str, DataFrame]:
    """``posts``, ``chunks``, ``code_blocks`` and ``links`` of files (path, text); drafts and unpublished posts are left out.

    Each of the four reads the files and parses what it needs: posts their front matter only.
    """
    known = registry or {}
    kinds = {
        "posts": (schemas.POST, lambda post, body, line: [post]), "chunks": (schemas.CHUNK, lambda post, body, line: chunks_of(post, body, line, M.sections(body, line))),
        "code_blocks": (schemas.CODE_BLOCK, _code), "links": (_LINKS, lambda post, body, line: _links(post, body, origin)),
    }

    def table(schema: str, of: Callable[[dict, str, int], list[dict]]) -> DataFrame:
        arrow = to_arrow_schema(T._parse_datatype_string(schema))

        def one(path: str, text: str) -> list[dict]:
            post, body, line = read(path, text, known, origin)
            return of(post, body, line) if post["published"] and not post["draft"] else []

        return rows.select("path", "text").mapInArrow(lambda batches: pieces(batches, one, arrow), schema)

    return {name: table(*kind) for name, kind in kinds.items()}


def write_versioned(frames: dict[str, DataFrame], folder: str, version: str, check=None) -> str:
    """Write tables under ``folder/version`` and point to it only when all are written and ``check`` (if given) is content."""
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{version}/{name}")
    if check is not None:
        check({name: spark.read.parquet(f"{folder}/{version}/{name}") for name in frames})
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{folder}/current")
    return f"{folder}/{version}"


def read_version(spark: SparkSession, folder: str, names: list[str], version: str | None = None) -> dict[str, DataFrame]:
    """Tables of a version, by default the current one; giving an older one rolls back."""
    version = version or spark.read.schema("version string").json(f"{folder}/current").first()["version"]
    return {n: spark.read.parquet(f"{folder}/{version}/{n}") for n in names}


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of an XML search feed: titled ones, tags stripped, addresses decoded."""
    from docfathom.functions.text import html_text

    rows = spark.read.format("xml").option("rowTag", "entry").schema("title string, url string, content string").load(path)
    return rows.filter(F.trim("title") != "").select(F.trim("title").alias("title"), html_text(F.col("content")).alias("content"), F.coalesce(F.try_url_decode("url"), F.col("url")).alias("url"))
