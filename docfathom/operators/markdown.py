"""Markdown to sections of typed blocks, and sections to chunks of bounded size.

Eight block types: paragraph, list, table, code, formula, quote, image, callout.  Nested lists stay one block.
"""

from __future__ import annotations

import functools
import hashlib
import re
from dataclasses import dataclass, field, replace

from docfathom.functions.tokens import VERSION, estimate, split_by_budget

#: Token budgets of the profiles: target, most, overlap (fixed values).
PROFILES = {"generic-article": (384, 512, 64), "tutorial": (320, 512, 48), "code-doc": (384, 512, 32), "math-note": (384, 512, 48), "faq-reference": (256, 384, 0)}
#: Words that name a mathematical part (fixed values).
MATH_PARTS = (("proof", "证明|proof"), ("theorem", "定理|theorem"), ("definition", "定义|definition"), ("corollary", "推论|corollary"), ("example", "例题|示例|example"))

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:\s+(.*?))?\s*#*\s*$")
_LIST = re.compile(r"^\s*(?:[-*+]|\d{1,9}[.)])\s+")
_CALLOUT = re.compile(r"^(?:\{%-?\s*(?:note|tabs?|collapse|details)\b|:{3,}\w+)", re.I)
_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")
_IMAGE = re.compile(r"!\[([^\]]*)\]\([^)]*\)")


@dataclass
class Block:
    type: str
    content: str
    raw: str
    start: int
    end: int
    language: str = ""
    section: str = ""
    chunk_type: str = ""
    tokens: int = 0
    overflow: str | None = None


@dataclass
class Section:
    path: list[str]
    title: str
    line: int
    blocks: list[Block] = field(default_factory=list)


@functools.cache
def _loader() -> type:
    import yaml

    class Plain(yaml.SafeLoader):
        """JSON's types only, so that dates stay text."""

    Plain.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if not t.endswith(":timestamp")] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    return Plain


def front_matter(text: str) -> tuple[dict, str, int]:
    """Fields, body and the line on which the body begins; an unreadable or non-mapping header raises ``ValueError``."""
    import yaml

    text = (text or "").removeprefix("﻿").replace("\r\n", "\n")
    m = re.match(r"---[ \t]*\n(.*?)(?:^|\n)(?:---|\.\.\.)[ \t]*(?:\n|$)", text, re.S)
    if not m:
        return {}, text, 1
    try:
        fields = yaml.load(m.group(1), Loader=_loader())  # noqa: S506  a safe loader
    except yaml.YAMLError as e:
        raise ValueError(f"front matter can't be read: {e}") from e
    if fields is not None and not isinstance(fields, dict):
        raise ValueError("front matter must be a mapping")
    return fields or {}, text[m.end() :], text[: m.end()].count("\n") + 1


def without_comments(text: str) -> str:
    """HTML comments outside fences become blank; lines keep their number."""
    if "<!--" not in text:
        return text
    out, fence, inside = [], "", False
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if not inside and m and (not fence or (m.group(1)[0] == fence[0] and len(m.group(1)) >= len(fence) and not m.group(2).strip())):
            fence = "" if fence else m.group(1)
            out.append(line)
            continue
        if fence:
            out.append(line)
            continue
        kept = ""
        while line:
            at = line.find("-->" if inside else "<!--")
            if at < 0:
                kept += "" if inside else line
                break
            kept += "" if inside else line[:at]
            line = line[at + (3 if inside else 4) :]
            inside = not inside
        out.append(kept)
    return "\n".join(out)


def inline_text(text: str) -> str:
    """Visible text: images by their description, links by their label, no tags or emphasis marks."""
    text = _IMAGE.sub(lambda m: f"图片：{m.group(1)}" if m.group(1) else "", text)
    text = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"\{%-?.*?-?%\}", "", text, flags=re.S)
    text = re.sub(r"`+([^`]*)`+", r"\1", text)
    text = re.sub(r"</?[a-zA-Z][^>]*>", "", text)
    return re.sub(r"(\*\*|__|\*|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", text)


def tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def sections(text: str, first_line: int = 1) -> list[Section]:
    """Sections by heading; a heading cuts the path back to its level."""
    lines = without_comments(text).split("\n")
    stack: list[str] = []
    out = [Section([], "", first_line)]
    i = 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        heading = _HEADING.match(line)
        if heading:
            level, title = len(heading.group(1)), inline_text(heading.group(2) or "").strip()
            stack = [*(stack + [""] * level)[: level - 1], title]
            out.append(Section([s for s in stack if s], title, first_line + i))
            i += 1
            continue
        kind, j, content, language = _take(lines, i)
        raw = "\n".join(lines[i:j])
        # Code keeps its spaces, everything else is tidied.
        content = content if kind == "code" else tidy(content)
        out[-1].blocks.append(Block(kind, content, raw, first_line + i, first_line + j - 1, language, out[-1].title))
        i = j
    return [s for s in out if s.blocks or s.title]


def _take(lines: list[str], i: int) -> tuple[str, int, str, str]:
    """The block that begins at line i: type, end, content, language."""
    line, n = lines[i], len(lines)
    fence = _FENCE.match(line)
    if fence:
        j = i + 1
        while j < n and not re.match(rf"^ {{0,3}}{re.escape(fence.group(1)[0])}{{{len(fence.group(1))},}}\s*$", lines[j]):
            j += 1
        return "code", min(j + 1, n), "\n".join(lines[i + 1 : j]).rstrip(), fence.group(2).strip()
    if line.strip().startswith(("$$", "\\[")):
        close = "$$" if line.strip().startswith("$$") else "\\]"
        j, rest = i, line.strip()[2:]
        while close not in rest and j + 1 < n:
            j += 1
            rest = lines[j]
        return "formula", j + 1, "\n".join(lines[i : j + 1]).strip()[2:].strip().removesuffix(close).strip(), ""
    if _CALLOUT.match(line.strip()) or re.match(r"^ {0,3}</?[a-zA-Z][^>]*>", line):
        j = i
        while j < n and lines[j].strip():
            j += 1
        return "callout", j, re.sub(r"<[^>]+>", " ", re.sub(r"\{%-?.*?-?%\}|^:{3,}\w*", "", "\n".join(lines[i:j]), flags=re.S | re.M)), ""
    if line.lstrip().startswith(">"):
        j = i
        while j < n and lines[j].strip():
            j += 1
        body = [re.sub(r"^\s*>\s?", "", x) for x in lines[i:j]]
        return "callout" if _CALLOUT.match(body[0].strip()) else "quote", j, inline_text("\n".join(body)), ""
    if "|" in line and i + 1 < n and "|" in lines[i + 1] and _RULE.match(lines[i + 1]):
        j = i + 2
        while j < n and lines[j].strip() and "|" in lines[j]:
            j += 1
        cells = [[tidy(inline_text(c)) for c in re.split(r"(?<!\\)\|", r.strip().strip("|"))] for r in [line, *lines[i + 2 : j]]]
        return "table", j, "\n".join(" | ".join(r) for r in cells), ""
    if _LIST.match(line):
        j = i + 1
        while j < n and (lines[j].strip() and not _HEADING.match(lines[j]) and not _FENCE.match(lines[j]) or (not lines[j].strip() and j + 1 < n and (_LIST.match(lines[j + 1]) or lines[j + 1].startswith("  ")))):
            j += 1
        return "list", j, "\n".join(inline_text(_LIST.sub("", x)).strip() for x in lines[i:j] if x.strip()), ""
    j = i + 1
    while j < n and lines[j].strip() and not (_HEADING.match(lines[j]) or _FENCE.match(lines[j]) or lines[j].lstrip().startswith((">", "$$", "\\[")) or _LIST.match(lines[j])):
        j += 1
    whole = "\n".join(lines[i:j])
    kind = "image" if _IMAGE.search(whole) and not _IMAGE.sub("", whole).strip() else "paragraph"
    return kind, j, inline_text(whole), ""


def chunk_type(block: Block, profile: str) -> str:
    if block.type == "list" and profile == "tutorial":
        return "step"
    if profile == "faq-reference":
        return "faq"
    if profile == "math-note":
        for name, pattern in MATH_PARTS:
            if re.search(pattern, f"{block.section}\n{block.content}", re.I):
                return name
    return "text" if block.type == "paragraph" else block.type


def _by_lines(block: Block, most: int, reason: str, head: str | None, exact: bool) -> list[Block]:
    """Lines joined while they fit; ``head`` leads every part; a line too long for itself is marked."""
    lines = block.content.split("\n")
    body = [r.strip() for r in lines[1:] if r.strip()] if head is not None else lines
    put = lambda part: "\n".join([head, *part] if head is not None else part).rstrip()
    out: list[Block] = []
    part: list[str] = []
    lead = estimate(head)
    begin, size = 0, lead

    def close(end: int) -> None:
        nonlocal part, begin, size
        if put(part).strip() and part:
            n = size
            where = {"start": block.start + begin, "end": min(block.end, block.start + end - 1)} if exact else {}
            out.append(replace(block, content=put(part), tokens=n, overflow=reason if n > most else None, **where))
        part, begin, size = [], end, lead

    for i, line in enumerate(body):
        n = estimate(line)
        if part and size + n > most:
            close(i)
        part.append(line)
        size += n
        if size > most:
            close(i + 1)
    close(len(body))
    return out


def split_block(block: Block, profile: str, most: int) -> list[Block]:
    """A block's parts within the budget, each by its type's rule; a formula is never cut."""
    block = replace(block, chunk_type=chunk_type(block, profile), tokens=estimate(block.content))
    if block.type == "formula":
        return [replace(block, overflow="formula_exceeds_token_limit" if block.tokens > most else None)]
    if block.tokens <= most:
        return [block]
    if block.type == "table" and "\n" in block.content:
        return _by_lines(block, most, "table_row_exceeds_token_limit", block.content.split("\n")[0], False)
    if block.type in ("code", "list"):
        return _by_lines(block, most, f"{block.type}_{'line' if block.type == 'code' else 'item'}_exceeds_token_limit", None, block.type == "code")
    if block.type == "table":
        return [block]
    return [replace(block, content=part, tokens=estimate(part)) for part in split_by_budget(block.content, most)]


def chunk_section(section: Section, profile: str) -> list[dict]:
    """Chunks of a section: prose joined up to the target with overlap; code, tables and lists alone; a formula with what explains it."""
    target, most, overlap = PROFILES.get(profile, PROFILES["generic-article"])
    out: list[dict] = []
    held: list[Block] = []
    waiting = False  # a formula's explanation

    def size(units: list[Block]) -> int:
        return sum(u.tokens for u in units)

    def text_of(units: list[Block]) -> str:
        return "\n\n".join(u.content for u in units if u.content).strip()

    def emit(units: list[Block], alone: bool) -> None:
        kinds = list(dict.fromkeys(u.type for u in units))
        kind = units[0].chunk_type if alone or len(kinds) == 1 else "formula-context" if "formula" in kinds else "text"
        content = units[0].content if alone else text_of(units)
        out.append({
            "content": content, "block_types": kinds, "start": min(u.start for u in units), "end": max(u.end for u in units), "chunk_type": kind,
            "tokens": sum(u.tokens for u in units), "overflow": next((u.overflow for u in units if u.overflow), None),
        })

    def close(keep: bool) -> None:
        nonlocal held, waiting
        if not held:
            return
        emit(held, False)
        tail: list[Block] = []
        if keep and overlap and not {u.type for u in held} & {"formula", "code", "table", "list"}:
            left = overlap
            for u in reversed(held):
                if u.tokens > left:
                    break
                left -= u.tokens
                tail.insert(0, u)
        held, waiting = tail, False

    for block in section.blocks:
        if not block.content.strip():
            continue
        for unit in split_block(block, profile, most):
            if unit.type in ("code", "table", "list"):
                close(False)
                emit([unit], True)
                continue
            # Sizes add up: no token reaches over the blank line between units.
            if held and size(held) + unit.tokens > most:
                close(True)
            if held and size(held) + unit.tokens > most:
                held = []
            held.append(unit)
            if waiting and unit.type != "formula":
                close(False)
            elif unit.type == "formula":
                waiting = True
                if unit.overflow:
                    close(False)
            elif size(held) >= target:
                close(True)
    close(False)
    return out


def digest(prefix: str, n: int, *parts: object) -> str:
    return f"{prefix}_{hashlib.sha256(chr(0).join(map(str, parts)).encode()).hexdigest()[:n]}"


def chunk_post(post: dict, body: str, first_line: int = 1, parsed: list[Section] | None = None) -> list[dict]:
    """A post's chunks with identities that depend on content and place in their section, not on other sections.

    ``parsed``: the body's ``sections``, if they are known.
    """
    out: list[dict] = []
    seen_path: dict[str, int] = {}
    index = 0
    links = re.findall(r"\]\(([^)\s]+)\)", body)
    for section in sections(body, first_line) if parsed is None else parsed:
        path = "\x00".join(section.path)
        occurrence = seen_path.get(path, 0)
        seen_path[path] = occurrence + 1
        parent = digest("parent", 24, post["id"], path, occurrence)
        copies: dict[tuple, int] = {}
        for ordinal, c in enumerate(chunk_section(section, post.get("profile") or "generic-article")):
            content_hash = "sha256:" + hashlib.sha256(c["content"].encode()).hexdigest()
            n = copies.get((c["chunk_type"], content_hash), 0)
            copies[c["chunk_type"], content_hash] = n + 1
            lead = [post["title"], " ".join(post.get("tags") or []), " ".join(post.get("categories") or []), post.get("profile") or "", " > ".join(section.path), c["chunk_type"], " ".join(c["block_types"]), c["content"]]
            out.append({
                "id": digest("chunk", 24, post["id"], path, occurrence, c["chunk_type"], content_hash, n), "contentHash": content_hash, "postId": post["id"], "postTitle": post["title"], "postUrl": post["url"],
                "sourcePath": post.get("sourcePath"), "profile": post.get("profile"), "profileSource": post.get("profileSource"), "parentId": parent, "headingPath": section.path, "sectionTitle": section.title,
                "sectionAnchor": digest("section", 16, path, occurrence), "chunkIndex": index, "childOrdinal": ordinal, "sectionOccurrence": occurrence, "chunkType": c["chunk_type"], "tokenCount": c["tokens"],
                "tokenizerVersion": VERSION, "overflowReason": c["overflow"], "content": c["content"], "retrievalText": "\n".join(x for x in lead if x.strip()), "blockTypes": c["block_types"],
                "sourceLines": {"start": c["start"], "end": c["end"]}, "resourceLinks": links, "tags": post.get("tags") or [], "categories": post.get("categories") or [], "metadataOnly": False,
            })
            index += 1
    return out


def code_blocks(post: dict, body: str, chunks: list[dict], first_line: int = 1, context: int = 6, parsed: list[Section] | None = None) -> list[dict]:
    """Fenced code in order, numbered within its heading path, with prose chunks of the same section."""
    out: list[dict] = []
    counts: dict[tuple, int] = {}
    for section in sections(body, first_line) if parsed is None else parsed:
        for block in section.blocks:
            if block.type != "code":
                continue
            path = tuple(section.path)
            counts[path] = counts.get(path, 0) + 1
            prose = [c["id"] for c in chunks if c["headingPath"] == section.path and "code" not in c["blockTypes"]] or [c["id"] for c in chunks if c["sectionTitle"] == section.title and "code" not in c["blockTypes"]]
            word = re.sub(r"[^a-z0-9_+-]", "", (block.language.lower().split() or [""])[0])[:40] or "text"
            out.append({
                "id": digest("code", 24, post["id"], *path, counts[path], block.content), "anchor": f"code-{len(out) + 1}", "postId": post["id"], "postTitle": post["title"], "postUrl": post["url"], "sectionTitle": section.title,
                "headingPath": section.path, "ordinal": counts[path], "language": word, "code": block.content, "sourceLineStart": block.start, "sourceLineEnd": block.end, "contextChunkIds": prose[:context],
                "contentHash": "sha256:" + hashlib.sha256(block.content.encode()).hexdigest(),
            })
    return out


def internal_links(body: str, origin: str) -> list[tuple[str, str, str]]:
    """Links that stay on the site: (label, target without query, anchor); images and other schemes are left out."""
    out: dict[tuple, None] = {}
    for label, target in re.findall(r"(?<!!)\[([^\]]*)\]\(([^)\s]+)[^)]*\)", without_comments(body)):
        target, _, anchor = target.partition("#")
        target = target.partition("?")[0]
        if re.match(r"(?i)(?:mailto|javascript|data):", target) or not (target.startswith(("/", origin)) or target.endswith(".md")) or target.startswith("//"):
            continue
        out[label, target.removeprefix(origin) or "/", anchor] = None
    return list(out)
