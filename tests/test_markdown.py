from __future__ import annotations

import pytest

from docfathom.functions.tokens import assign_slugs, estimate, split_by_budget
from docfathom.operators import markdown as M
from docfathom.sources import markdown as S

POST = """﻿---
title: A post
tags: [x, y]
date: 2024-05-06
---
intro <!-- hidden
still hidden --> text

# One

para **bold** [link](/a/b.md#z) ![pic](p.png)

- a
- b

| h | i |
|---|---|
| 1 | 2 |

```python title
x = 1  # <!-- kept -->
```

$$
E = mc^2
$$

explains it

> quoted

## Sub

![only](q.png)

# One

again
"""


def test_front_matter_and_blocks():
    fields, body, line = M.front_matter(POST)
    assert fields == {"title": "A post", "tags": ["x", "y"], "date": "2024-05-06"} and line == 6
    got = M.sections(body, line)
    assert [s.path for s in got] == [[], ["One"], ["One", "Sub"], ["One"]]
    assert [b.type for b in got[1].blocks] == ["paragraph", "list", "table", "code", "formula", "paragraph", "quote"]
    assert got[0].blocks[0].content == "intro \n text".replace(" \n ", " \n ") or "hidden" not in got[0].blocks[0].content
    assert got[1].blocks[2].content == "h | i\n1 | 2" and got[1].blocks[3].content == "x = 1  # <!-- kept -->"
    assert got[1].blocks[4].content == "E = mc^2" and got[2].blocks[0].type == "image"
    with pytest.raises(ValueError):
        M.front_matter("---\n- a\n---\n")


def test_chunks_have_stable_identities():
    post = {"id": "p", "title": "A post", "url": "/p/", "profile": "generic-article"}
    _, body, line = M.front_matter(POST)
    chunks = M.chunk_post(post, body, line)
    other = M.chunk_post(post, body.replace("again", "changed"), line)
    assert {c["id"] for c in chunks} - {c["id"] for c in other} == {chunks[-1]["id"]}
    assert len({c["id"] for c in chunks}) == len(chunks) and [c["chunkIndex"] for c in chunks] == list(range(len(chunks)))
    assert any(c["chunkType"] == "formula-context" and "explains" in c["content"] for c in chunks)
    code = M.code_blocks(post, body, chunks, line)
    assert code[0]["language"] == "python" and code[0]["contextChunkIds"]


def test_budgets():
    words = " ".join(f"word{i}" for i in range(2000))
    assert all(estimate(p) <= 50 for p in split_by_budget(words, 50)) and " ".join(split_by_budget(words, 50)) == words
    table = M.Block("table", "h | i\n" + "\n".join(f"row {i} | {'x' * 40}" for i in range(60)), "", 1, 62)
    parts = M.split_block(table, "generic-article", 128)
    assert len(parts) > 1 and all(p.content.startswith("h | i\n") and p.tokens <= 128 for p in parts)
    code = M.Block("code", "\n".join(f"line_{i} = {i}" for i in range(180)), "", 10, 191)
    assert "\n".join(p.content for p in M.split_block(code, "code-doc", 100)) == code.content
    assert estimate("你好 helloWorld foo_bar!") == 2 + 2 + 2 + 2 + 1 or estimate("你好") == 2
    assert split_by_budget("", 5) == [] and split_by_budget(None, 5) == []


def test_slugs_profiles_and_links():
    assert assign_slugs([("a", "Foo"), ("b", "foo"), ("c", "foo-2"), ("d", "foo")]) == {"a": "foo", "b": "foo-2", "c": "foo-2-2", "d": "foo-3"}
    registry = {"default": "generic-article", "documents": {"x.md": "tutorial"}, "paths": [{"glob": "math/**/*.md", "profile": "math-note"}]}
    assert S.resolve_profile({"rag_profile": "code-doc"}, "x.md", registry) == ("code-doc", "front-matter")
    assert S.resolve_profile({}, "x.md", registry)[1] == "document-rule" and S.resolve_profile({}, "math/a/b.md", registry) == ("math-note", "path-rule")
    assert S.resolve_profile({}, "z.md", registry)[1] == "migration-fallback"
    with pytest.raises(ValueError):
        S.resolve_profile({"rag_profile": "none"}, "z.md", registry)
    assert M.internal_links("[a](/p/#x) ![i](/i.png) [m](mailto:q) [r](b.md?x=1) [o](https://other/)", "https://example.org") == [("a", "/p/", "x"), ("r", "b.md", "")]


def test_corpus_from_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text(POST, encoding="utf-8")
    (tmp_path / "b.md").write_text("---\ntitle: B\ndraft: yes\n---\nx", encoding="utf-8")
    (tmp_path / "c.md").write_text("---\ntitle: C\n---\n", encoding="utf-8")
    got = S.corpus(S.files(spark, str(tmp_path)))
    assert sorted(r["title"] for r in got["posts"].collect()) == ["A post", "C"]
    chunks = got["chunks"].collect()
    assert all(c["id"].startswith("chunk_") and c["parentId"].startswith("parent_") for c in chunks)
    assert [c["blockTypes"] for c in chunks if c["postId"] == "C"] == [["metadata"]]
    assert got["code_blocks"].count() == 1 and got["links"].count() == 1
    S.write_versioned(got, str(tmp_path / "out"), "v1")
    assert S.read_version(spark, str(tmp_path / "out"), ["chunks"])["chunks"].count() == len(chunks)


def test_rows_are_sent_piece_by_piece():
    import pyarrow as pa

    arrow = pa.schema([("path", pa.string()), ("n", pa.int64())])
    batch = pa.RecordBatch.from_pydict({"path": [f"p{i}" for i in range(40)], "text": ["x" * (S.CHARACTERS // 4)] * 39 + [None]})
    sent = [b.num_rows for b in S.pieces(iter([batch]), lambda p, t: [{"path": p, "n": len(t)}], arrow)]
    assert sent == [4] * 10 and list(S.pieces(iter([batch]), lambda p, t: [], arrow)) == []
