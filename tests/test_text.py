"""Column functions on literal texts, many of them outside what the given tables contain."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from notemill.functions import learning as ln, markup, text as tx
from notemill.operators import chunks as ch, crawl, gates


def one(spark, fn, *values):
    cols = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{c} {_type(v)}" for c, v in zip(cols, values)))
    return df.select(fn(*[F.col(c) for c in cols])).first()[0]


def _type(v):
    if isinstance(v, list):
        return f"array<{_type(v[0])}>" if v else "array<string>"
    return {str: "string", int: "bigint", float: "double", type(None): "string"}[type(v)]


@pytest.mark.parametrize("text,expected", [
    ("PCB的作用是什么", ["pcb", "的作", "作用", "用是", "是什", "什么"]),
    ("用pv操作", ["用", "pv", "操作"]),
    ("中", ["中"]),
    ("a中b", ["a", "中", "b"]),
    ("中a国x人民", ["中", "a", "国", "x", "人民"]),
    ("étion Déjà_vu 42", ["tion", "d", "j", "_vu", "42"]),
    ("", []),
    ("  ,.", []),
    ("LRU算法inode节点", ["lru", "算法", "inode", "节点"]),
    ("中文。标点，分 隔", ["中文", "标点", "分", "隔"]),
])
def test_tokens(spark, text, expected):
    assert one(spark, tx.tokens, text) == expected


@pytest.mark.parametrize("text,expected,tags", [
    ("---\ntitle: A\ntags: [x, \"y\"]\n---\nbody", {"title": "A", "tags": "[x, \"y\"]"}, ["x", "y"]),
    ("---\ntitle: 'Q'\ntags: a,b\ncourse : os\n---\n", {"title": "Q", "tags": "a,b", "course": "os"}, ["a", "b"]),
    ("---\ntags: []\nx: 1\nx: 2\n---\n", {"tags": "[]", "x": "2"}, []),
    ("---\ntitle: A\nno end", {}, []),
    ("text first\n---\na: b\n---\n", {}, []),
    ("---\n- list item\n key-2:  v \n---\n", {"key-2": "v"}, []),
])
def test_frontmatter(spark, text, expected, tags):
    assert one(spark, tx.frontmatter, text) == expected
    assert one(spark, lambda c: tx.tag_list(F.try_element_at(tx.frontmatter(c), F.lit("tags"))), text) == tags


def test_chunks_from_notes(spark):
    long = "x" * 20
    notes = [
        ("knowledge/os/a.md", "os/a.md", f"\ufeff---\r\ntitle: T\r\ncourse: os\r\ntags: [p]\r\n---\r\n{long}0\r\n## One\r\n{long}1\r\n## \r\n{long}2\r\n## Blank\r\n\r\n## Short\r\nabc\n### Not a cut\n{long}"),
        ("knowledge/os/README.md", "os/README.md", f"---\ncourse: os\n---\n{long}"),
        ("knowledge/_inbox/b.md", "_inbox/b.md", f"---\ncourse: os\n---\n{long}"),
        ("knowledge/os/c.md", "os/c.md", f"---\ncourse: os\ningest_status: candidate\n---\n{long}"),
        ("knowledge/os/d.md", "os/d.md", f"---\ntitle: no course\n---\n{long}"),
        ("knowledge/os/e.md", "os/e.md", f"---\ncourse: os\nsource_type: novel\ningest_status: odd\n---\n{long}"),
    ]
    rows = ch.chunk_table(spark.createDataFrame(notes, "file string, rel string, text string")).orderBy("file", "pos").collect()
    assert [(r.file[-4:], r.title, r.content[:25].strip()) for r in rows] == [
        ("a.md", "T", long + "0"), ("a.md", "One", long + "1"), ("a.md", "T", long + "2"), ("a.md", "Short", "abc\n### Not a cut\n" + long[:7]),
        ("e.md", "e", long)]
    assert len({r.chunk_id for r in rows}) == 5 and rows[0].tags == ["p"]


@pytest.mark.parametrize("rel,ok", [
    ("os/a.md", True), ("os/ReadMe.MD", False), ("_templates/x.md", False), ("a/_inbox/x.md", False), ("", False), ("os/_inbox.md", True)])
def test_path_gate(spark, rel, ok):
    assert one(spark, gates.indexable_path, rel) is ok


@pytest.mark.parametrize("course,kind,state,ok", [
    ("os", None, None, True), (" ", None, None, False), ("os", "ai_draft", None, False), ("os", "web_candidate", "approved", False),
    ("os", "made up", "made up", True), ("os", "web_reviewed", "rejected", False), ("os", " human_markdown ", "approved", True)])
def test_meta_gate(spark, course, kind, state, ok):
    assert one(spark, gates.indexable_meta, course, kind, state) is ok


def test_output_gate():
    gates.assert_output_allowed("/k/_inbox/x", "/k")
    gates.assert_output_allowed("/kk/x", "/k")
    gates.assert_output_allowed("/k/x", "/k", allow_knowledge_write=True)
    with pytest.raises(ValueError, match="DENIED"):
        gates.assert_output_allowed("/k/os", "/k")


def test_known_courses():
    assert gates.known_courses(" all ") == ["os", "ds", "co"]
    assert gates.known_courses("DS, os,ds") == ["ds", "os"]
    with pytest.raises(ValueError, match="unknown course"):
        gates.known_courses("os,xx")


def test_keys_of_pages(spark):
    assert one(spark, tx.norm_url, " HTTPS://www.Example.com/A/?q=1#f ") == "example.com/a"
    assert one(spark, tx.norm_url, "http://example.com//") == "example.com"
    assert one(spark, tx.norm_title, " 进程，与\u00a0线程（一）! ") == "进程与线程一!"
    kept = "".join(ch for ch in "a-b #c* " * 400 if ch not in "-#* ")
    assert one(spark, tx.content_fp, "a-b #c* " * 400) == hashlib.sha1(kept.encode()).hexdigest()


@pytest.mark.parametrize("title,expected", [
    ("进程（线程）", "进程线程"), ("A B，C", "A-B-C"), ("（）", "untitled"), ("- x -", "x"), ("a" * 49 + " bcd", "a" * 41 + "-26892d5d")])
def test_slug(spark, title, expected):
    assert one(spark, tx.slug, title) == expected


def test_lead_and_structure(spark):
    assert one(spark, tx.lead_sentences, "短。这是第一个足够长的句子。第二个也是足够长的句子！第三个同样足够长的句子") == "这是第一个足够长的句子。第二个也是足够长的句子。"
    assert one(spark, tx.lead_sentences, "abc. de.") == "abc. de."
    note = one(spark, tx.structure_note, "## TL;DR\nsum\n## 原理\nhow\n## 易错点\n\n## 概述\nold\n## 概述\nnew")
    assert "> sum" in note and "## 核心概念\n\nnew" in note and "## 关键原理 / 算法\n\nhow" in note and "## 易错点" not in note
    assert note.endswith("## 关联条目\n\n- （待补充关联条目链接）")


def test_snippet(spark):
    text = "a" * 250 + "。" + "b" * 100 + "，" + "c" * 100
    assert one(spark, tx.snippet, text) == "a" * 250 + "。…"
    assert one(spark, tx.snippet, "a" * 100 + "。" + "b" * 400) == "a" * 100 + "。" + "b" * 299 + "…"
    assert one(spark, tx.snippet, "a" * 400) == "a" * 400
    assert one(spark, tx.snippet, "a" * 201 + "。" + "b" * 300) == "a" * 201 + "。…"
    assert one(spark, tx.snippet, "a" * 200 + "。" + "b" * 300) == "a" * 200 + "。" + "b" * 199 + "…"


@pytest.mark.parametrize("html,expected", [
    ("<html><body><nav>menu</nav><article><h1>T&amp;C</h1><p>one <b>two</b></p><!-- x --></article><footer>f</footer></body></html>", "T&C\none\ntwo"),
    ("<body><main>a<script>x<y</script><p>b&nbsp;</p></main>c</body>", "a\nb"),
    ('<div class="post-content">in</div>out', "in"),
    ("<body>p&lt;q &#65;&#x4e2d; &amp;lt;<aside>no</aside></body>", "p<q A中 &lt;"),
    ("just <i>text</i>", "just\ntext"),
    ("", ""),
    ("<article>l1\n\n\n\nl2</article>", "l1\n\nl2"),
])
def test_html_text(spark, html, expected):
    assert one(spark, markup.html_text, html) == expected


def test_page_title_and_squeeze(spark):
    assert one(spark, markup.page_title, "<TITLE lang=x> a &amp; b\n</TITLE>") == "a & b"
    assert one(spark, markup.page_title, "<p>none</p>") == ""
    assert one(spark, markup.squeeze, " a \n \n\n \n\nb ") == "a\n\nb"
    assert one(spark, lambda a, b: crawl.resolve_title(a, b), "", "") == "未命名条目"


def test_render_candidate_reads_back(spark):
    df = spark.createDataFrame([("It's: a #1 title", "os", ["x: y", "z"], "中等", "https://e.com/a?b=1", "## B\n\ntext")],
                               "title string, course string, tags array<string>, difficulty string, url string, body string")
    text = df.select(crawl.render_candidate(*[F.col(c) for c in ("title", "course", "tags", "difficulty", "url", "body")], "2024-01-02")).first()[0]
    assert text.splitlines()[:5] == ["---", "title: 'It''s: a #1 title'", "course: os", "tags:", "- 'x: y'"]
    assert "updated: '2024-01-02'\nsource_type: web_candidate\ningest_status: candidate\nsource_url: https://e.com/a?b=1\n---\n\n## B" in text


@pytest.mark.parametrize("answer,reference,expected", [
    ("死锁", "产生死锁的四个条件", True), ("锁", "死锁", False), ("", "x", False), ("!?", "x", False),
    ("abcdefgh", "abcdefxx", True), ("abcdwxyz", "abcd", False)])
def test_grading(spark, answer, reference, expected):
    assert one(spark, lambda a, r: ln.is_correct(a, F.array(r, F.lit(""))), answer, reference) is expected


def test_char_ngrams(spark):
    assert one(spark, ln.char_ngrams, "") == []
    assert one(spark, ln.char_ngrams, "a") == ["a"]
    assert one(spark, ln.char_ngrams, "abab") == ["ab", "ba"]
    assert one(spark, lambda c: ln.char_ngrams(c, 3), "中文字符") == ["中文字", "文字符"]


def test_hints(spark):
    assert one(spark, ln.hint, "短句。然后是很长很长的内容", "e") == "提示：短句。然后是很长很长的内容 请结合出处再答一次。"
    assert one(spark, ln.hint, "这是一个足够长的句子。后面", "e") == "提示：这是一个足够长的句子。 请结合出处再答一次。"
    assert one(spark, ln.hint, "", " ") == "请结合讲解和来源笔记再答一次。"
    assert one(spark, ln.full_reference, "", "why") == "why"


def test_intervals(spark):
    df = spark.range(0, 9).select(ln.next_interval(F.col("id")).alias("d"))
    assert [r.d for r in df.orderBy("d").collect()] == [1, 1, 2, 4, 8, 16, 32, 32, 32]


def test_paths(spark):
    assert one(spark, tx.path_title, "knowledge/os/deadlock.md") == "deadlock"
    assert one(spark, tx.path_course, "knowledge/os/x.md") == "os"
    assert one(spark, tx.path_course, "other/os/x.md") is None


@pytest.mark.parametrize("html,expected", [
    ('<div class="content"><p>one</p><div class="box">two</div><p>three</p></div><p>out</p>', "one\ntwo\nthree"),
    ("<article>a<article>b</article>c</article>d", "a\nb\nc"),
    ("<body><main>x<div>y</div>z</body>", "x\ny\nz"),
    ("<ARTICLE>caf&eacute; &#128512; &uuml;ber &amp;lt; &nosuch; &#x41;&#0;</ARTICLE>", "café 😀 über &lt; &nosuch; A�"),
    ("plain & simple", "plain & simple"),
])
def test_html_text_of_nested_pages(spark, html, expected):
    assert one(spark, markup.html_text, html) == expected


def test_no_page_text_is_cut(spark):
    long = "sentence number one. " * 300
    assert long.strip() in one(spark, tx.structure_note, long)
    assert one(spark, tx.content_fp, "x" * 900 + "a") != one(spark, tx.content_fp, "x" * 900 + "b")
    stems = {one(spark, tx.slug, "t" * 60 + end) for end in ("a", "b")}
    assert len(stems) == 2 and all(len(s) <= 50 for s in stems)
    assert one(spark, tx.section_map, "##\nplain line\nmore") == {}
