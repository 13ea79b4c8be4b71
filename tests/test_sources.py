from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import chats, files, logs, markup, sinks


def test_html():
    page = "<title>T</title><style>x</style><h2>A &amp; B</h2><p>one<br>two<b>!</b></p><ul><li>a<li>b</ul><script>var x='</p>'</script><svg><text>no</text></svg>tail"
    assert markup.html_to_markdown(page) == "## A & B\n\none two!\n\n- a\n\n- b\n\ntail"
    assert markup.html_to_markdown("<title> Only </title><p>x</p>") == "# Only\n\nx"
    assert markup.html_to_markdown("<div></div>") == ""
    assert markup.decode_html("中文".encode("gb18030")) == "中文"
    assert markup.decode_html(b'<meta charset="latin-1">\xe9') == '<meta charset="latin-1">é'


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_org(spark):
    org = "#+TITLE: T\n#+FILETAGS: :a:b:\n#+AUTHOR: me\n* One\n** Two\n  + item\n[[https://x][X]] [[file:y][Y]] [[z]] [[mailto:m@x]] [[w][]]"
    assert one(spark, chats.org_to_markdown, org) == "---\ntags: [a, b]\n---\n\n# T\n\n## One\n### Two\n  - item\n[X](https://x) Y z [mailto:m@x](mailto:m@x) w"
    assert one(spark, chats.org_to_markdown, "* One") == "# One" and one(spark, chats.org_to_markdown, "#+TITLE: \n******* deep") == "###### deep"


def test_docx():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>a &amp; </w:t><w:t xml:space='preserve'>b</w:t></w:p><w:p></w:p><w:p><w:t>c</w:t></w:p>")
    assert markup.docx_to_text(raw.getvalue()) == "a & b\n\nc"
    assert markup.docx_to_text(b"no zip") is None


def test_docx_tables():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        cell = "<w:tc><w:p><w:t>{}</w:t></w:p></w:tc>"
        z.writestr("word/document.xml", "<w:p><w:t>before</w:t></w:p><w:tbl><w:tr w:x='1'>" + cell.format("a") + cell.format("b") + "</w:tr><w:tr>" + cell.format("c") + cell.format("") + "</w:tr></w:tbl><w:p><w:t>after</w:t></w:p>")
    assert markup.docx_to_text(raw.getvalue()) == "before\n\nafter\n\na | b\n\nc | "


def test_chat_exports(spark):
    def said(role, t, *parts, kind="text"):
        return {"message": {"author": {"role": role}, "create_time": t, "content": {"content_type": kind, "parts": list(parts)}}}

    def read(raw):
        got = one(spark, chats.conversations, raw)
        return None if got is None else [tuple(r) for r in got]

    first = {"title": "A", "mapping": {"2": said("assistant", 2, "there"), "1": said("user", 1, "hi", {"x": 1}), "0": said("system", 0, "no"), "3": said("user", 3, "code", kind="code"), "4": None, "5": {"message": None}, "9": said("user", None, "first", "of two"), "8": said("user", 0, "second", kind=None)}}
    got = read(json.dumps([first, {**first, "title": "a"}, {**first, "title": "x", "mapping": {}}, {**first, "title": "a (2)"}, {**first, "title": None}]))
    assert got[0] == ("A", "# A\n\n**user**: first\nof two\n\n**user**: second\n\n**user**: hi\n\n**assistant**: there")
    assert [t for t, _ in got] == ["A", "a (2)", "a (2) (2)", "untitled conversation"]
    other = {"chats": [{"name": None, "chat_messages": [{"sender": "assistant", "created_at": "2", "content": [{"type": "text", "text": "b"}, {"type": "tool"}, {"type": "text", "text": "c"}]}, {"sender": "human", "created_at": "1", "text": "a"}, {"sender": "human", "created_at": "3", "text": " "}]}]}
    assert read(json.dumps(other)) == [("untitled conversation", "# untitled conversation\n\n**user**: a\n\n**assistant**: b\nc\n\n")]
    assert read("{}") is None and read("nope") is None and read("[]") is None
    assert [t for t, _ in read(json.dumps([first] * 4 + [{**first, "title": "A (3)"}]))] == ["A", "A (2)", "A (3)", "A (4)", "A (3) (2)"]


def test_names_with_an_underscore(spark, tmp_path):
    for name in ("_index.md", "_drafts/x.md", "sub [1]/_a.md", "sub [1]/_b/_c/d.md", "plain.md"):
        p = tmp_path / "notes" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"text of {name}")
    root = str(tmp_path / "notes")
    got = {r.path.removeprefix(root + "/"): r.content for r in files.scan(spark, [{"path": root}]).collect()}
    assert got == {n: f"text of {n}" for n in ("_index.md", "_drafts/x.md", "sub [1]/_a.md", "sub [1]/_b/_c/d.md", "plain.md")}
    assert files.load_one(spark, f"{root}/_index.md").first().content == "text of _index.md"
    assert files.is_folder(spark, root) and not files.is_folder(spark, f"{root}/no")


def test_scan(spark, tmp_path):
    def put(name, data):
        p = tmp_path / "notes" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())

    put("a.md", "---\ntags: [x, y]\n---\n# A\nsee [[b]]")
    put("sub/b c+d.TXT", "plain")
    put("page.html", "<h1>P</h1>")
    put("empty.md", "  \n")
    put(".trash/gone.md", "no")
    put("~$a.docx", "no")
    put("bad.md", b"\xff\xfe")
    put("photo.bin", "no")
    put("conversations.json", json.dumps({"chats": [{"name": "C", "chat_messages": [{"sender": "human", "created_at": "1", "text": "q"}]}]}))
    root = tmp_path / "notes"
    rows = {r.path.removeprefix(f"{root}/"): r for r in files.scan(spark, [{"path": str(root), "chunk_size": 9}, {"path": str(root / "sub")}]).collect()}
    assert sorted(rows) == ["a.md", "conversations.json::C", "page.html", "sub/b c+d.TXT"]
    assert rows["a.md"].tags == "x,y" and rows["a.md"].links == "b" and rows["a.md"].content == "# A\nsee [[b]]" and rows["a.md"].chunk_size == 9
    assert rows["conversations.json::C"].tags == "chatlog" and rows["page.html"].content == "# P"
    put("front.md", "---\na: 1\n---\n")
    assert files.load_one(spark, str(root / "front.md")).count() == 0
    assert files.scan(spark, []).count() == 0


def test_logs_skip_torn_lines(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"query": "a", "hits": 1}\n\n{"query": "b"\n{"query": "c", "hits": 0}\n')
    assert [r.query for r in logs.read(spark, str(p), "queries").orderBy("ord").collect()] == ["a", "c"]


def test_export_and_import(spark, tmp_path):
    rows = [("a.md::0", "a.md", 0, "S", "text é", "t", "x,y", 1.5, "h", "c", [0.12345678, 1.0])]
    index = spark.createDataFrame(rows, "id string, source string, chunk int, section string, text string, tags string, links string, mtime double, hash string, chash string, vec array<double>")
    sinks.export_jsonl(index, str(tmp_path / "out"), "m", 2)
    back, meta = logs.import_rows(spark, str(tmp_path / "out"), "m")
    got = back.first()
    assert meta == {"chunks": 1, "embed_model": "m", "embed_dim": 2} and got.vec == [0.123457, 1.0] and got.links == "x,y" and got.text == "text é"
    with pytest.raises(ValueError, match="exported with m"):
        logs.import_rows(spark, str(tmp_path / "out"), "other")
    assert logs.import_rows(spark, str(tmp_path / "out"), "other", force=True)[0].count() == 1


def test_snapshots(spark, tmp_path):
    t = sinks.SnapshotTable(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.replace(spark.createDataFrame([("a", 1), ("b", 1)], "source string, n int"))
    t.upsert(spark.createDataFrame([("a", 2)], "source string, n int"))
    assert sorted(map(tuple, t.read().collect())) == [("a", 2), ("b", 1)]
    t.drop_old(1)
    assert t.read().count() == 2


def test_state(tmp_path):
    s = sinks.StateStore(str(tmp_path))
    s.save("task/x", "k 1", {"a": 1})
    s.save("task/x", "k 1", [2])
    assert s.get("task/x", "k 1") == [2] and s.get("task/x", "none") is None
    assert [r["key"] for r in s.listed("task")] == ["k-1"] and s.listed("other") == []
    with pytest.raises(ValueError, match="object or array"):
        s.save("t", "k", "text")
    with pytest.raises(ValueError, match="bytes at most"):
        s.save("t", "k", ["x" * 300_000])
    assert s.delete("task/x", "k 1") and not s.delete("task/x", "k 1")


def test_names(tmp_path):
    (tmp_path / "a.md").write_text("x")
    assert sinks.free_name(str(tmp_path), "../../a.md").name == "a-2.md"
    for bad in ("", ".x", "con.txt", "desktop.ini"):
        with pytest.raises(ValueError, match="not a file name"):
            sinks.free_name(str(tmp_path), bad)
    assert sinks.slug("Über uns!") == "über-uns" and sinks.slug("!!") == "memory"


def test_org_lines_are_split_once(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("#+TITLE: T\n* a\n + b\n[[c]] +d\n#+x\n",), (None,)], "t string").select(chats.org_to_markdown(F.col("t")).alias("m"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(regexp_replace(") == 1
    assert [r.m for r in df.collect()] == ["# T\n\n## a\n - b\nc +d\n#+x", None]
