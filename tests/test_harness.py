from __future__ import annotations

import pytest

from tessera import cli
from tessera.operators import access
from tessera.sources import harness


def test_files_and_stats(spark, tmp_path):
    for name in ("z/projects/p/memory/a.md", "z/deep/b.md", "z2/deep/c.md", "c/top.MD", "c/sub/no.md", "g/sub/d.md", "g/.hid/x.md", "one.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}")
    hs = harness.configured(
        [
            {"name": "z", "type": "zcode", "paths": [str(tmp_path / "z"), str(tmp_path / "z2")]},
            {"name": "c", "type": "codex", "path": str(tmp_path / "c")},
            {"name": "g", "paths": [f"{tmp_path}/g/**/*.md", str(tmp_path / "one.md")]},
            {"name": " "},
        ],
        [harness.Harness("c", display="C")],
    )
    assert [[p.name for p in harness.memory_files(h)] for h in hs if h.name == "z"] == [["a.md", "c.md"]]
    assert {h.name: len(harness.memory_files(h)) for h in hs} == {"c": 1, "z": 2, "g": 2}
    assert harness.prefix("/a/b*/c") == "/a" and harness.prefix("/a") == "/a" and hs[0].display == "C"
    index = spark.createDataFrame([(f"{tmp_path}/c/top.MD",), (f"{tmp_path}/c/top.MD",), ("/else",)], "source string")
    stored = spark.createDataFrame([("c", "old")], "owner string, fingerprint string")
    got = {r.owner: (r.files, r.chunks, r.status) for r in harness.stats(spark, hs, index, stored).collect()}
    assert got == {"c": (1, 2, "stale"), "z": (2, 0, "missing"), "g": (2, 0, "missing")}


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/a.md").write_text("# A\nquick fox")
    conf = tmp_path / "c.toml"
    conf.write_text('[[sources]]\npath = "notes"\n')
    at = ["--config", str(conf)]
    assert cli.main([*at, "ingest"]) == 0 and '"added": 1' in capsys.readouterr().out
    cli.main([*at, "search", "fox", "-k", "1", "--mode", "lexical"])
    assert "quick fox" in capsys.readouterr().out
    cli.main([*at, "state", "save", "t", "k", '{"a": 1}'])
    cli.main([*at, "state", "get", "t", "k"])
    assert '{"a": 1}' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.since(spark, "last week")
    assert access.allowed("admin", "editor") and not access.allowed("viewer", "editor") and not access.allowed("x", "viewer")


def test_memory_files(spark, tmp_path):
    from tessera.engine import Config, Engine

    mem = tmp_path / "mem"
    e = Engine(spark, Config(store=str(tmp_path / "i"), memories=str(mem)))
    assert e.memory_files().count() == 0
    for name, text in {"a.md": "---\ntags: [x]\ntitle: \"A note\"\n---\nbody", "B.MD": "no head", "harness/z.md": "---\ntitle: Z digest\n---\n", "._c.md": "no", ".trash/d.md": "no", "sub/e.md": "no", "f.txt": "no"}.items():
        (mem / name).parent.mkdir(parents=True, exist_ok=True)
        (mem / name).write_text(text)
    got = [(r.name, r.group, r.tool, r.size, r.title) for r in e.memory_files().collect()]
    assert got == [("B.MD", "shared", "", 7, "B"), ("a.md", "shared", "", (mem / "a.md").stat().st_size, "A note"), ("harness/z.md", "harness", "z", (mem / "harness/z.md").stat().st_size, "Z digest")]
