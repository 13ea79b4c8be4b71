"""Notes as a data source: filters reach the listing; changes and removals as a stream across restarts."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tessera.sources import notes_source


def folder(tmp_path):
    root = tmp_path / "notes"
    (root / "sub").mkdir(parents=True)
    (root / ".hidden").mkdir()
    for name, text in {"a.md": "alpha", "b.TXT": "beta é", "sub/c.md": "gamma", "_d.md": "delta", ".hidden/x.md": "no", "noend": "end", "empty.md": ""}.items():
        (root / name).write_text(text)
    os.utime(root / "a.md", (1000, 1000))
    return root


def test_batch_and_pushed_filters(spark, tmp_path):
    root = folder(tmp_path)
    notes_source.register(spark)
    df = spark.read.format("notes").load(str(root))
    rows = {r.path.removeprefix(f"{root}/"): (r.suffix, r.length, bytes(r.content)) for r in df.collect()}
    assert rows == {"a.md": (".md", 5, b"alpha"), "b.TXT": (".txt", 7, "beta é".encode()), "sub/c.md": (".md", 5, b"gamma"), "_d.md": (".md", 5, b"delta"), "noend": ("", 3, b"end"), "empty.md": (".md", 0, b"")}
    some = df.where((F.col("suffix") == ".md") & (F.col("mtime") > 2000) & F.col("path").contains("sub") & (F.col("length") > 1))
    assert [r.path.rsplit("/", 1)[1] for r in some.collect()] == ["c.md"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line and "length" in line]
    assert filters and "suffix" not in filters[0].split("Filter")[1] and "mtime" not in filters[0].split("Filter")[1]  # what is pushed is not applied again
    bare = spark.read.format("notes").option("contents", "false").load(str(root))
    assert bare.count() == 6 and bare.where("content IS NOT NULL").count() == 0
    assert spark.read.format("notes").load(str(tmp_path / "none")).count() == 0


def test_partitions_by_size(tmp_path, monkeypatch):
    root = folder(tmp_path)
    monkeypatch.setattr(notes_source, "PARTITION_BYTES", 10)
    parts = notes_source.NotesReader({"path": str(root)}).partitions()
    assert len(parts) == 3 and sum(len(p.files) for p in parts) == 6


def test_changes_across_restarts(spark, tmp_path):
    root = folder(tmp_path)
    notes_source.register(spark)
    seen = []

    def run():
        def take(batch, n):
            seen.append((n, sorted((r.path.removeprefix(f"{root}/"), r.change) for r in batch.collect())))

        feed = spark.readStream.format("notes").option("state", str(tmp_path / "state")).load(str(root))
        q = feed.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(once=True).start()
        assert q.awaitTermination(120)
        return seen[-1][1] if seen else []

    assert {c for _, c in run()} == {"added"} and len(seen[-1][1]) == 6
    (root / "a.md").write_text("other text")
    (root / "b.TXT").unlink()
    (root / "new.md").write_text("n")
    assert run() == [("a.md", "changed"), ("b.TXT", "removed"), ("new.md", "added")]
    (root / "new.md").unlink()
    assert run() == [("new.md", "removed")]
    before = len(seen)
    run()
    assert all(not rows for _, rows in seen[before:])  # nothing new
    reader = notes_source.NotesChanges({"path": str(root), "state": str(tmp_path / "s2")})
    first = reader.latestOffset()
    assert reader.latestOffset() == first
    (root / "a.md").write_text("again, longer")
    second = reader.latestOffset()
    again = notes_source.NotesChanges({"path": str(root), "state": str(tmp_path / "s2")})
    for r in (reader, again):  # a batch tried again, also by another reader, has the same rows
        assert [x for p in r.partitions(first, second) for x in r.read(p)] == [(str(root / "a.md"), "changed", *second_row(root / "a.md"))]


def second_row(path):
    s = path.stat()
    return s.st_mtime_ns / 1e9, s.st_size
