from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.engine import Config, Engine


@pytest.fixture
def engine(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "fox.md").write_text("---\ntags: [animals]\n---\n# Fox\nthe quick fox jumps [[garden]]")
    (notes / "garden.md").write_text("# Garden\ntomatoes and beans\nsupersedes nothing")
    (notes / "plan.md").write_text("---\nsupersedes: old-plan\neffective: 2024-05-01\n---\n# Plan\nuse user_id as the key")
    (notes / "old-plan.md").write_text("# Old\nuse user-id as the key of the fox")
    c = Config(sources=[{"path": str(notes)}], store=str(tmp_path / "index"), memories=str(tmp_path / "mem"), wiki=str(tmp_path / "wiki"), state=str(tmp_path / "state"), query_log=str(tmp_path / "q.jsonl"))
    return Engine(spark, c)


def test_round(engine, tmp_path):
    assert engine.ingest() == {"added": 4, "pruned": 0}
    assert engine.stats() == {"chunks": 4, "files": 4}
    hits = engine.search("quick fox", 2).orderBy("rank").collect()
    assert hits[0].source.endswith("/fox.md") and hits[0].section == "Fox" and hits[0].chunk_id.endswith("fox.md::0")
    assert engine.search("user_id", 1).first().source.endswith("/plan.md")
    assert engine.search("fox", 5, tag="animals").count() == 1
    with pytest.raises(ValueError, match="empty"):
        engine.search("  ")
    (tmp_path / "notes/garden.md").unlink()
    (tmp_path / "notes/fox.md").write_text("# Fox\nthe fox sleeps")
    assert engine.ingest() == {"updated": 1, "unchanged": 2, "pruned": 1}
    text = engine.ask("key of the fox", 3)
    assert "[SUPERSEDED by plan — historical" in text and "[chunk 1 | source: " in text
    assert engine.feedback("bad") >= 1
    before = {r.chunk_id: r.distance for r in engine.search("fox", 3, mode="vector").collect()}
    assert max(before.values()) >= 0.15
    assert engine.history("plan").splitlines()[-1] == "  2. plan (effective 2024-05-01)"
    assert engine.demo("fox sleeps").orderBy("rank").first().relative == 1.0


def test_memories(engine):
    engine.ingest()
    path = engine.remember("Remember the milk.\nAlways.", tags=["shop", None, 3])
    assert engine.search("milk", 1).first().source == path
    assert engine.forget("milk")[0].endswith(".md")
    assert engine.index().where(f"source = '{path}'").count() == 0
    assert engine.wiki("fox").endswith("fox.md")


def test_a_missing_source_leaves_the_index_alone(engine, tmp_path):
    engine.ingest()
    engine.config.sources.append({"path": str(tmp_path / "unplugged")})
    with pytest.raises(FileNotFoundError, match="unchanged"):
        engine.ingest()
    assert engine.stats()["files"] == 4


def test_quality(engine):
    for i in range(3):
        engine.log_query(f"q{i}", i, "", 1.23)
    q = engine.quality().first()
    assert (q.queries, q.zero_hit_rate, q.avg_hits) == (3, 0.3333, 1.0)


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.toml").write_text('store = "idx"\nchunk_size = 50\nchunk_overlap = 49\ntokenizer = "identifier"\n[[sources]]\npath = "notes"\n')
    monkeypatch.setenv("TESSERA_TOP_K", "0")
    c = Config.load(str(tmp_path / "c.toml"))
    assert (c.chunk_size, c.chunk_overlap, c.top_k, c.tokenizer) == (50, 25, 1, "identifier")
    assert c.store == str(tmp_path / "idx") and c.sources == [{"path": str(tmp_path / "notes")}]
    assert Config(tokenizer="none").tokenizer == "default"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_optional_parts():
    import subprocess
    import sys

    code = (
        "import sys\n"
        "class No:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('tessera.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert 'bm25_topk' in e.queries() and not any(q.startswith('op') for q in e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])


# ---- hooks and verbs ------------------------------------------------------------


def vector_of(text):
    """A hook's embedding: counts of three words."""
    low = F.lower(text)
    return F.array(*[F.size(F.regexp_extract_all(low, F.lit(rf"\b({w})\b"), F.lit(1))).cast("double") for w in ("apple", "ocean", "stone")], F.lit(0.01))


def made(spark, tmp_path, **hooks):
    notes = tmp_path / "notes"
    notes.mkdir(exist_ok=True)
    (notes / "a.md").write_text("# A\nword word word ocean ocean")
    (notes / "b.md").write_text("# B\nword apple apple apple")
    (notes / "c.md").write_text("# C\nword stone")
    c = Config(sources=[{"path": str(notes)}], store=str(tmp_path / "index"), memories=str(tmp_path / "mem"), wiki=str(tmp_path / "wiki"), state=str(tmp_path / "state"), query_log=str(tmp_path / "q.jsonl"))
    return Engine(spark, c, **hooks)


def test_stored_vectors_decide(spark, tmp_path):
    e = made(spark, tmp_path, embed=vector_of)
    assert e.ingest() == {"added": 3, "pruned": 0}
    hits = e.search("apple", 3, mode="vector").orderBy("rank").collect()
    assert hits[0].source.endswith("b.md") and hits[0].distance < 0.01 < hits[1].distance
    assert e.search(["ocean", "stone"], 1, mode="vector").count() == 2
    # another model, or another length, is refused, and nothing is written
    e.config.embed_model = "other"
    with pytest.raises(ValueError, match="rebuild"):
        e.ingest()
    e.config.embed_model = "token-hash"
    e._embed = lambda t: F.array(F.lit(1.0), F.lit(2.0))
    with pytest.raises(ValueError, match="rebuild"):
        e.ingest()
    assert e.rebuild() == {"added": 3, "pruned": 0} and {len(r.vec) for r in e.index().collect()} == {2}
    assert e.ingest() == {"unchanged": 3, "pruned": 0}


def test_logs_of_searches(spark, tmp_path):
    e = made(spark, tmp_path, label="me", role="editor")
    e.ingest()
    note = e.remember("A fact about the ocean.", "Ocean fact")
    e.search("ocean fact", 2)
    e.ask("ocean fact", 2)
    log = e.queries().collect()
    assert [(r.kind, r.query, r.label, r.role, r.hits) for r in log] == [("ask", "ocean fact", "me", "editor", 2), ("search", "ocean fact", "me", "editor", 2)] and log[0].top.startswith(note)
    health = e.memory_health().first()
    assert health.citations == 2 and health.recent_queries == ["ocean fact", "ocean fact"]
    with pytest.raises(PermissionError):
        e.audit()
    e.role = "admin"
    assert [r.action for r in e.audit().collect()] == ["remember"]
    e.role = "viewer"
    for verb in (e.ingest, lambda: e.remember("x"), lambda: e.forget("x"), e.digest):
        with pytest.raises(PermissionError):
            verb()


def test_rewrites_are_merged_before_filters(spark, tmp_path):
    e = made(spark, tmp_path)
    e.ingest()
    got = e.search("stone", 3, rewrite=lambda q: ["apple apple", 7, " "]).orderBy("rank").collect()
    assert {r.source[-4:] for r in got[:2]} == {"b.md", "c.md"}
    assert e.search("stone", 3, rewrite=lambda q: ["apple"], path_contains="b.md").count() == 1
    assert e.search("stone", 3, rewrite=lambda q: 1 / 0).first().source.endswith("c.md")
    assert e.search("stone", 3, rewrite=lambda q: "apple").count() == e.search("stone", 3).count()


def test_reranking(spark, tmp_path):
    reply = lambda p: F.when(p.contains("Query: word"), F.lit("Sure: [[0, 0], [1, 1], [2, 3], [9, 3], [1]]"))
    e = made(spark, tmp_path, ask_column=reply, similarity=lambda q, p: F.length(p))
    e.ingest()
    plain = [r.source for r in e.search("word", 3).orderBy("rank").collect()]
    assert [r.source for r in e.search("word", 3, rerank="model").orderBy("rank").collect()] == plain[::-1]
    assert [r.source for r in e.search("apple word", 3, rerank="model").orderBy("rank").collect()] == [r.source for r in e.search("apple word", 3).orderBy("rank").collect()]
    longest = e.search("word", 3, rerank="pairs").orderBy("rank").collect()
    assert [len(r.text) for r in longest] == sorted((len(r.text) for r in longest), reverse=True)


def test_verified_answers_and_chat(spark, tmp_path):
    asked = []

    def model(prompt):
        asked.append(prompt)
        if prompt.startswith("Check"):
            return 'ok [{"claim": "it is", "status": "supported", "excerpts": [1]}]'
        if prompt.startswith("List"):
            return '[{"title": "T", "text": "a lasting fact"}, {"text": " "}, 3]' if "first" in prompt else "nothing"
        return "the answer"

    e = made(spark, tmp_path, ask=model)
    e.ingest()
    text = e.ask("apple", 1, verify=True)
    assert text.startswith("the answer\n\nClaim-by-claim") and "✓ it is [excerpt 1]" in text
    assert e.verify("q", " ", e.search("apple")) == "(nothing to verify)"
    assert e.chat("first apple") == "the answer" and e.memories().first().title == "T"
    e.chat("second apple")
    assert "User: first apple" in next(p for p in reversed(asked) if "Question: second" in p)
    for i in range(6):
        e.chat(f"apple {i}")
    assert len(e._history) == 8 and e.memories().count() == 1
    e.clear()
    assert e._history == []
    e._ask = lambda p: 1 / 0
    assert e.extract("x") == [] and "no claims" in e.verify("q", "a", e.search("apple"))


def test_graph_is_incremental(spark, tmp_path):
    def reply(prompt):
        return F.concat(F.lit('[["'), F.regexp_extract(prompt, r"# (\w)", 1), F.lit('", "has", "word"]]'))

    e = made(spark, tmp_path, ask_column=reply)
    (tmp_path / "notes").rename(tmp_path / "mem")  # memories and wiki pages are what the graph reads
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/z.md").write_text("# Z\nnot read")
    long = "\n".join(f"# {c}\n" + c * 1990 for c in "EFG")  # two pieces of 2000 characters are read
    (tmp_path / "mem/long.md").write_text(long)
    assert {(r.s, r.o) for r in e.graph().collect()} == {(c, "word") for c in "ABCEF"}
    (tmp_path / "mem/a.md").unlink()
    (tmp_path / "mem/long.md").unlink()
    (tmp_path / "mem/b.md").write_text("# D\nword")
    assert {r.s for r in e.graph("word").collect()} == {"C", "D"} and e.hubs().first().name == "word"
    assert {r.s for r in Engine(spark, e.config).edges().collect()} == {"C", "D"}


def test_export_import_and_forget(spark, tmp_path):
    e = made(spark, tmp_path, embed=vector_of)
    e.ingest()
    e.export(str(tmp_path / "out"))
    other = Engine(spark, Config(store=str(tmp_path / "other"), memories=str(tmp_path / "m2"), wiki=str(tmp_path / "w2"), query_log=str(tmp_path / "q2.jsonl")), embed=vector_of)
    assert other.import_index(str(tmp_path / "out")) == 3
    plain = lambda x: sorted((r.id, r.text, r.chash, tuple(round(v, 6) for v in r.vec)) for r in x.index().collect())
    assert plain(other) == plain(e)
    assert [r.source for r in other.search("apple", 1, mode="vector").collect()] == [r.source for r in e.search("apple", 1, mode="vector").collect()]
    other.config.embed_model = "another"
    with pytest.raises(ValueError, match="exported with"):
        other.import_index(str(tmp_path / "out"))
    first = e.remember("Milk is white.", "Milk")
    second = e.remember("Oats make MILK too.", "Oats")
    moved = e.forget("milk")
    assert len(moved) == 2 and {p.rsplit("/", 1)[1] for p in moved} == {p.rsplit("/", 1)[1] for p in (first, second)}
    assert all("/.trash/" in p for p in moved) and e.index().where("source LIKE '%/mem/%'").count() == 0
    assert e.forget("milk") == []
    from tessera.sources import sinks

    for k in (2, 3):  # names that are taken in the trash
        (tmp_path / "mem" / first.rsplit("/", 1)[1]).write_text("again")
        assert sinks.to_trash(spark, first).endswith(f"-{k}.md")


def test_supersession_is_kept_with_the_version(spark, engine, tmp_path):
    engine.ingest()
    rows = {(r.stem, r.superseded_by) for r in engine.supersession().select("stem", "superseded_by").collect()}
    kept = list((tmp_path / "index/supersession").iterdir())
    assert len(kept) == 1 and {(r.stem, r.superseded_by) for r in engine.supersession().select("stem", "superseded_by").collect()} == rows
    (tmp_path / "notes/_new.md").write_text("---\nsupersedes: plan\n---\n# New\nkey")
    engine.ingest()
    engine.supersession()
    assert [p.name for p in (tmp_path / "index/supersession").iterdir()] != [p.name for p in kept]
    assert engine.history("plan").splitlines()[-1].strip().startswith("3. _new")


def test_paths_of_other_stores(tmp_path, spark):
    (tmp_path / "c.toml").write_text('store = "hdfs://cluster/index"\nquery_log = "s3a://b/q"\n[[sources]]\npath = "hdfs://cluster/notes"\n')
    c = Config.load(str(tmp_path / "c.toml"))
    assert (c.store, c.query_log, c.sources) == ("hdfs://cluster/index", "s3a://b/q", [{"path": "hdfs://cluster/notes"}])
    from tessera.sources import logs, sinks

    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.logs.link./in", f"file://{tmp_path}")
    for n in range(3):  # a store whose files don't grow: one file a record, in order
        sinks.append_record(spark, "viewfs://logs/in/q.jsonl", {"query": f"q{n}", "hits": n})
    assert [r.query for r in logs.read(spark, "viewfs://logs/in/q.jsonl", "queries").orderBy("ord").collect()] == ["q0", "q1", "q2"]


def test_governance(spark, tmp_path):
    e = made(spark, tmp_path)
    n = tmp_path / "notes"
    (n / "old.md").write_text("---\n# a comment: no\nSuperseded_By: '[[new|x]]'\ntitle: The Rule\n---\ntext")
    (n / "new.markdown").write_text("---\nsupersedes: gone.md\nTITLE: the rule\n---\n\n# Heading\nother")
    (n / "lost.md").write_text("---\nreplaced_by: nowhere\n---\nno title")
    (n / ".hidden").mkdir()
    (n / ".hidden/x.md").write_text("---\nsupersedes: y\n---\n")
    got = {(r.category, r.file, r.detail) for r in e.governance(now=0).collect()}
    assert got == {("superseded_live", "old.md", "new"), ("superseded_live", "lost.md", "nowhere"), ("dangling", "new.markdown", "gone"), ("duplicate_truth", "new.markdown, old.md", "the rule")}
    late = e.governance(now=4e9).where("category = 'stale'")
    assert late.count() == 6 and late.first().n == 6


def test_upload_texts_doctor(spark, tmp_path):
    e = made(spark, tmp_path)
    e.ingest()
    path = e.upload("../new note.md", b"# New\nuploaded words")
    assert path == str(tmp_path / "notes/new note.md") and e.search("uploaded", 1).first().source == path
    assert e.upload("new note.md", b"# Other").endswith("new note-2.md")
    for name, raw in (("x.exe", b""), (".x.md", b""), ("big.md", b"x" * (16 * 1024 * 1024 + 1))):
        with pytest.raises(ValueError):
            e.upload(name, raw)
    assert [r.text for r in e.texts_of(path).collect()] == ["# New\nuploaded words"] or e.texts_of(path).count() == 1
    found = {c["check"]: c["ok"] for c in e.doctor()}
    assert found["source folder"] and not found["embedding hook"] and found["index"]
    assert e.sources().first().chunks == 5


def test_snapshots_are_collected(spark, tmp_path):
    e = made(spark, tmp_path)
    for i in range(4):
        (tmp_path / "notes/a.md").write_text(f"# A\nversion {i}")
        e.ingest()
        e.search("version")
    assert len(list((tmp_path / "index/chunks/manifests").glob("*.json"))) == 2 and len(list((tmp_path / "index/lexical/manifests").glob("*.json"))) == 1
    assert e.search("version 3", 1).first().text.endswith("version 3")


def test_digests(spark, tmp_path):
    root = tmp_path / "tool"
    root.mkdir()
    (root / "m.md").write_text("a memory")
    e = made(spark, tmp_path, ask=lambda p: "summary of " + p.split("\n")[-1] if "a memory" in p or "changed" in p else "?")
    e.config.harness = [{"name": "mine", "paths": [str(root), str(tmp_path / "no")]}]
    e._tools = lambda: __import__("tessera.sources.harness", fromlist=["x"]).configured(e.config.harness)
    e.ingest()
    assert e.harness().first().status == "missing" and e.harness().first().missing_roots == [str(tmp_path / "no")]
    assert e.digest() == {"mine": "written"} and e.digest() == {"mine": "unchanged"} and e.harness().first().status == "fresh"
    (root / "m.md").write_text("changed")
    assert e.harness().first().status == "stale" and e.digest() == {"mine": "written"}
    e._ask = lambda p: 1 / 0
    assert e.digest(force=True) == {"mine": "error"}


def test_drift_and_bench(spark, tmp_path):
    e = made(spark, tmp_path)
    e.ingest()
    for _ in range(4):
        e.search("apple")
    assert e.drift(pin=True).count() == 0
    for i in range(8):
        e.log_query(f"none {i}", 0, "", 1.0)
    assert [r.kind for r in e.drift().collect()][0] in ("zero_hit_spike", "fewer_hits")
    cases = spark.createDataFrame([(5, "apple", "b.md"), (9, "stone", "zzz")], "query_id long, query string, expect string")
    assert {(r.variant, r.found, r.cases) for r in e.bench(cases).collect()} == {(m, 1, 2) for m in ("hybrid", "vector", "lexical")}


def test_demo_scores_the_whole_corpus(spark, tmp_path):
    e = made(spark, tmp_path)
    e.ingest()
    every = {r.source: r.score for r in e.demo("word", 3).collect()}
    one = e.demo("word", 3, path_contains="c.md").collect()
    assert len(one) == 1 and one[0].score == every[one[0].source] and one[0].cite.endswith("c.md > C") and one[0].preview == "word stone"
