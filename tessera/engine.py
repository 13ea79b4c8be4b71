"""The engine as an API: configuration, and the verbs that a front end calls."""

from __future__ import annotations

import json
import os
import time
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import access, answers, chunking, evaluation, governance, incremental, knowledge, links, logs, models, postings, retrieve, supersession, topics
from tessera.scratch import durable, release
from tessera.sources import files, harness, notes_source, segments, sinks
from tessera.sources import logs as log_files

INDEX = "source string, hash string, tags string, links string, mtime double, chunk int, text string, section string, id string, chash string, vec array<double>"


@dataclass
class Config:
    """Defaults are part of the semantics."""

    sources: list[dict] = field(default_factory=list)
    store: str = "./index"
    memories: str = "./memories"
    wiki: str = "./wiki"
    state: str = "./state"
    query_log: str = "./queries.jsonl"
    chunk_size: int = T.CHUNK_SIZE
    chunk_overlap: int = T.CHUNK_OVERLAP
    top_k: int = retrieve.TOP_K
    hybrid: bool = True
    rrf_k: int = retrieve.RRF_K
    tokenizer: str = "default"
    watch_interval: float = 30
    stale_days: int = governance.STALE_DAYS
    embed_model: str = "token-hash"
    harness: list[dict] = field(default_factory=list)
    auto_extract: bool = True

    def __post_init__(self) -> None:
        self.chunk_size, self.chunk_overlap = T.clamped(self.chunk_size, self.chunk_overlap)
        self.top_k = max(1, int(self.top_k))
        try:
            T.tokenizer(self.tokenizer)
        except ValueError:
            self.tokenizer = "default"

    @classmethod
    def load(cls, path: str) -> Config:
        """A TOML file of these names; TESSERA_<NAME> overrides, relative paths start at the file."""
        p = Path(path).expanduser()
        data = tomllib.loads(p.read_text(encoding="utf-8")) if p.exists() else {}
        given = {k: v for k, v in data.items() if k in cls.__dataclass_fields__}
        for k, f in cls.__dataclass_fields__.items():
            raw = os.environ.get(f"TESSERA_{k.upper()}")
            if raw is not None and k not in ("sources", "harness"):
                given[k] = type(f.default)(raw) if not isinstance(f.default, bool) else raw.lower() in ("1", "true", "yes")
        out, root = cls(**given), p.parent.resolve()
        at = lambda path: path if "://" in path else str(root / Path(path).expanduser())  # noqa: E731  another store's path stands as it is
        for k in ("store", "memories", "wiki", "state", "query_log"):
            setattr(out, k, at(getattr(out, k)))
        out.sources = [{**s, "path": at(s["path"])} for s in out.sources]
        return out


def _indexed(chunks: DataFrame) -> DataFrame:
    """(id, text) of chunks as the lexical index numbers them."""
    return chunks.select(F.xxhash64("id").alias("id"), "text")


class Engine:
    def __init__(
        self,
        spark: SparkSession,
        config: Config,
        embed: Callable[[Column], Column] | None = None,
        ask: Callable[[str], str] | None = None,
        ask_column: Callable[[Column], Column] | None = None,
        similarity: Callable[[Column, Column], Column] | None = None,
        role: str = "admin",
        label: str = "local",
    ) -> None:
        """Model hooks: embed maps a text column to vectors (default: none, token hashes at query
        time); ask answers a prompt; ask_column answers a column of prompts, null where it
        fails; similarity scores (query, passage).  role: what the caller may do; label: whose
        name the logs get."""
        self.spark, self.config, self.role, self.label = spark, config, role, label
        self._embed, self._ask, self._ask_column, self._similarity = embed, ask, ask_column, similarity
        self.table = segments.SegmentTable(spark, f"{config.store}/chunks")
        self.lexical = postings.DeltaIndex(spark, f"{config.store}/lexical", config.tokenizer)
        self.state = sinks.StateStore(config.state)
        self._history: list[tuple[str, str]] = []

    def _may(self, needed: str) -> None:
        if not access.allowed(self.role, needed):
            raise PermissionError(f"{self.role} may not do what needs {needed}")

    def _audit(self, action: str, detail: str = "") -> None:
        sinks.append_record(self.spark, f"{self.config.store}/audit.jsonl", {"ts": time.strftime("%Y-%m-%d %H:%M:%S"), "label": self.label, "role": self.role, "action": action, "detail": detail[: sinks.DETAIL_CAP]})

    def _replies(self, prompts: DataFrame) -> DataFrame:
        """(query_id, reply) of prompts (query_id, prompt), null where the hook fails.

        The driver's hook gets them one by one: a row for each query of a call.
        """
        if self._ask_column is not None:
            return prompts.select("query_id", self._ask_column(F.col("prompt")).alias("reply"))
        rows = []
        for r in prompts.collect() if self._ask is not None else ():
            try:
                rows.append((r.query_id, self._ask(r.prompt)))
            except Exception:  # a model that fails changes nothing
                rows.append((r.query_id, None))
        return self.spark.createDataFrame(rows, "query_id long, reply string")

    # ---- index ---------------------------------------------------------------

    def index(self) -> DataFrame:
        found = self.table.read()
        return found if found is not None else self.spark.createDataFrame([], INDEX)

    def folders(self) -> list[dict]:
        own = [{"path": p} for p in (self.config.memories, self.config.wiki) if files.is_folder(self.spark, p)]
        return [*self.config.sources, *own]

    def ingest(self, force: bool = False, rebuild: bool = False) -> dict[str, int]:
        """One incremental pass; counts by status.  Nothing is written if a source is missing, or
        if the index has another vector space; rebuild makes it anew."""
        self._may("editor")
        missing = [s["path"] for s in self.config.sources if not files.is_folder(self.spark, s["path"])]
        if missing:
            raise FileNotFoundError(f"the index is unchanged: no folder {', '.join(missing)}")
        return self._apply(files.scan(self.spark, self.folders()), force, prune=True, rebuild=rebuild)

    def rebuild(self) -> dict[str, int]:
        return self.ingest(force=True, rebuild=True)

    def add_file(self, path: str) -> dict[str, int]:
        self._may("editor")
        return self._apply(files.load_one(self.spark, path, self.config.chunk_size, self.config.chunk_overlap), True, prune=False)

    def upload(self, name: str, content: bytes, folder: str | None = None) -> str:
        """A new file in a source folder (the first without one), indexed at once; its path."""
        self._may("editor")
        if len(content) > sinks.UPLOAD_BYTES:
            raise ValueError(f"an upload has {sinks.UPLOAD_BYTES} bytes at most")
        root = folder or self.config.sources[0]["path"]
        if root not in [s["path"] for s in self.config.sources]:
            raise ValueError(f"no source folder: {root}")
        path = sinks.free_name(root, name)
        if not files.readable(path.name):
            raise ValueError(f"files of this kind are not read: {name!r}")
        sinks.atomic_write_bytes(path, content)
        self.add_file(str(path))
        self._audit("upload", path.name)
        return str(path)

    def _meta(self) -> DataFrame:
        text = sinks.read_small(self.spark, f"{self.config.store}/meta.json")
        known = [(m["embed_model"], m["embed_dim"])] if (m := json.loads(text or "null")) else []
        return self.spark.createDataFrame(known, "embed_model string, embed_dim int")

    def _space(self) -> tuple[str, int]:
        """The model and the length of its vectors; without a hook no vectors are stored."""
        if self._embed is None:
            return self.config.embed_model, 0
        one = self.spark.createDataFrame([("probe",)], "text string").select(F.size(self._embed(F.col("text"))).alias("n"))
        return self.config.embed_model, one.first().n

    def _apply(self, docs: DataFrame, force: bool, prune: bool, rebuild: bool = False) -> dict[str, int]:
        old, version = self.index(), self.table.current()
        model, dim = self._space()
        meta = self._meta()
        dims = None if not meta.isEmpty() else old.agg(F.max(F.size("vec")).alias("n")).first().n
        verdict = incremental.check_vector_space(meta, model, dim, 0 if old.isEmpty() else 1, dims if dims and dims > 0 else None, rebuild)
        if verdict == "rebuild":
            old, force, version = old.limit(0), True, None
        heads = old if prune or version is None else self.table.of_sources(docs.select(F.col("path").alias("source")))
        seen = incremental.classify(docs, heads.select(F.col("source").alias("path"), "hash").distinct(), force).persist()
        gone = incremental.vanished(old, seen).persist() if prune and version else self.spark.createDataFrame([], "source string")
        try:
            counts = {r.status: r.n for r in incremental.report(seen).collect()}
            counts["pruned"] = gone.count() if prune and version else 0
            if counts["pruned"] or set(counts) & {"added", "updated"} or version is None:
                self._commit(seen.where("status <> 'unchanged'").drop("status"), gone, version)
            if verdict != "ok":
                sinks.write_small(self.spark, f"{self.config.store}/meta.json", json.dumps({"embed_model": model, "embed_dim": dim}))
        finally:
            gone.unpersist()
            seen.unpersist()
        self._tidy()
        return counts

    def _commit(self, changed: DataFrame, gone: DataFrame, version: str | None) -> None:
        """One version more: changed documents cut anew, those that are gone taken out.  Only rows of
        these are read and written, and the lexical index gets what changed."""
        touched = changed.select(F.col("path").alias("source")).unionByName(gone.select("source"))
        at = self.table.buckets_of(touched) if version else set()
        cut = chunking.chunks(changed.withColumnRenamed("path", "source").withColumn("path", F.col("source")), self.config.chunk_size, self.config.chunk_overlap)
        fresh = cut.withColumn("chash", T.chunk_hash(F.col("text"))).drop("path")
        before = self.table.of_sources(touched, at) if version else self.spark.createDataFrame([], INDEX)
        fresh = incremental.reuse(fresh, before)
        if self._embed:
            fresh = fresh.withColumn("vec", F.coalesce("vec", self._embed(answers.embed_input(F.col("text")))))
        names = [f.split()[0] for f in INDEX.split(", ")]
        now = self.table.upsert(fresh.select(names), touched) if version else self.table.replace(fresh.select(names))
        if version and self.lexical.of() == version:
            self.lexical.apply(_indexed(before), _indexed(self.table.of_sources(touched, at)), now)

    def _tidy(self) -> None:
        """Versions but the last two go, with what only they use."""
        self.table.vacuum()
        self.lexical.vacuum()

    def forget_source(self, source: str) -> None:
        self._may("editor")
        self._take_out(self.spark.createDataFrame([(source,)], "source string"))

    def _take_out(self, sources: DataFrame) -> None:
        if version := self.table.current():
            self._commit(self.spark.createDataFrame([], "path string, content string, hash string, tags string, links string, mtime double"), sources, version)
            self._tidy()

    def texts_of(self, source: str) -> DataFrame:
        """(chunk, section, text) of a source in order."""
        return self.index().where(F.col("source") == source).select("chunk", "section", "text").orderBy("chunk")

    def sources(self) -> DataFrame:
        """(prefix, chunks) of the configured folders."""
        roots = self.spark.createDataFrame([(str(s["path"]).rstrip("/"),) for s in self.folders()], "prefix string")
        return incremental.under(incremental.per_source(self.index()), roots)

    def doctor(self) -> list[dict]:
        """What is there and what is not: sources, hooks, optional readers, the index."""
        checks = [{"check": "source folder", "ok": files.is_folder(self.spark, s["path"]), "detail": s["path"]} for s in self.config.sources]
        hooks = {"embedding": self._embed, "model": self._ask or self._ask_column, "reranker": self._similarity}
        checks += [{"check": f"{name} hook", "ok": hook is not None, "detail": "given" if hook else "missing"} for name, hook in hooks.items()]
        checks += [{"check": f"reads {kind}", "ok": there, "detail": ""} for kind, there in files.optional_readers().items()]
        try:
            return [*checks, {"check": "index", "ok": True, "detail": f"{self.stats()['chunks']} chunks"}]
        except Exception as e:
            return [*checks, {"check": "index", "ok": False, "detail": str(e)[:120]}]

    def stats(self) -> dict:
        return incremental.summary(self.index()).first().asDict()

    def export(self, path: str) -> None:
        """Rows and a trailer as JSON lines; embed_dim is the length of the stored vectors."""
        known = self._meta().first()
        sinks.export_jsonl(self.index(), path, known.embed_model if known else self.config.embed_model, known.embed_dim if known else 0)

    def import_index(self, path: str, force: bool = False) -> int:
        """Take in an exported file: its sources replace ones of the same name; how many rows it
        had.  Refused for another model or length of vectors, unless the index is empty or forced."""
        self._may("admin")
        rows, meta = log_files.import_rows(self.spark, path, self.config.embed_model, force)
        known, old = self._meta().first(), self.table.current()
        dim = rows.select(F.size("vec").alias("n")).limit(1).collect()
        if known and old and dim and known.embed_dim not in (0, dim[0].n) and not force:
            raise ValueError(f"the index has vectors of length {known.embed_dim}, the file of {dim[0].n}")
        rows = durable(rows.select([f.split()[0] for f in INDEX.split(", ")]), "import")
        self.table.upsert(rows)
        sinks.write_small(self.spark, f"{self.config.store}/meta.json", json.dumps({"embed_model": meta.get("embed_model") or self.config.embed_model, "embed_dim": dim[0].n if dim else 0}))
        self._tidy()
        self._audit("import", path)
        n = rows.count()
        release(rows)
        return n

    # ---- search --------------------------------------------------------------

    def _queries(self, query: str | list[str]) -> DataFrame:
        asked = [query] if isinstance(query, str) else query
        return self.spark.createDataFrame([(i, q[: answers.QUERY_CAP]) for i, q in enumerate(asked)], "query_id long, text string")

    def search(self, query: str | list[str], k: int | None = None, mode: str | None = None, rewrite: Callable[[str], list[str]] | None = None, rerank: str | None = None, kind: str = "search", **given) -> DataFrame:
        """Ranked hits for one query or many, logged as `kind`; stored vectors decide the dense
        channel where there is an embedding hook.  rewrite adds variants of a single query;
        rerank: "model" (ratings by the model hook) or "pairs" (by the similarity hook)."""
        began = time.time()
        k = self.config.top_k if k is None else k
        if isinstance(query, str) and not query.strip():
            raise ValueError("an empty query")
        numbered = self.index().withColumn("doc", F.xxhash64("id"))
        docs = numbered.select(F.col("doc").alias("id"), "source", "text", "tags", "mtime")
        chosen = mode or ("hybrid" if self.config.hybrid else "vector")
        asked = self._queries(query)
        common = {"tokenizer": self.config.tokenizer, "rrf_k": self.config.rrf_k}
        snapshot = self.table.current()
        if snapshot and chosen != "vector":
            if self.lexical.of() != snapshot:
                self.lexical.build(docs, snapshot)
            common["index"] = self.lexical
        if self._embed is not None:
            stored = numbered.select(F.col("doc").alias("id"), "vec")
            common["vectors"] = lambda q, n: retrieve.dense_top_k(stored, q.select("query_id", self._embed(answers.embed_input(F.col("text"))).alias("vec")), n).select("query_id", "id", "distance", "rank")
        with_scores = None
        if rerank == "model" and self._ask_column is not None:
            with_scores = lambda hits: models.relevance(hits, asked, self._ask_column)
        elif rerank == "pairs" and self._similarity is not None:
            with_scores = lambda hits: models.similarity(hits, asked, self._similarity)
        variants = [self._queries(v) for v in self._rewritten(query, rewrite)] if rewrite and isinstance(query, str) else None
        hits = retrieve.search(docs, asked, k, chosen, feedback=self._feedback(), rerank_with=with_scores, variants=variants, **common, **given)
        names = numbered.select(F.col("doc").alias("_doc"), F.col("id").alias("chunk_id"), "section", "chunk", "links")
        hits = hits.join(names, hits.id == names._doc).drop("_doc")
        return self._noted(query, hits, kind, began)

    def _rewritten(self, query: str, rewrite: Callable[[str], list[str]]) -> list[str]:
        """The variants of a query; none if the hook fails or gives no list."""
        try:
            found = rewrite(query)
        except Exception:
            return []
        return [v.strip() for v in found if isinstance(v, str) and v.strip()] if isinstance(found, list) else []

    def _noted(self, query: str | list[str], hits: DataFrame, kind: str, began: float) -> DataFrame:
        """The hits, computed once: k rows for each query.  Queries go to the query log, memories that were hit to the ledger."""
        schema, rows = hits.schema, hits.collect()
        asked, ms = [query] if isinstance(query, str) else query, (time.time() - began) * 1000
        for i, q in enumerate(asked):
            mine = sorted((r for r in rows if r.query_id == i), key=lambda r: r["rank"])
            top = (mine[0].source + (f" > {mine[0].section}" if mine[0].section else "")) if mine else ""
            self.log_query(q, len(mine), top, ms / len(asked), self.label, self.role, kind)
            for source in dict.fromkeys(r.source for r in mine if "memory" in [t.strip().lower() for t in (r.tags or "").split(",")]):
                sinks.append_record(self.spark, f"{self.config.store}/ledger.jsonl", {"ts": time.time(), "via": kind, "query": q[: sinks.LEDGER_CAP], "source": source})
        return self.spark.createDataFrame(rows, schema)

    def _feedback(self) -> DataFrame | None:
        path = f"{self.config.store}/feedback.jsonl"
        if not sinks.exists(self.spark, path):
            return None
        rated = log_files.read(self.spark, path, "feedback")
        return rated.select(F.xxhash64("chunk_id").alias("chunk_id"), "verdict")

    def supersession(self) -> DataFrame:
        """Which note supersedes which, made from the notes' front matter once for each version of
        the index and kept with it."""
        version = self.table.current()
        kept = sinks.SnapshotTable(self.spark, f"{self.config.store}/supersession/{version}") if version else None
        if kept is not None and kept.current():
            return kept.read()
        found = supersession.collect(self._successions())
        if kept is None:
            return found
        kept.replace(found)
        sinks.drop_folders(self.spark, f"{self.config.store}/supersession", lambda n: n != version)
        return kept.read()

    def _successions(self) -> DataFrame:
        rows = None
        for s in self.folders():
            one = files.raw_notes(self.spark, s["path"])
            rows = one if rows is None else rows.unionByName(one)
        if rows is None:
            return self.spark.createDataFrame([], "ord string, stem string, path string, supersedes string, superseded_by string, effective string")
        meta = T.front_matter(F.col("text"))
        first = lambda keys: F.coalesce(*[F.nullif(T.stem(F.get(meta[k], F.lit(0))), F.lit("")) for k in keys], F.lit(""))
        return rows.select(
            F.col("path").alias("ord"),
            F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "").alias("stem"),
            "path",
            first(supersession.FORWARD).alias("supersedes"),
            first(supersession.BACKWARD).alias("superseded_by"),
            F.coalesce(F.get(meta["effective"], F.lit(0)), F.lit("")).alias("effective"),
        )

    def ask(self, question: str, k: int | None = None, verify: bool = False, history: list[tuple[str, str]] = (), **given) -> str:
        """An answer from the model hook over the hits' context (the context itself without one),
        checked claim by claim with verify; the hits are kept for feedback."""
        hits = supersession.annotate(self.search(question[: answers.QUESTION_CAP], k, kind="ask", **given), self.supersession()).persist()
        shown = answers.context(hits).first()
        if shown is None:
            return "(no relevant content found)"
        ids = [r.chunk_id for r in hits.orderBy("rank").select("chunk_id").collect()]
        sinks.write_small(self.spark, f"{self.config.store}/last_ask.json", json.dumps({"query": question[:300], "ts": time.time(), "chunk_ids": ids}))
        reply = shown.context
        if self._ask is not None:
            said = "".join(f"{who}: {what}\n\n" for who, what in history)
            reply = self._ask(f"{said}Excerpts:\n\n{shown.context}\n\n---\n\nQuestion: {question}")
        if verify:
            reply += "\n\n" + self.verify(question, reply, hits)
        hits.unpersist()
        return reply

    def verify(self, question: str, answer: str, hits: DataFrame) -> str:
        """Every claim of an answer against the excerpts it rests on; says so where that can't be done."""
        if not answer.strip():
            return "(nothing to verify)"
        prompt = F.concat(F.lit(f"Check each claim of the answer against the excerpts. Reply with a JSON array of {{claim, status, excerpts, cross_file, reason}} only.\n\nQuestion: {question}\n\nAnswer:\n{answer}\n\nExcerpts:\n"), F.col("context"))
        try:
            replies = self._replies(answers.context(hits.withColumns({"superseded_by": F.lit(""), "effective": F.lit("")})).select("query_id", prompt.alias("prompt")))
            found = answers.verification(models.claims(replies), hits).first()
        except Exception as e:
            return f"(verification unavailable: {type(e).__name__})"
        return found.report if found else "(verification returned no claims: the answer is not audited)"

    def chat(self, question: str, k: int | None = None) -> str:
        """ask() with the last messages; facts that the model finds in the exchange are remembered."""
        reply = self.ask(question, k, history=self._history)
        if reply == "(no relevant content found)":
            return reply
        self._history = [*self._history, ("User", question), ("Assistant", reply)][-answers.HISTORY :]
        if self.config.auto_extract and (self._ask is not None or self._ask_column is not None):
            for title, text in self.extract(f"User: {question}\nAssistant: {reply}"):
                self.remember(text, title, ["auto"])
        return reply

    def clear(self) -> None:
        self._history = []

    def extract(self, transcript: str) -> list[tuple[str | None, str]]:
        """(title, text) of at most three facts in the end of a transcript; none if the hook fails."""
        prompt = "List lasting facts as a JSON array of {title, text}, nothing else.\n\n" + transcript[-models.TRANSCRIPT :]
        try:
            replies = self._replies(self.spark.createDataFrame([(0, prompt)], "query_id long, prompt string"))
            return [(r.title, r.text) for r in models.facts(replies).orderBy("pos").collect()]
        except Exception:
            return []

    def feedback(self, verdict: str) -> int:
        """Rate the last answer good or bad; how many chunks that rates."""
        self._may("editor")
        if verdict not in ("good", "bad"):
            raise ValueError("good or bad")
        last = json.loads(sinks.read_small(self.spark, f"{self.config.store}/last_ask.json") or '{"query": "", "chunk_ids": []}')
        for c in last["chunk_ids"]:
            sinks.append_record(self.spark, f"{self.config.store}/feedback.jsonl", {"chunk_id": c, "query": last["query"], "verdict": verdict, "ts": time.time()})
        self._audit("feedback", verdict)
        return len(last["chunk_ids"])

    def demo(self, query: str, k: int | None = None, tag: str | None = None, path_contains: str | None = None) -> DataFrame:
        """Lexical only, scored over the whole corpus, filters before the limit, with relative
        scores, a plain preview and a citation."""
        hits = retrieve.relative(self.search(query, k, mode="lexical", tag=tag, path_contains=path_contains, prefilter=True))
        return hits.withColumns({"preview": F.substring(answers.plain(F.col("text")), 1, answers.PREVIEW), "cite": answers.cite(F.col("source"), F.col("section"))})

    def bench(self, cases: DataFrame, k: int | None = None) -> DataFrame:
        """(variant, found, cases): hit@k of each mode on cases (query_id, query, expect)."""
        k = self.config.top_k if k is None else k
        asked = [r.query for r in cases.select("query_id", "query").orderBy("query_id").collect()]
        numbered = cases.withColumn("query_id", F.row_number().over(W.orderBy("query_id")).cast("long") - 1)
        modes = ("hybrid", "vector", "lexical")
        return evaluation.compared(numbered, {m: self.search(asked, k, mode=m, kind="bench").select("query_id", "rank", "source") for m in modes}, k)

    # ---- notes ---------------------------------------------------------------

    def remember(self, text: str, title: str | None = None, tags: list | None = None) -> str:
        self._may("editor")
        path = sinks.write_note(self.config.memories, text, title, tags)
        self.add_file(path)
        self._audit("remember", path)
        return path

    def memories(self) -> DataFrame:
        """(source, title, mtime) of the remembered notes, newest first."""
        notes = files.scan(self.spark, [{"path": self.config.memories}]) if files.is_folder(self.spark, self.config.memories) else files.scan(self.spark, [])
        return notes.select(F.col("path").alias("source"), F.regexp_extract("content", r"(?m)^# (.*)$", 1).alias("title"), "mtime").orderBy(F.desc("mtime"), "source")

    def memory_files(self) -> DataFrame:
        """(name, group, tool, size, mtime, title) of the notes in the memories folder and of the
        digests below it (group harness, tool: whose), by name; title: of the front matter, else the name."""
        if not files.is_folder(self.spark, self.config.memories):
            return self.spark.createDataFrame([], "name string, group string, tool string, size long, mtime string, title string")
        notes_source.register(self.spark)
        root = self.config.memories.rstrip("/").removeprefix("file://")
        read = self.spark.read.format("notes").load(self.config.memories).where("suffix = '.md'")
        name = F.substring("path", len(root) + 2, 1 << 20)
        own = read.withColumn("name", name).where(F.col("name").rlike(r"^(?:harness/)?[^/]+$") & ~F.col("name").rlike(r"(?:^|/)\._"))
        stem = F.regexp_replace(F.substring_index("name", "/", -1), r"\.[^.]*$", "")
        tool = F.col("name").startswith("harness/")
        title = F.get(T.front_matter(F.make_valid_utf8(F.col("content").cast("string")))["title"], F.lit(0))
        return own.select(
            "name",
            F.when(tool, "harness").otherwise("shared").alias("group"),
            F.when(tool, stem).otherwise("").alias("tool"),
            F.col("length").alias("size"),
            F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd HH:mm").alias("mtime"),
            F.coalesce(F.nullif(F.substring(title, 1, 80), F.lit("")), stem).alias("title"),
        ).orderBy("name")

    def forget(self, query: str) -> list[str]:
        self._may("editor")
        if not files.is_folder(self.spark, self.config.memories):
            return []
        notes = files.raw_notes(self.spark, self.config.memories)
        own = F.length(F.regexp_replace("path", r"/[^/]*$", "")) == F.length(F.lit(self.config.memories.rstrip("/").removeprefix("file://")))
        found = [r.path for r in sinks.notes_with(notes.where(own), query).collect()]  # names of notes that the caller asks to move
        moved = [sinks.to_trash(self.spark, path) for path in found]
        if found:
            self._take_out(self.spark.createDataFrame([(x,) for x in found], "source string"))
        self._audit("forget", query)
        return moved

    def wiki(self, topic: str, k: int = 12) -> str:
        """A page from the best hits and the entity relations of their sources."""
        self._may("editor")
        found = answers.outside(self.search(topic, k, kind="wiki"), str(Path(self.config.wiki).resolve()))
        hits = found.orderBy("rank").collect()
        if not hits:
            raise LookupError(f"nothing about {topic!r}")
        edges = self.edges()
        known = edges.join(found.select("source").distinct(), "source", "left_semi").orderBy("s", "p", "o").limit(k).collect() if edges is not None else []
        body = "\n\n".join(h.text for h in hits)
        if self._ask is not None:
            relations = "".join(f"- {e.s} {e.p} {e.o}\n" for e in known)
            body = self._ask(f"Topic: {topic}\n\n" + (f"Relations:\n{relations}\n" if relations else "") + "\n\n---\n\n".join(h.text for h in hits))
        path = sinks.write_page(self.config.wiki, topic, body, [(h.source, h.section) for h in hits])
        self.add_file(path)
        self._audit("wiki", topic)
        return path

    def suggest(self, least: int = topics.LEAST_CHUNKS, top: int = topics.TOP) -> DataFrame:
        pages = self.index().select(links.note_stem(F.col("source")).alias("slug")).distinct()
        return topics.suggested(self.index(), pages, least, top)

    # ---- analytics -----------------------------------------------------------

    def links(self, name: str) -> DataFrame:
        mapped = links.exploded(links.link_map(self.index()))
        notes = self.index().select("source").distinct()
        wanted = links.notes_matching(notes, mapped, name)
        out = mapped.join(wanted, "source").select(F.col("source").alias("note"), F.lit("out").alias("direction"), F.col("target").alias("other"))
        into = links.backlinks(mapped, wanted).select("note", F.lit("in").alias("direction"), F.col("source").alias("other"))
        return out.unionByName(into)

    def history(self, stem: str) -> str | None:
        t = self.supersession()
        row = supersession.describe(supersession.chains(t, t.where(F.col("stem") == stem).select("stem"))).first()
        return row.history if row else None

    def _graph(self) -> DataFrame | None:
        """Edges (s, p, o, source) and, with s null, what was read (source, hash): one table, so both change together."""
        return sinks.SnapshotTable(self.spark, f"{self.config.store}/graph").read()

    def edges(self) -> DataFrame | None:
        """The entity edges of the last graph()."""
        found = self._graph()
        return found.where("s IS NOT NULL").drop("hash") if found is not None else None

    def graph(self, entity: str | None = None, folders: list[str] | None = None) -> DataFrame:
        """Entity edges of the memories and wiki pages (or of other folders) by the model hook, kept
        from pass to pass: vanished and changed files lose theirs, changed and new ones are read
        again.  With entity, its neighbourhood."""
        if self._ask_column is not None:
            notes = self.spark.createDataFrame([], "path string, text string, mtime double")
            for f in folders or [self.config.memories, self.config.wiki]:
                if files.is_folder(self.spark, f):
                    notes = notes.unionByName(files.raw_notes(self.spark, f))
            notes = notes.select(F.col("path").alias("source"), F.col("text").alias("content"), T.file_hash(F.col("text")).alias("hash"))
            old = self._graph()
            old = old if old is not None else self.spark.createDataFrame([], "s string, p string, o string, source string, hash string")
            after, now = knowledge.rebuild(
                old.where("s IS NOT NULL").drop("hash"),
                old.where("s IS NULL").select("source", "hash"),
                notes.select("source", "hash"),
                lambda changed: knowledge.extract(knowledge.parts(notes.join(changed.select("source"), "source", "left_semi")), self._ask_column),
            )
            none = F.lit(None).cast("string")
            kept = sinks.SnapshotTable(self.spark, f"{self.config.store}/graph")
            kept.replace(after.withColumn("hash", none).unionByName(now.select(none.alias("s"), none.alias("p"), none.alias("o"), "source", "hash")))
            kept.drop_old()
        found = self.edges()
        found = found if found is not None else self.spark.createDataFrame([], "s string, p string, o string, source string")
        return knowledge.neighbours(found, entity) if entity else found

    def hubs(self) -> DataFrame:
        found = self.edges()
        return knowledge.hubs(knowledge.entities(found if found is not None else self.graph()))

    def _log(self, name: str, kind: str) -> DataFrame:
        path = self.config.query_log if name == "queries" else f"{self.config.store}/{name}.jsonl"
        return log_files.read(self.spark, path, kind) if sinks.exists(self.spark, path) else self.spark.createDataFrame([], f"{log_files.SCHEMAS[kind]}, ord long")

    def queries(self, n: int = 50) -> DataFrame:
        return logs.recent(self._log("queries", "queries"), n, "ts", "ord")

    def audit(self, n: int = 50) -> DataFrame:
        self._may("admin")
        return logs.recent(self._log("audit", "audit"), n, "ts", "ord")

    def memory_health(self, now: float | None = None) -> DataFrame:
        """Use, decay and flags of the remembered notes."""
        found = self.memories()
        read = self.spark.read.format("binaryFile").options(recursiveFileLookup=True, __globPaths__=False)
        sizes = read.load(self.config.memories).select(files.plain_path(F.col("path")).alias("source"), F.col("length").alias("bytes")) if files.is_folder(self.spark, self.config.memories) else self.spark.createDataFrame([], "source string, bytes long")
        notes = found.join(sizes, "source").select("source", F.substring_index("source", "/", -1).alias("file"), "bytes", "mtime")
        return logs.memory_health(notes, logs.citations(self._log("ledger", "citations")), logs.corrections(self._log("feedback", "feedback")), now if now is not None else time.time())

    def governance(self, now: float | None = None) -> DataFrame:
        """Findings over all notes: replaced but live, dangling, two truths, stale."""
        notes = None
        for s in self.folders():
            one = governance.notes_of(files.raw_notes(self.spark, s["path"]))
            notes = one if notes is None else notes.unionByName(one)
        if notes is None:
            notes = governance.notes_of(self.spark.createDataFrame([], "path string, text string, mtime double"))
        return governance.report(governance.scan(notes, logs.citations(self._log("ledger", "citations")), now if now is not None else time.time(), self.config.stale_days))

    # ---- memories of agent tools ----------------------------------------------

    def _tools(self) -> list[harness.Harness]:
        return harness.configured(self.config.harness, harness.discovered())

    def _digests(self) -> Path:
        return Path(self.config.memories) / "harness"

    def harness(self) -> DataFrame:
        """One row for each agent tool: files, size, chunks, digest state and missing roots."""
        return harness.stats(self.spark, self._tools(), self.index(), harness.stored(self.spark, self._digests()))

    def digest(self, force: bool = False) -> dict[str, str]:
        """A summary note for each tool by the model hook, written only where its files have changed; status by tool."""
        self._may("editor")
        tools = self._tools()
        own = harness.files(self.spark, tools)
        prints = {r.owner: r.fingerprint for r in topics.fingerprints(own).collect()}
        known = {} if force else {r.owner: r.fingerprint for r in harness.stored(self.spark, self._digests()).collect()}
        out = {h.name: "empty" if h.name not in prints else "unchanged" if known.get(h.name) == prints[h.name] else "due" for h in tools}
        due = topics.digest(own.where(F.col("owner").isin([n for n, s in out.items() if s == "due"])))
        texts = {r.owner: r.text for r in due.groupBy("owner").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "part"))), lambda x: x.part), "").alias("text")).collect()}
        for h in tools:
            if out[h.name] != "due":
                continue
            try:
                body = self._ask(f"Summarise the memory files of {h.display or h.name}.\n\n{texts[h.name]}")
            except Exception:
                out[h.name] = "error"
                continue
            n = own.where(F.col("owner") == h.name).count()
            path = harness.write_digest(self._digests(), h, body, prints[h.name], n)
            self.add_file(str(path))
            out[h.name] = "written"
        return out

    def quality(self, window: int = logs.QUALITY_WINDOW) -> DataFrame:
        return logs.quality_snapshot(self._log("queries", "queries"), self._log("feedback", "feedback"), window)

    def drift(self, pin: bool = False) -> DataFrame:
        """Alerts of the log's quality against the pinned snapshot; pin makes the present one it."""
        table = sinks.SnapshotTable(self.spark, f"{self.config.store}/baseline")
        now = self.quality()
        if pin:
            self._may("admin")
            table.replace(now)
        base = table.read()
        return logs.drift(now, base if base is not None else now.limit(0))

    def log_query(self, query: str, hits: int, top: str, ms: float, label: str = "local", role: str = "admin", kind: str = "search") -> None:
        sinks.append_record(self.spark, self.config.query_log, {"ts": time.strftime("%Y-%m-%d %H:%M:%S"), "label": label, "role": role, "kind": kind, "query": query[: sinks.QUERY_CAP], "hits": hits, "top": top, "ms": round(ms, 1)})

    def watch(self, checkpoint: str | None = None):
        from tessera.streaming.watch import watch

        return watch(self.spark, self.ingest, self.config.watch_interval, checkpoint)
