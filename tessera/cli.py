"""Command line: python -m tessera.cli --config FILE VERB …"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from tessera.engine import Config, Engine


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--config", default="config.toml")
    verbs = p.add_subparsers(dest="verb", required=True)
    for name in ("search", "demo"):
        v = verbs.add_parser(name)
        v.add_argument("query")
        v.add_argument("-k", type=int)
        v.add_argument("--tag")
        v.add_argument("--in", dest="path_contains")
    verbs.choices["search"].add_argument("--since", help="YYYY-MM-DD or YYYY-MM")
    verbs.choices["search"].add_argument("--exact")
    verbs.choices["search"].add_argument("--mode", choices=("hybrid", "vector", "lexical"))
    verbs.choices["search"].add_argument("--rerank", choices=("model", "pairs"))
    verbs.add_parser("ingest").add_argument("--force", action="store_true")
    verbs.add_parser("digest").add_argument("--force", action="store_true")
    a = verbs.add_parser("ask")
    a.add_argument("question")
    a.add_argument("--verify", action="store_true")
    b = verbs.add_parser("bench")
    b.add_argument("cases", help="JSON lines with query and expect")
    b.add_argument("-k", type=int)
    u = verbs.add_parser("upload")
    u.add_argument("file")
    g = verbs.add_parser("graph")
    g.add_argument("entity", nargs="?")
    d = verbs.add_parser("drift")
    d.add_argument("--pin", action="store_true")
    for name, arg in (("links", "name"), ("texts", "source"), ("history", "note"), ("wiki", "topic"), ("forget", "query"), ("feedback", "verdict"), ("export", "path"), ("import", "path")):
        verbs.add_parser(name).add_argument(arg)
    r = verbs.add_parser("remember")
    r.add_argument("text")
    r.add_argument("--title")
    r.add_argument("--tag", action="append", dest="tags")
    s = verbs.add_parser("state")
    s.add_argument("action", choices=("save", "get", "list", "del"))
    s.add_argument("args", nargs="*")
    for name in ("stats", "suggest", "quality", "watch", "chat", "rebuild", "doctor", "governance", "memory-health", "memories", "memory-files", "sources", "queries", "audit", "harness", "hubs"):
        verbs.add_parser(name)
    return p


def since(spark: SparkSession, value: str | None) -> float | None:
    if not value:
        return None
    from pyspark.sql import functions as F

    from tessera.operators.retrieve import parse_since

    at = spark.range(1).select(parse_since(F.lit(value))).first()[0]
    if at is None:
        raise SystemExit(f"not a date: {value}")
    return at


def chat(engine: Engine) -> None:
    """Questions from standard input; /clear forgets the conversation, /exit ends it."""
    for line in sys.stdin:
        said = line.strip()
        if said in ("/exit", "/quit"):
            return
        if said == "/clear":
            engine.clear()
        elif said:
            print(engine.chat(said))


def cases(spark: SparkSession, path: str):  # noqa: ANN201
    from pyspark.sql import functions as F

    return spark.read.schema("query string, expect string").json(path).withColumn("query_id", F.monotonically_increasing_id())


def state(engine: Engine, action: str, args: list[str]) -> object:
    if action == "save":
        return engine.state.save(args[0], args[1], json.loads(args[2]))
    if action == "list":
        return engine.state.listed(*args[:1])
    return {"get": engine.state.get, "del": engine.state.delete}[action](*args[:2])


def run(engine: Engine, a: argparse.Namespace) -> object:
    if a.verb == "search":
        return engine.search(a.query, a.k, mode=a.mode, tag=a.tag, path_contains=a.path_contains, since=since(engine.spark, a.since), exact=a.exact, rerank=a.rerank)
    if a.verb == "ask":
        return engine.ask(a.question, verify=a.verify)
    if a.verb == "chat":
        return chat(engine)
    if a.verb == "bench":
        return engine.bench(cases(engine.spark, a.cases), a.k)
    if a.verb == "upload":
        return engine.upload(a.file, Path(a.file).read_bytes())
    if a.verb in ("digest", "graph", "drift"):
        return getattr(engine, a.verb)(getattr(a, {"digest": "force", "graph": "entity", "drift": "pin"}[a.verb]))
    if a.verb == "import":
        return engine.import_index(a.path)
    if a.verb == "texts":
        return engine.texts_of(a.source)
    if a.verb == "demo":
        return engine.demo(a.query, a.k, a.tag, a.path_contains)
    if a.verb == "ingest":
        return engine.ingest(a.force)
    if a.verb == "remember":
        return engine.remember(a.text, a.title, a.tags)
    if a.verb == "state":
        return state(engine, a.action, a.args)
    if a.verb == "watch":
        return engine.watch().awaitTermination()
    one = {"links": "name", "history": "note", "wiki": "topic", "forget": "query", "feedback": "verdict", "export": "path"}.get(a.verb)
    return getattr(engine, a.verb.replace("-", "_"))(*([getattr(a, one)] if one else []))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    out = run(Engine(spark, Config.load(a.config)), a)
    if hasattr(out, "toJSON"):
        for line in out.toJSON().toLocalIterator():
            print(line)
    elif out is not None:
        print(out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
