"""Memory files of agent tools: which tools there are, which files are theirs, and their state."""

from __future__ import annotations

import glob
import os
import re
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import incremental, topics
from tessera.sources import sinks

# What a preset takes of a root folder; zcode falls back to everything.
PRESETS = {"zcode": "projects/*/memory/*", "codex": "*", "generic": "**/*"}
FALLBACK = frozenset(["zcode"])

# Tools that are known, as (name, kind, display, icon, what shows that it is there, its memory).
KNOWN = (
    ("zcode", "zcode", "ZCode", "⚡", ["~/.zcode"], ["~/.zcode/cli/memories"]),
    ("codex", "codex", "Codex", "🐙", ["~/.codex"], ["~/.codex/memories"]),
    ("dsh", "generic", "DeepSeek Harness", "🐳", ["$DSH_HOME", "/Applications/DeepSeek Harness.app", "~/Applications/DeepSeek Harness.app"], ["$DSH_HOME"]),
    ("claude", "codex", "Claude Code", "🧠", ["~/.claude"], ["~/.claude/memories", "~/.claude/CLAUDE.md"]),
)


@dataclass
class Harness:
    name: str
    kind: str = "generic"
    roots: list[str] = field(default_factory=list)
    icon: str = "🗂️"
    display: str = ""


def _full(path: str) -> str | None:
    """~ and variables replaced; None where a variable is unset."""
    out = os.path.expanduser(os.path.expandvars(path)).strip()
    return out if out and not out.startswith("$") else None


def discovered() -> list[Harness]:
    """The known tools that this machine has."""
    full = lambda paths: [p for x in paths if (p := _full(x))]
    return [Harness(name, kind, full(memory), icon, display) for name, kind, display, icon, probes, memory in KNOWN if any(map(os.path.exists, full(probes)))]


def configured(entries: list[dict], known: list[Harness] = ()) -> list[Harness]:
    """Tools found on the machine, overridden or joined by configured ones of the same name."""
    out = {h.name: h for h in known}
    for e in entries:
        name = str(e.get("name", "")).strip()
        if not name:
            continue
        raw = e.get("paths") or e.get("path") or []
        roots = [os.path.expanduser(os.path.expandvars(p.strip())) for p in ([raw] if isinstance(raw, str) else raw) if isinstance(p, str) and p.strip()]
        old = out.get(name, Harness(name))
        out[name] = Harness(name, str(e.get("type") or "generic").strip().lower(), roots, str(e.get("icon") or old.icon), str(e.get("display") or old.display))
    return list(out.values())


def _notes(root: Path, pattern: str) -> set[Path]:
    found = (p for p in root.glob(pattern) if p.is_file() and p.suffix.lower() == ".md" and not p.name.startswith(("._", "~$")))
    return {p for p in found if not any(x.startswith(".") for x in p.relative_to(root).parts[:-1])}


def memory_files(h: Harness) -> list[Path]:
    """A root is a folder (by preset), one file, or a glob; the fallback is for each root by itself."""
    out: set[Path] = set()
    for spec in h.roots:
        root = Path(spec)
        if re.search(r"[*?\[]", spec):
            out |= {Path(p) for p in glob.glob(spec, recursive=True) if p.lower().endswith(".md") and os.path.isfile(p)}
        elif root.is_file():
            out |= {root} if root.suffix.lower() == ".md" else set()
        elif root.is_dir():
            out |= _notes(root, PRESETS.get(h.kind, PRESETS["generic"])) or (_notes(root, "**/*") if h.kind in FALLBACK else set())
    return sorted(out)


def prefix(root: str) -> str:
    """The part of a root before its first wildcard folder."""
    cut = re.split(r"[*?\[]", root, maxsplit=1)
    return root if len(cut) == 1 else os.path.dirname(cut[0])


def files(spark: SparkSession, harnesses: list[Harness]) -> DataFrame:
    """(owner, path, name, content, text, mtime, size) of all tools' files; Spark reads them."""
    owned = [(h.name, str(p.resolve())) for h in harnesses for p in memory_files(h)]
    schema = "owner string, path string"
    if not owned:
        return spark.createDataFrame([], schema + ", name string, content binary, text string, mtime double, size long")
    read = spark.read.format("binaryFile").load(sorted({p for _, p in owned}))
    from tessera.sources.files import plain_path

    read = read.select(plain_path(F.col("path")).alias("path"), "content", F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size"))
    both = spark.createDataFrame(owned, schema).join(read, "path")
    return both.select("owner", "path", F.substring_index("path", "/", -1).alias("name"), "content", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), "mtime", "size")


def stored(spark: SparkSession, folder: Path) -> DataFrame:
    """(owner, fingerprint) of the digests in a folder."""
    found = []
    for p in sorted(Path(folder).expanduser().glob("*.md")):
        head = p.read_text(encoding="utf-8", errors="replace")[:4000]
        of = {k: m[1].strip() for k in ("harness", "fingerprint") if (m := re.search(rf"(?m)^{k}:(.*)$", head))}
        if len(of) == 2:
            found.append((of["harness"], of["fingerprint"]))
    return spark.createDataFrame(found, "owner string, fingerprint string")


def write_digest(folder: Path, h: Harness, body: str, fingerprint: str, n: int, now: datetime | None = None) -> Path:
    """The summary note of a tool, which says what it was made of."""
    name, now = h.display or h.name, now or datetime.now()
    head = f'---\ntags: [memory, harness, summary]\ntitle: {name} memory digest\nupdated: {now:%Y-%m-%d %H:%M}\nharness: {h.name}\ntype: {h.kind}\nicon: "{h.icon}"\nfingerprint: {fingerprint}\nfiles: {n}\n---\n'
    path = Path(folder).expanduser() / f"{sinks.slug(h.name)}.md"
    sinks.atomic_write(path, f"{head}# {name} · memory digest\n\n{body.strip()}\n")
    return path


def stats(spark: SparkSession, harnesses: list[Harness], index: DataFrame, stored: DataFrame) -> DataFrame:
    """(owner, files, chars, last_updated, chunks, status, missing_roots): one row for each tool; stored: (owner, fingerprint)."""
    own = files(spark, harnesses)
    names = spark.createDataFrame([(h.name, [r for r in h.roots if not glob.glob(r)]) for h in harnesses], "owner string, missing_roots array<string>")
    return summed(names, own, [(h.name, prefix(r)) for h in harnesses for r in h.roots], incremental.per_source(index), stored)


def summed(names: DataFrame, own: DataFrame, roots: list[tuple[str, str]], counts: DataFrame, stored: DataFrame) -> DataFrame:
    """names (owner, missing_roots) with what files own (owner, path, name, content, mtime, size), and
    chunks counted by source, say of them; roots: (owner, prefix)."""
    spark = names.sparkSession
    sums = own.groupBy("owner").agg(F.count("*").alias("files"), F.sum("size").alias("chars"), F.max("mtime").alias("last_updated"))
    known = spark.createDataFrame(roots, "owner string, prefix string").distinct()
    hit = incremental.matched(counts, known.select("prefix").distinct()).join(known, "prefix").select("owner", "source", "chunks").distinct()
    chunks = hit.groupBy("owner").agg(F.sum("chunks").alias("chunks"))
    fresh = topics.freshness(topics.fingerprints(own), stored)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = names.join(sums, "owner", "left").join(chunks, "owner", "left").join(fresh, "owner", "left")
    return out.select("owner", zero("files"), zero("chars"), "last_updated", zero("chunks"), F.coalesce("status", F.lit("missing")).alias("status"), "missing_roots")
