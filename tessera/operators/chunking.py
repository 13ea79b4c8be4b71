"""Heading-aware Markdown chunks, as column expressions.

Fences and headings are state that runs through a document's lines.  Only the few lines
that look like one or the other are folded, into events with line numbers; sections,
and stretches of code and prose, are then slices of the lines between events.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

# Blanks are Unicode blanks and the four separators that end lines or fields.
_BLANK = r"[\s\x1C-\x1F]"
_HEADING = rf"(?Us)^(#{{1,6}}){_BLANK}+(.*)\z"
_FENCE = r"(?s)^ {0,3}(`{3,}|~{3,})(.*)\z"
_MARKED = rf"(?U)^(?: {{0,3}}(?:```|~~~)|#{{1,6}}{_BLANK})"
#: The same blanks by themselves: those of prose, breaks that are no \n, and others.
_PROSE, _BREAKS, _OTHERS = "\t\n ", "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029", "\x1f\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_EVENTS = "CAST(array() AS array<struct<at:int,kind:string,level:int,title:string>>)"


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+\z", "")


def _events(lines: Column) -> Column:
    """array<struct<at, kind, level, title>>: where code fences open and close, and the headings
    outside of them.  A fence closes with at least as many of the marks it was opened with."""
    numbered = F.filter(F.transform(lines, lambda line, i: F.struct(i.alias("at"), line.alias("line"))), lambda x: x["line"].rlike(_MARKED))
    read = F.transform(
        numbered,
        lambda x: F.struct(
            x["at"].alias("at"),
            F.regexp_extract(x["line"], _FENCE, 1).alias("mark"),
            F.regexp_extract(x["line"], _FENCE, 2).alias("info"),
            F.length(F.regexp_extract(x["line"], _HEADING, 1)).alias("level"),
            _strip(F.regexp_extract(x["line"], _HEADING, 2)).alias("title"),
        ),
    )

    def step(acc: Column, x: Column) -> Column:
        inside, fence = acc["mark"] != "", x["mark"] != ""
        alike = (F.left(x["mark"], F.lit(1)) == F.left(acc["mark"], F.lit(1))) & (F.length(x["mark"]) >= F.length(acc["mark"]))
        closes = inside & fence & alike & (F.regexp_replace(x["info"], r"[ \t]", "") == "")
        opens = ~inside & fence & ~((F.left(x["mark"], F.lit(1)) == "`") & F.contains(x["info"], F.lit("`")))
        kind = F.when(closes, "close").when(opens, "open").when(~inside & ~fence & (x["level"] > 0), "head")
        event = F.struct(x["at"].alias("at"), kind.alias("kind"), x["level"].alias("level"), x["title"].alias("title"))
        return F.struct(
            F.when(closes, "").when(opens, x["mark"]).otherwise(acc["mark"]).alias("mark"),
            F.when(kind.isNotNull(), F.concat(acc["out"], F.array(event))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(read, F.struct(F.lit("").alias("mark"), F.expr(_EVENTS).alias("out")), step, lambda acc: acc["out"])


def _crumbs(heads: Column) -> Column:
    """array<struct<at, crumb>>: where each section begins, and its headings from the outermost on."""
    start = F.struct(F.expr("CAST(array() AS array<struct<n:int,t:string>>)").alias("path"), F.expr("array(struct(0 AS at, '' AS crumb))").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        above = F.filter(acc["path"], lambda p: p["n"] < h["level"])
        path = F.concat(above, F.array(F.struct(h["level"].alias("n"), h["title"].alias("t"))))
        crumb = F.concat_ws(" > ", F.transform(path, lambda p: p["t"]))
        return F.struct(path.alias("path"), F.concat(acc["out"], F.array(F.struct(h["at"].alias("at"), crumb.alias("crumb")))).alias("out"))

    return F.aggregate(heads, start, step, lambda acc: acc["out"])


def _between(lines: Column, at: Column, after: Column) -> Column:
    """The lines from one number to before another, as text."""
    return F.array_join(F.slice(lines, at + 1, F.greatest(after - at, F.lit(0))), "\n")


def _following(starts: Column, k: Column, lines: Column) -> Column:
    return F.coalesce(F.get(starts, k + 1)["at"], F.size(lines))


def sections(text: Column) -> Column:
    """array<struct<crumb, text>>: each heading outside code begins one; blank ones are left out."""

    def cut(lines: Column) -> Column:
        begin = lambda starts: F.transform(starts, lambda s, k: F.struct(s["crumb"].alias("crumb"), _between(lines, s["at"], _following(starts, k, lines)).alias("text")))
        return _once(_crumbs(F.filter(_events(lines), lambda e: e["kind"] == "head")), begin)

    return F.filter(_once(T.lines(text), cut), lambda b: _strip(b["text"]) != "")


def code_and_prose(block: Column) -> Column:
    """array<struct<text, code>>: stretches of a block; an open fence runs to the end, blank prose is left out."""

    def cut(lines: Column) -> Column:
        fences = F.filter(_events(lines), lambda e: e["kind"] != "head")
        starts = F.concat(F.expr("array(struct(0 AS at, false AS code))"), F.transform(fences, lambda e: F.struct((e["at"] + F.when(e["kind"] == "close", 1).otherwise(0)).alias("at"), (e["kind"] == "open").alias("code"))))
        parts = lambda ss: F.transform(ss, lambda s, k: F.struct(_between(lines, s["at"], _following(ss, k, lines)).alias("text"), (s["code"] & (_following(ss, k, lines) > s["at"])).alias("code")))
        return _once(starts, parts)

    return F.filter(_once(T.lines(block), cut), lambda p: p["code"] | (_strip(p["text"]) != ""))


def _windows(text: Column, size: Column, overlap: Column) -> Column:
    step = F.greatest(size - overlap, F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.length(text) - 1, step), lambda i: F.substring(text, i + 1, size))


def trimmed(text: Column) -> Column:
    """Without blanks, tabs and breaks of ASCII at both ends."""
    return F.btrim(text, F.lit(" \n\t\r"))


def split_plain(text: Column, size: Column, overlap: Column) -> Column:
    """Overlapping windows of a trimmed text, whatever marks it holds; a short last one joins its neighbour."""
    return _once(trimmed(text), lambda t: F.when(F.length(t) <= size, F.array(t)).otherwise(_once(_windows(t, size, overlap), lambda ws: T.merged_tail(ws))))


def may_be_markdown(text: Column) -> Column:
    """Whether split_markdown may cut a text in another way than split_plain: it is blank, has lines like
    headings or fences, breaks other than \\n, more blanks at an end than ASCII's, or a whole window of them."""
    any_of = lambda parts: reduce(or_, [F.contains(text, F.lit(x)) for x in parts])
    bare = trimmed(text)
    ends = (bare == "") | (bare != F.btrim(bare, F.lit(_PROSE + _BREAKS + _OTHERS)))
    lines = any_of(["#", "```", "~~~"]) & text.rlike(_MARKED.replace("(?U)", "(?mU)"))
    ascii = F.octet_length(text) == F.length(text)
    breaks = any_of([x for x in _BREAKS if x < "\x80"]) | (~ascii & any_of([x for x in _BREAKS if x > "\x80"]))
    # blanks of prose in a row, however mixed, have a pair of these
    run = (F.length(bare) > T.CHUNK_SIZE) & (~ascii | any_of(["  ", "\t\t", "\n\n", " \t", " \n", "\t\n", "\x1f"])) & text.rlike(rf"(?U){_BLANK}{{{T.CHUNK_SIZE}}}")
    return ends | breaks | lines | run


def split_markdown(text: Column, size: Column, overlap: Column) -> Column:
    """array<struct<text, section>> of each chunk: a section if it fits, else its code whole and
    its prose in overlapping windows, of which a short last one joins its neighbour."""

    def pieces(part: Column) -> Column:
        whole = lambda t: F.when(part["code"] | (F.length(t) <= size), F.array(t)).otherwise(_once(_windows(t, size, overlap), lambda ws: T.merged_tail(ws)))
        return _once(_strip(part["text"]), whole)

    def cut(section: Column) -> Column:
        texts = lambda b: F.when(F.length(b) <= size, F.array(b)).otherwise(F.flatten(F.transform(code_and_prose(b), pieces)))
        return F.transform(_once(_strip(section["text"]), texts), lambda t: F.struct(t.alias("text"), section["crumb"].alias("section")))

    return F.filter(F.flatten(F.transform(sections(text), cut)), lambda c: _strip(c["text"]) != "")


def split(text: Column, size: Column, overlap: Column, plain: Column) -> Column:
    """split_markdown, or where plain holds split_plain, with an empty section.  A null text has no chunks."""
    bare = F.transform(split_plain(text, size, overlap), lambda t: F.struct(t.alias("text"), F.lit("").alias("section")))
    return F.when(plain & text.isNotNull(), bare).otherwise(split_markdown(F.coalesce(text, F.lit("")), size, overlap))


def chunks(docs: DataFrame, size: int = T.CHUNK_SIZE, overlap: int = T.CHUNK_OVERLAP) -> DataFrame:
    """One row for each chunk of docs (path, content, and perhaps chunk_size and chunk_overlap
    of their own, and plain: the text is no Markdown): the other columns, chunk, text, section, id.

    A null text has no chunks.  Sizes below 1 are 1, an overlap is at most half a size.
    """
    own = {c: c in docs.columns for c in ("chunk_size", "chunk_overlap")}
    plain = ["plain"] if dict(docs.dtypes).get("plain") == "boolean" else []
    keep = [c for c in docs.columns if c not in ("content", "chunk_size", "chunk_overlap", *plain)]
    given = lambda c, d: F.coalesce(F.col(c).cast("int") if own[c] else F.lit(None), F.lit(d))
    n = F.greatest(given("chunk_size", T.clamped(size, 0)[0]), F.lit(1))
    laps = F.greatest(F.least(given("chunk_overlap", int(overlap)), F.floor(F.col("_size") / 2).cast("int")), F.lit(0))
    sized = docs.withColumn("_size", n).withColumn("_overlap", laps).select(*keep, *plain, "content", "_size", "_overlap")
    cut = split(F.col("content"), F.col("_size"), F.col("_overlap"), F.col("plain")) if plain else split_markdown(F.coalesce("content", F.lit("")), F.col("_size"), F.col("_overlap"))
    found = sized.select(*keep, F.posexplode(cut).alias("chunk", "c"))
    return found.select(*keep, "chunk", "c.text", "c.section", F.concat_ws("::", "path", F.col("chunk").cast("string")).alias("id"))


def prose_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = T.CHUNK_SIZE, overlap: int = T.CHUNK_OVERLAP) -> DataFrame:
    """(id, chunk, text) of texts that are no Markdown: split_plain, in Catalyst alone.  A null text has no chunks."""
    size, overlap = T.clamped(size, overlap)
    return docs.select(F.col(id_col).alias("id"), F.posexplode(split_plain(F.col(text_col), F.lit(size), F.lit(overlap))).alias("chunk", "text"))
