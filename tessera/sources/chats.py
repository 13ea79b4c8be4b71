"""Org-mode notes and chat exports as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

# The deepest heading, the roles and the content type of a chat that are kept, its
# untitled name, and the mark of an outside link.
DEEPEST, ROLES, KIND, UNTITLED, OUTSIDE = 6, ("user", "assistant"), "text", "untitled conversation", r"(?:mailto:[^\]]*|[^\]]*://[^\]]*)"

_EXPORT = "array<struct<title:string,mapping:map<string,struct<message:struct<author:struct<role:string>,create_time:double,content:struct<content_type:string,parts:array<variant>>>>>>>"
_CHATS = "struct<chats:array<struct<name:string,chat_messages:array<struct<sender:string,created_at:string,text:string,content:variant>>>>>"
_DOC = "array<struct<title:string,content:string>>"


# ---- org-mode -----------------------------------------------------------------


def _linked(line: Column) -> Column:
    """[[target][shown]]: outside targets become Markdown links, others their shown text."""
    whole = line
    for pattern, made in (
        (rf"\[\[({OUTSIDE})\]\[([^\]]+)\]\]", "[$2]($1)"),
        (rf"\[\[({OUTSIDE})\](?:\[\])?\]", "[$1]($1)"),
        (r"\[\[[^\]]+\]\[([^\]]+)\]\]", "$1"),
        (r"\[\[([^\]]+)\](?:\[\])?\]", "$1"),
    ):
        line = F.regexp_replace(line, pattern, made)
    return F.when(F.contains(whole, F.lit("[[")), line).otherwise(whole)


def may_be_org(text: Column) -> Column:
    """Whether a text may hold org mark-up, or a break that is no \\n; without these org_to_markdown leaves its lines as they are."""
    return F.contains(text, F.lit("[[")) | text.rlike(r"(?m)^(?:\*+[ \t]|#\+|[ \t]*\+[ \t])") | text.rlike(r"[\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")


def org_to_markdown(text: Column) -> Column:
    """TITLE as the first heading, with the others one level below it; FILETAGS as front matter; links; bullets."""
    return F.transform(F.array(T.lines(text)), _of_lines)[0]  # the lines are made once


def _of_lines(rows: Column) -> Column:
    """The Markdown of an org file's lines.  What a line begins with or holds tells whether a pattern can match."""
    values = lambda key: F.transform(F.filter(rows, lambda x: x.startswith("#+") & x.rlike(rf"^#\+{key}:")), lambda x: T.strip(F.regexp_replace(x, rf"^#\+{key}:", "")))
    title = F.coalesce(F.try_element_at(values("TITLE"), F.lit(-1)), F.lit(""))
    below = F.when(F.exists(values("TITLE"), lambda x: x != ""), 1).otherwise(0)
    tags = F.filter(F.transform(values("FILETAGS"), lambda x: F.filter(F.split(x, ":"), lambda t: t != "")), lambda ts: F.size(ts) > 0)
    front = F.array_join(F.transform(tags, lambda ts: F.concat(F.lit("tags: ["), F.array_join(ts, ", "), F.lit("]\n"))), "")

    def line(x: Column) -> Column:
        stars = F.length(F.regexp_extract(x, r"^(\*+)\s", 1))
        heading = F.concat(F.repeat(F.lit("#"), F.least(stars + below, F.lit(DEEPEST))), F.lit(" "), T.strip(F.regexp_replace(x, r"^\*+\s+", "")))
        return F.when(x.startswith("*") & (stars > 0), heading).when(F.contains(x, F.lit("+")) & x.rlike(r"^\s*\+\s"), F.regexp_replace(x, r"^(\s*)\+\s+", "$1- ")).otherwise(x)

    kept = F.filter(rows, lambda x: ~(x.startswith("#+") & x.rlike(r"^#\+[A-Z_]+:")))
    out = F.array_join(F.transform(kept, lambda x: _linked(line(x))), "\n")
    out = F.when(title != "", F.concat(F.lit("# "), title, F.lit("\n\n"), out)).otherwise(out)
    return F.when(front != "", F.concat(F.lit("---\n"), front, F.lit("---\n\n"), out)).otherwise(out)


# ---- chat exports -------------------------------------------------------------


def _said(role: Column, text: Column) -> Column:
    return F.when(T.strip(text) != "", F.concat(F.lit("**"), role, F.lit("**: "), T.strip(text))).otherwise("")


def _shown(turns: Column) -> Column:
    """The turns (at, nth, text) in order, joined; null if there are none."""
    return F.when(F.size(turns) > 0, F.array_join(F.transform(F.array_sort(turns), lambda t: t["text"]), "\n\n"))


def _words(parts: Column) -> Column:
    """The strings among variants that are not blank."""
    texts = F.filter(parts, lambda p: p.isNotNull() & (F.schema_of_variant(p) == "STRING"))
    return F.filter(F.transform(texts, lambda p: p.cast("string")), lambda p: T.strip(p) != "")


def _of_mapping(chat: Column) -> Column:
    """Turns of a map of nodes: by time, then as they stand in the file."""

    def turn(node: Column, nth: Column) -> Column:
        m = node["value"]["message"]
        kind = F.coalesce(m["content"]["content_type"], F.lit(KIND))
        words = F.when((kind == KIND) & m["author"]["role"].isin(*ROLES), _words(m["content"]["parts"]))
        text = F.when(F.size(words) > 0, _said(m["author"]["role"], F.array_join(words, "\n")))
        return F.struct(F.coalesce(m["create_time"], F.lit(0.0)).alias("at"), nth.alias("nth"), text.alias("text"))

    return _shown(F.filter(F.transform(F.map_entries(chat["mapping"]), turn), lambda t: t["text"].isNotNull()))


def _of_list(chat: Column) -> Column:
    """Turns of a list of messages: by their time as text, then as they stand; a message is its
    text, or else the text items of its content, one a line."""

    def turn(m: Column, nth: Column) -> Column:
        items = F.filter(F.try_variant_get(m["content"], "$", "array<struct<type:string,text:string>>"), lambda c: c["type"] == KIND)
        text = F.coalesce(F.nullif(m["text"], F.lit("")), F.nullif(F.array_join(F.transform(items, lambda c: F.coalesce(c["text"], F.lit(""))), "\n"), F.lit("")))
        sender = F.coalesce(m["sender"], F.lit(""))
        role = F.when(sender == "human", ROLES[0]).otherwise(sender)
        return F.struct(F.coalesce(m["created_at"], F.lit("")).alias("at"), nth.alias("nth"), F.when(text.isNotNull(), _said(role, text)).alias("text"))

    return _shown(F.filter(F.transform(chat["chat_messages"], turn), lambda t: t["text"].isNotNull()))


def _numbered(chats: Column) -> Column:
    """chats (title, body) with every title once, whatever its case: the n-th of one name gets
    " (n)", or the next number that no other title has."""
    low = F.array_sort(F.transform(chats, lambda c, i: F.struct(F.lower(c["title"]).alias("low"), i.alias("i"))))
    names = F.transform(low, lambda x: x["low"])
    nth = F.transform(F.array_sort(F.transform(low, lambda x, k: F.struct(x["i"].alias("i"), (k.cast("long") - F.array_position(names, x["low"]) + 2).alias("n")))), lambda x: x["n"])

    def step(acc: Column, at: Column) -> Column:
        c, n = at["c"], at["n"]
        named = lambda k: F.concat(c["title"], F.lit(" ("), k.cast("string"), F.lit(")"))
        free = lambda t: ~F.array_contains(acc["used"], F.lower(t))
        next_ = F.filter(F.sequence(F.lit(2).cast("long"), F.size(acc["used"]).cast("long") + 2), lambda k: free(named(k)))[0]
        title = F.when((n == 1) & free(c["title"]), c["title"]).when((n > 1) & free(named(n)), named(n)).otherwise(named(next_))
        content = F.concat(F.lit("# "), title, F.lit("\n\n"), c["body"])
        return F.struct(F.concat(acc["used"], F.array(F.lower(title))).alias("used"), F.concat(acc["out"], F.array(F.struct(title.alias("title"), content.alias("content")))).alias("out"))

    start = F.expr(f"named_struct('used', CAST(array() AS array<string>), 'out', CAST(array() AS {_DOC}))")
    return F.aggregate(F.arrays_zip(chats.alias("c"), nth.alias("n")), start, step, lambda a: a["out"])


def conversations(raw: Column) -> Column:
    """array<struct<title, content>>: Markdown of each conversation of a chat export that says
    anything; null for another file."""
    first = F.from_json(raw, _EXPORT)
    other = F.from_json(raw, _CHATS)["chats"]
    untitled = lambda name: F.coalesce(F.nullif(name, F.lit("")), F.lit(UNTITLED))
    mapped = F.transform(first, lambda c: F.struct(untitled(c["title"]).alias("title"), _of_mapping(c).alias("body")))
    listed = F.transform(other, lambda c: F.struct(untitled(c["name"]).alias("title"), _of_list(c).alias("body")))
    found = F.when(F.get(first, F.lit(0))["mapping"].isNotNull(), mapped).when(other.isNotNull(), listed)
    return _numbered(F.filter(found, lambda c: c["body"].isNotNull()))
