"""Column expressions on text: tokenizers, Markdown metadata, links, names and windows.

All of them are Catalyst expressions.  Lines break where Unicode breaks them, and
blanks are Unicode blanks, so Java patterns carry (?U).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a token, an identifier and a link are.
TOKEN = r"[a-z0-9]+|[一-鿿]"
LATIN_RUN = r"[a-z0-9]+"
CJK_RUN = r"[一-鿿]+"
HYPHENATED = r"[a-z0-9]+(?:-[a-z0-9]+)+"
IDENTIFIER = r"[a-z0-9]+(?:[-_.:/]+[a-z0-9]+)+|(?=[a-z0-9]*\d)[a-z0-9]*[a-z]\d[a-z0-9]*|\d+[a-z][a-z0-9]*"
IDENTIFIER_QUERY = r"[A-Za-z0-9]+(?:[-_.:/]{1,2}[A-Za-z0-9]+)+|[A-Za-z]*\d[A-Za-z0-9]*"
WIKILINK = r"(?<!!)\[\[([^\]|#]+)(?:[#|][^\]]*)?\]\]"
BREAKS = r"\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029"
LINE_BREAK = rf"(?:\r\n|[{BREAKS}])"
TOPIC_TERM = r"[a-z0-9]{2,}|[一-鿿]{2,4}"
CHUNK_SIZE, CHUNK_OVERLAP, SHORT_TAIL = 800, 100, 30


def every(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def strip(text: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def lines(text: Column) -> Column:
    """The lines of a text, without an empty one after a final break."""
    return F.split(F.regexp_replace(text, rf"(?:{LINE_BREAK})\z", ""), LINE_BREAK, -1)


# ---- tokenizers ---------------------------------------------------------------

_tokenizers: dict[str, Callable[[Column], Column]] = {}


def register_tokenizer(name: str):
    """Add a function from a text column to an array of tokens under a name."""

    def add(fn: Callable[[Column], Column]) -> Callable[[Column], Column]:
        _tokenizers[name] = fn
        return fn

    return add


def tokenizer(name: str = "default") -> Callable[[Column], Column]:
    if (name or "default") not in _tokenizers:
        raise ValueError(f"unknown tokenizer {name!r}; there are {', '.join(sorted(_tokenizers))}")
    return _tokenizers[name or "default"]


def _joined(low: Column) -> Column:
    return F.transform(every(low, HYPHENATED), lambda x: F.replace(x, F.lit("-"), F.lit("")))


@register_tokenizer("default")
def tokens(text: Column) -> Column:
    """Whole runs of Latin letters and digits; each CJK character by itself."""
    return every(F.lower(text), TOKEN)


@register_tokenizer("hyphen_join")
def tokens_hyphen_join(text: Column) -> Column:
    """The default tokens, then each hyphenated compound without its hyphens."""
    return F.concat(tokens(text), _joined(F.lower(text)))


@register_tokenizer("cjk_bigram")
def tokens_cjk_bigram(text: Column) -> Column:
    """Latin runs, joined compounds, and overlapping pairs of each CJK run."""
    low = F.lower(text)
    pairs = F.transform(
        every(low, CJK_RUN),
        lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))),
    )
    return F.concat(every(low, LATIN_RUN), _joined(low), F.flatten(pairs))


@register_tokenizer("identifier")
def tokens_identifier(text: Column) -> Column:
    """The default tokens, then each identifier that is not one of them."""
    base = tokens(text)
    return F.concat(base, F.array_except(every(F.lower(text), IDENTIFIER), base))


@register_tokenizer("jieba")
def tokens_jieba(text: Column) -> Column:
    """Words by the optional jieba package; the default tokens where it is missing."""
    try:
        import jieba  # noqa: F401
    except ImportError:
        return tokens(text)
    import pandas as pd

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        import jieba

        return s.fillna("").map(lambda t: [w for w in jieba.cut(t.lower()) if w.strip()])

    return cut(text)


def identifier_terms(query: Column) -> Column:
    """The identifiers that a query names: lower case, three characters or more, no plain numbers, once each."""
    found = F.transform(every(query, IDENTIFIER_QUERY), lambda x: F.regexp_replace(F.lower(x), r"^[-_.:/]+|[-_.:/]+$", ""))
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) >= 3) & ~x.rlike(r"^[0-9]+$")))


# ---- front matter, tags, links ------------------------------------------------


#: The block between two lines of ---, the first one at the very beginning; blanks are no line breaks here.
_BLOCK = rf"(?sU)\A---[\s&&[^{BREAKS}]]*{LINE_BREAK}(?:(.*?){LINE_BREAK})??[\s&&[^{BREAKS}]]*---[\s&&[^{BREAKS}]]*(?:{LINE_BREAK}|\z)"


def front_matter_lines(text: Column) -> Column:
    """The lines of the front matter; null if there is none.  Only the block is cut into lines."""
    return F.when(text.startswith("---") & text.rlike(_BLOCK), lines(F.regexp_extract(text, _BLOCK, 1)))


def body(text: Column) -> Column:
    """The text after its front matter, its lines joined by \\n."""
    there = text.startswith("---") & text.rlike(_BLOCK)
    return F.when(there, F.array_join(lines(F.regexp_replace(text, _BLOCK, "")), "\n")).otherwise(text)


def _unquoted(x: Column) -> Column:
    return F.regexp_replace(x, "^[\"']+|[\"']+$", "")


def front_matter(text: Column) -> Column:
    """Map from key to list of values: `k: v`, `k: [a, b]`, and `k:` with `- item` lines; the last of a key counts."""
    entry = "struct<k:string,v:array<string>>"
    start = F.expr(f"named_struct('m', CAST(array() AS array<{entry}>), 'open', CAST(NULL AS STRING))")

    def step(acc: Column, raw: Column) -> Column:
        line = strip(raw)
        key, value = strip(F.substring_index(line, ":", 1)), strip(F.regexp_replace(line, r"^[^:]*:", ""))
        item = line.startswith("- ") & acc["open"].isNotNull()
        pair = line.contains(":")
        listed = value.startswith("[") & value.endswith("]")
        inner = strip(F.regexp_replace(value, r"^\[|\]$", ""))
        none = F.expr("CAST(array() AS array<string>)")
        values = (
            F.when(value == "", none)
            .when(listed, F.when(inner == "", none).otherwise(F.transform(F.split(inner, ","), lambda x: _unquoted(strip(x)))))
            .otherwise(F.array(_unquoted(value)))
        )
        others = F.filter(acc["m"], lambda e: e["k"] != key)
        added = F.transform(acc["m"], lambda e: F.struct(e["k"].alias("k"), F.when(e["k"] == acc["open"], F.concat(e["v"], F.array(_unquoted(strip(F.substring(line, 3, 1 << 30)))))).otherwise(e["v"]).alias("v")))
        m = F.when(item, added).when(pair, F.concat(others, F.array(F.struct(key.alias("k"), values.alias("v"))))).otherwise(acc["m"])
        opened = F.when(item | ~pair, acc["open"]).when(value == "", key)
        return F.struct(m.alias("m"), opened.alias("open"))

    return F.aggregate(F.coalesce(front_matter_lines(text), F.expr("CAST(array() AS array<string>)")), start, step, lambda a: F.map_from_entries(a["m"]))


def tag_list(values: Column) -> Column:
    """A list of tags, or one comma-separated value, as a comma-joined string."""
    flat = F.when(F.size(values) == 1, F.split(values[0], ",")).otherwise(values)
    return F.coalesce(F.array_join(F.filter(F.transform(flat, strip), lambda x: x != ""), ","), F.lit(""))


def distinct_ignoring_case(xs: Column) -> Column:
    """The first of each spelling."""
    return F.aggregate(xs, F.expr("CAST(array() AS array<string>)"), lambda a, x: F.when(F.exists(a, lambda y: F.lower(y) == F.lower(x)), a).otherwise(F.concat(a, F.array(x))))


def wikilinks(text: Column) -> Column:
    """Targets of [[links]] (embeds are none), comma-joined."""
    found = F.filter(F.transform(every(text, WIKILINK, 1), strip), lambda x: x != "")
    return F.array_join(distinct_ignoring_case(found), ",")


# ---- hashes and names ---------------------------------------------------------


def file_hash(text: Column) -> Column:
    return F.sha1(text.cast("binary"))


def chunk_hash(text: Column) -> Column:
    return F.substring(file_hash(text), 1, 16)


def stem(value: Column, suffixes: str = "md") -> Column:
    """A reference ([[x|alias]], path/x.md#heading) or file name as a bare note name."""
    bare = F.regexp_replace(F.regexp_replace(strip(value), "^[\"']+|[\"']+$", ""), r"^[\[\]]+|[\[\]]+$", "")
    bare = F.substring_index(F.substring_index(bare, "|", 1), "#", 1)
    return F.regexp_replace(F.substring_index(F.replace(bare, F.lit("\\"), F.lit("/")), "/", -1), rf"(?i)\.(?:{suffixes})$", "")


def slug(value: Column, most: int = 48, lower: bool = True) -> Column:
    """Word characters (any script) joined by -, cut to `most` characters."""
    s = F.regexp_replace(F.regexp_replace(value, r"(?U)[^\w]+", "-"), "^-+|-+$", "")
    s = F.substring(s, 1, most)
    s = F.regexp_replace(F.lower(s) if lower else s, "^-+|-+$", "")
    return F.when(s == "", "note").otherwise(s)


def folded_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def file_title(text: Column, most: int = 80) -> Column:
    """Front-matter title, else the first `# ` heading, else front-matter name."""
    head = F.substring(text, 1, 4000)
    meta = front_matter(head)
    first = F.regexp_extract(body(head), r"(?m)^#\s+(.+?)\s*$", 1)
    return F.substring(F.coalesce(F.nullif(F.get(meta["title"], F.lit(0)), F.lit("")), F.nullif(first, F.lit("")), F.get(meta["name"], F.lit(0)), F.lit("")), 1, most)


# ---- windows ------------------------------------------------------------------


def windows(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Stretches of `size` characters, each starting size - overlap after the one before."""
    size, overlap = clamped(size, overlap)
    step = max(size - overlap, 1)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.expr("CAST(array() AS array<int>)"))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def merged_tail(pieces: Column, short: int = SHORT_TAIL) -> Column:
    """A last window of fewer than `short` characters is put behind the one before."""
    n = F.size(pieces)
    last = F.element_at(pieces, -1)
    joined = F.concat(F.slice(pieces, F.lit(1), n - 2), F.array(F.concat(F.element_at(pieces, -2), last)))
    return F.when((n > 1) & (F.length(last) < short), joined).otherwise(pieces)


def clamped(size: object, overlap: object) -> tuple[int, int]:
    """Usable chunk parameters: size 1 at least, overlap half of it at most; defaults where they are no numbers."""

    def number(x: object, default: int) -> int:
        try:
            return int(x)  # type: ignore[call-overload]
        except (TypeError, ValueError):
            return default

    size = max(1, number(size, CHUNK_SIZE))
    return size, max(0, min(number(overlap, CHUNK_OVERLAP), size // 2))
