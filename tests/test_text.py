from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunking
from tests import plain_chunks


def one(spark, fn, value):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "text", "tokens"),
    [
        ("default", "Wi-Fi 全文 v2", ["wi", "fi", "全", "文", "v2"]),
        ("hyphen_join", "Wi-Fi", ["wi", "fi", "wifi"]),
        ("cjk_bigram", "全文检索 a-b 库", ["a", "b", "ab", "全文", "文检", "检索", "库"]),
        ("identifier", "user_id user-id sht45 x", ["user", "id", "user", "id", "sht45", "x", "user_id", "user-id"]),
        ("jieba", "a b", ["a", "b"]),
    ],
)
def test_tokenizers(spark, name, text, tokens):
    assert one(spark, T.tokenizer(name), text) == tokens


def test_tokenizer_registry():
    with pytest.raises(ValueError, match="unknown tokenizer"):
        T.tokenizer("none")
    T.register_tokenizer("letters")(lambda c: F.split(c, ""))
    assert T.tokenizer("letters")


@pytest.mark.parametrize(("query", "terms"), [("what is user_id?", ["user_id"]), ("SHT45 and v2 and 123", ["sht45"]), ("api/v2 api/v2 ns::f", ["api/v2", "ns::f"]), ("plain words", [])])
def test_identifier_terms(spark, query, terms):
    assert one(spark, T.identifier_terms, query) == terms


@pytest.mark.parametrize(
    ("text", "meta", "body"),
    [
        ("---\na: 1\nb: [x, 'y']\nc:\n- p\n- \"q\"\n---\nrest\nof it", {"a": ["1"], "b": ["x", "y"], "c": ["p", "q"]}, "rest\nof it"),
        ("---\na: 1\nno end", {}, "---\na: 1\nno end"),
        ("no front", {}, "no front"),
        ("---\na:\na: 2\n- lost\n---\n", {"a": ["2"]}, ""),
        ("----\na: 1\n---\nx", {}, "----\na: 1\n---\nx"),
        ("---\nurl: http://x\n---\nx", {"url": ["http://x"]}, "x"),
    ],
)
def test_front_matter(spark, text, meta, body):
    assert one(spark, T.front_matter, text) == meta
    assert one(spark, T.body, text) == body


def test_wikilinks(spark):
    assert one(spark, T.wikilinks, "[[A]] ![[img]] [[ b |x]] [[a#h]] [[]] [[c#d]]") == "A,b,c"
    assert one(spark, T.wikilinks, "none") == ""


@pytest.mark.parametrize(("value", "stem"), [("[[notes/A.md#h|x]]", "A"), ('"b.MD"', "b"), ("c\\d", "d"), ("", "")])
def test_stem(spark, value, stem):
    assert one(spark, T.stem, value) == stem


def test_windows_and_tail(spark):
    assert one(spark, lambda c: T.windows(c, 4, 1), "abcdefgh") == ["abcd", "defg", "gh"]
    assert one(spark, lambda c: T.merged_tail(T.windows(c, 40, 10)), "x" * 95) == ["x" * 40, "x" * 40, "x" * 35 + "x" * 5]
    assert one(spark, lambda c: T.windows(c, 4, 1), "") == []
    assert one(spark, lambda c: T.windows(c, 2, 0), "a😀b") == ["a😀", "b"]
    assert T.clamped("x", None) == (800, 100) and T.clamped(0, 50) == (1, 0) and T.clamped(10, 99) == (10, 5)


def test_sections():
    text = "intro\n# A\none\n### C\n```\n# not\n```\n## B\n~~~~\n~~~\n# still code\n~~~~\n# D\n#no"
    assert [c for c, _ in plain_chunks.sections(text)] == ["", "A", "A > C", "A > B", "D"]
    assert plain_chunks.sections(text)[4][1] == "# D\n#no"
    assert plain_chunks.sections("\n \n") == []


def test_split_markdown():
    code = "```\n" + "x = 1\n" * 30 + "```"
    got = plain_chunks.split_markdown(f"# A\n{'word ' * 30}\n{code}\nend", 100, 20)
    assert any(t == code for t, _ in got) and all(c == "A" for _, c in got) and got[-1][0] == "end"
    assert all(len(t) <= 130 for t, _ in got if not t.startswith("```"))
    assert plain_chunks.split_markdown("# A\n```\n" + "y\n" * 90, 50, 0)[-1][0].startswith("```")
    assert plain_chunks.split_markdown("", 10, 2) == [] and plain_chunks.split_markdown("ab", 10, 2) == [("ab", "")]


def test_chunks_equal_the_plain_version(spark):
    """Column expressions and a loop over lines cut alike: fences, headings, odd line breaks, all sizes."""
    r = random.Random(6)
    parts = ["# A", "## B c ", "### ", "#no", "#\tT", "```", "```py", "~~~", "~~~~ x", "````", "``` a`b", "   ```", "    ```", "\t```", "text and more words", "", "   ", "\x1f", "\xa0x", "- item", "#### deep # x", "####### seven", "a" * 70, "é ñ " * 30, "~~~ ~", "a😀"]
    breaks = ["\n"] * 12 + ["\r\n", "\r", "\x0b", "\u2028", "\x85", "\n\n", "\x1c"]
    texts = ["".join(r.choice(parts) + r.choice(breaks) for _ in range(r.choice([0, 1, 2, 5, 20, 60]))) for _ in range(400)] + [None, "x" * 50_000, "```\n" * 301, "# h\n" * 500]
    rows = [(str(i), t, r.choice([None, 1, 10, 40, 200]), r.choice([None, 0, 5, 100])) for i, t in enumerate(texts)]
    cut = chunking.chunks(spark.createDataFrame(rows, "path string, content string, chunk_size int, chunk_overlap int"), 80, 20)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    got: dict = {}
    for c in cut.collect():
        got.setdefault(c.path, {})[c.chunk] = (c.text, c.section)
    for path, text, size, overlap in rows:
        mine = got.get(path, {})
        assert [mine[k] for k in range(len(mine))] == plain_chunks.split_markdown(text or "", 80 if size is None else size, 20 if overlap is None else overlap), (text, size, overlap)


def test_chunk_parameters_of_a_document(spark):
    docs = spark.createDataFrame([("a", "x" * 100, 40, 0), ("b", "x" * 100, None, None), ("c", "", None, None)], "path string, content string, chunk_size int, chunk_overlap int")
    got = {r.path: r.n for r in chunking.chunks(docs, 60, 10).groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 2, "b": 2}


def test_hash_embeddings_against_plain_loops(spark):
    """Buckets in one fold, FNV-1a by byte positions: equal to a loop for each token and byte."""
    import hashlib
    import math
    import re

    from tessera.functions import vectors

    texts = ["the quick fox", "", None, "été \u2003straße " * 40, "a" * 3000 + " b a", "x\x1cy z", "one two two 3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", vectors.hash_vector(F.col("t"), 256, "sha256").alias("h"), vectors.fnv_vector(F.col("t")).alias("v")).orderBy("i").collect()
    for text, row in zip(texts, got, strict=True):
        counts = [0] * 256
        for token in dict.fromkeys(re.findall("[a-z0-9]+", (text or "").lower())):
            counts[int(hashlib.sha256(token.encode()).hexdigest(), 16) % 256] += 1
        n = math.sqrt(sum(c * c for c in counts))
        assert row.h == [c / n if n else 0.0 for c in counts]
        counts = [0] * 64
        for word in (text or "").split():
            h = 0xCBF29CE484222325
            for byte in word.encode():
                h = (h ^ byte) * 0x100000001B3 % (1 << 64)
            counts[h % 64] += 1
        n = math.sqrt(sum(c * c for c in counts))
        assert row.v == pytest.approx([c / n if n else 0.0 for c in counts])
