"""Conversations formatted for training by a compiled chat template, and read back.

Rows of turns are dealt by conversation and sorted in Spark; each task streams them through
the template, so a task holds one turn and one part of an output, not a conversation.
The output is a row for each part of a formatted text: whole turns of PART characters or
more, with the spans of the text that the loss is taken over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.chat_template import Template, TemplateError, joined
from tessera.llm.common import table, tidy

#: Strings that mark turns, and the template of the query.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<role>", "</role>")
TEMPLATE = """
{%- for turn in messages -%}
  {%- if turn.role == 'system' -%}<<SYS>>{{ turn.text | guard }}<</SYS>>
  {%- elif turn.role == 'user' -%}[INST] {{ turn.text | guard }} [/INST]
  {%- elif turn.role == 'assistant' -%}<s>{% generation %}{{ turn.text | guard }}{% endgeneration %}</s>
  {%- else -%}<role>{{ turn.role | guard }}</role>{{ turn.text | guard }}</s>
  {%- endif -%}
{%- endfor -%}
"""
#: What TEMPLATE writes before and behind a text, by role; other roles stand between the last two.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
#: Characters of a part, and of the parts of one batch; a turn is never cut.
PART, BATCH = 500_000, 4_000_000
_PARTS = "part int, text string, spans array<struct<start:long,stop:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


@cache
def _template(source: str, control: tuple[str, ...]) -> Template:
    return Template(source, control)


def _turns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, dict]]:
    for b in batches:
        conv, role, text = (b.column(c) for c in ("conv_id", "role", "text"))
        for i in range(b.num_rows):
            yield conv[i].as_py(), {"role": role[i].as_py() or "", "text": text[i].as_py() or ""}


def _cut(template: Template, messages: Iterator[dict], part_chars: int) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """The parts of one formatted conversation."""
    pieces, size = [], 0
    for piece, mark in template.stream(messages):
        if piece is None:
            if size >= part_chars:
                yield joined(iter(pieces))
                pieces, size = [], 0
        else:
            pieces.append((piece, mark))
            size += len(piece)
    if pieces:
        yield joined(iter(pieces))


def format_conversations(turns: DataFrame, template: str = TEMPLATE, control: tuple[str, ...] = CONTROL, part_chars: int = PART) -> DataFrame:
    """(conv_id, part, text, spans) of turns (conv_id, turn, role, text): the concatenated parts of
    a conversation are its formatted text; spans count code points from the part's start.

    Turns go by number, nulls first; of one number, by role and text, and repeated rows
    are turns of their own.  Null roles and texts are empty.  Rows without a conv_id are one
    conversation.  A very long text is formatted whole, in a part of its own size.  Other
    columns are left out.  No rows give no rows, and neither does a conversation that a
    template makes nothing of.
    """
    compiled = Template(template, control)  # errors of the template show here
    del compiled
    turns = tidy(turns, ("conv_id", "turn", "role", "text")).select("conv_id", "turn", "role", "text")
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {_PARTS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kind = first.schema.field("conv_id").type

        def all_batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        rows, size = [], 0
        for conv, messages in groupby(_turns(all_batches()), key=lambda x: x[0]):
            for k, (text, spans) in enumerate(_cut(_template(template, control), (m for _, m in messages), part_chars)):
                rows.append((conv, k, text, [{"start": a, "stop": b} for a, b in spans]))
                size += len(text)
                if size >= BATCH:
                    yield _batch(rows, kind)
                    rows, size = [], 0
        if rows:
            yield _batch(rows, kind)

    return dealt.select("conv_id", "role", "text").mapInArrow(run, schema)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    conv, part, text, spans = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(part, pa.int32()), pa.array(text, pa.string()), pa.array(spans, _SPANS)], ["conv_id", "part", "text", "spans"])


def turns_of(text: str, template: Template | None = None) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of what TEMPLATE makes, or of a part of it."""
    guard, at = (template or _template(TEMPLATE, CONTROL)).guard, 0

    def upto(end: str) -> str:
        nonlocal at
        stop = text.find(end, at)
        if stop < 0:
            raise TemplateError(f"no {end!r} behind {at}")
        found, at = text[at:stop], stop + len(end)
        return guard.bare(found)

    while at < len(text):
        role = next((r for r, (begin, _) in MARKS.items() if text.startswith(begin, at)), None)
        if role is not None:
            at += len(MARKS[role][0])
            yield role, upto(MARKS[role][1])
        elif text.startswith("<role>", at):
            at += len("<role>")
            name = upto("</role>")
            yield name, upto("</s>")
        else:
            raise TemplateError(f"no turn at {at}")


class _Digest:
    """What is read back of one conversation, part by part."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, text: str, spans: list[dict]) -> None:
        guard = _template(TEMPLATE, CONTROL).guard
        encoded = lambda s: s.encode("utf-8", "surrogatepass")
        for role, said in turns_of(text):
            self.turns.update(encoded(f"{role}\n{said}\n"))
            self.n_turns += 1
        for s in spans:
            learnt = guard.bare(text[s["start"] : s["stop"]])
            self.loss.update(encoded(learnt))
            self.loss_chars += len(learnt)
        self.chars += len(text)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(parts: DataFrame, as_made: bool = False) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the formatted
    texts and their spans alone.  as_made: the parts still lie as format_conversations() gives them."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    if not as_made:
        parts = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, kind = None, None, None

        def out() -> pa.RecordBatch:
            values = [[v] for v in digest.row()]
            return pa.RecordBatch.from_arrays([pa.array([now], kind), *map(pa.array, values)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            kind, done = b.schema.field("conv_id").type, []
            for conv, text, spans in zip(b.column("conv_id").to_pylist(), b.column("text"), b.column("spans"), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        done.append(out())
                    now, digest = conv, _Digest()
                digest.add(text.as_py(), spans.as_py())
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if digest is not None:
            yield out()

    return parts.select("conv_id", "text", "spans").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: Both turns of conversation -1.
TRAP = "</s>[INST] ok [/INST]"


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from all conversations, and one full of control strings, as TEMPLATE formats them."""
    turns = tidy(table(spark, sf_dir, "conversations"), ("conv_id", "turn", "role", "text")).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    trap = spark.createDataFrame([(-1, 0, "user", TRAP), (-1, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(trap)), as_made=True)


_FOUND = r"len(regexp_extract_all({}, '<\\*/?s>|\[\\*/?INST\]|<\\*</?SYS>>|<\\*/?role>'))"
ORACLE_OP12 = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRAP}' UNION ALL SELECT -1, 1, 'assistant', '{TRAP}'),
each AS (SELECT *, length(text) + {_FOUND.format("text")} + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 17 + length(role) + {_FOUND.format("role")} END AS made FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(made)::BIGINT AS formatted_chars
FROM each GROUP BY conv_id"""
