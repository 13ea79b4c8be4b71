"""Token ids by a public tokenizer, at the speed of a dictionary.

The tokenizer drops white space and never joins ids over a space, so a text's ids
are those of its space-separated chunks in order.  Chunks recur, so each worker
keeps a bounded dictionary from chunk to the bytes of its ids.  A new chunk that is
a Latin word, perhaps with marks behind it, is merged by tiktoken, which is handed
the same merges as ranks (one byte that UTF-8 never has stands for the word end);
all other chunks go through the tokenizer itself.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidy, wider

#: Chunks and words that a worker remembers, and the longest of them, in characters.
REMEMBERED, LONGEST = 300_000, 40
#: Marks that make one token run of their own behind a word, and the word end.
_MARKS, _END, _STOP = ",.*%&$#!|;:?", "</w>", b"\xff"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _merger(path: str):
    """A function from a lower-case word to its ids, or None if the file has other rules."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    if rules["model"]["type"] != "BPE" or rules["model"]["end_of_word_suffix"] != _END or [n["type"] for n in rules["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"]:
        return None
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level BPE writes as themselves
    char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    byte = {c: b for b, c in char.items()}
    raw = lambda t: bytes(byte[c] for c in t.removesuffix(_END)) + _STOP * t.endswith(_END)
    vocab, ranks, ids = rules["model"]["vocab"], {}, []
    merged = [(a + b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in rules["model"]["merges"])]
    for key, token in [*((bytes([b]), char[b]) for b in range(256)), *((bytes([b]) + _STOP, char[b] + _END) for b in range(256)), *((raw(t), t) for t in merged)]:
        ranks[key] = len(ids)
        ids.append(vocab[token])
    merge = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda word: array("I", map(ids.__getitem__, merge(word.encode() + _STOP))).tobytes()


class ChunkTokenizer:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._merge = _merger(path)
        self._known: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def _ids(self, chunk: str) -> bytes:
        return array("I", self._tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _new(self, chunk: str) -> bytes:
        words = self._words
        word = chunk.rstrip(_MARKS).lower()
        if self._merge is None or not word.isalpha() or max(word) >= "\u0250":
            return self._ids(chunk)
        found = words.get(word)
        if found is None:
            found = self._merge(word)
            if len(word) <= LONGEST:
                if len(words) >= REMEMBERED:
                    words.clear()
                words[word] = found
        if chunk[-1] in _MARKS:
            marks = chunk[len(chunk.rstrip(_MARKS)) :]
            end = words.get(marks)
            if end is None:
                end = words[marks] = self._ids(marks)
            return found + end
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text, without special tokens."""
        chunks = text.replace("\n", " ").split(" ")
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        new = [c for c in dict.fromkeys(chunks) if c not in known]
        for c in new:
            known[c] = self._new(c)
        out = b"".join(map(known.__getitem__, chunks))
        for c in new:
            if len(c) > LONGEST:
                del known[c]
        return out


@cache
def tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


def count_tokens(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with text_col replaced by n_tokens (long; a null or empty text has 0).

    Whole texts are encoded, one at a time.  Repeated rows stay; no rows give no rows.  A
    column n_tokens of docs, whatever its case, gives way.
    """
    path = path or default_path()
    docs = tidy(docs, (text_col,), ("n_tokens",))
    keep = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode
        for b in batches:
            n = [len(encode(t.as_py() or "")) // 4 for t in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    given = docs.select(*[F.col(f"`{c}`") for c in keep], text_col)
    return given.mapInArrow(run, wider(given.drop(text_col).schema, "n_tokens long"))
