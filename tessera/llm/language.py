"""Language identification in two steps: the family, then the language within it.

A text is the relative frequencies of the character n-grams of its words (letters
only, lower case, with word borders).  Linear support vector machines, one for each
pair of families, vote for the family; those for each pair of its languages vote
for the language.  All are linear in the counts, so a word's part of every margin is
computed once and remembered.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table, tidy, wider
from tessera.llm.sampling import bounded_texts, fold, sampled_ids

#: Languages by family (ISO 639-1); a language that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb yi fy",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indo-aryan": "hi bn ur pa mr gu ne si",
    "semitic": "ar he mt am",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

#: The fit sees about PER_LANGUAGE documents of each label, ROWS and FIT_CHARS characters at
#: most in all (the more labels, the fewer of each), and the N_GRAMS n-grams of 1 to 3
#: characters that most of them have.  Texts of over LONGEST characters teach nothing.
PER_LANGUAGE, ROWS, FIT_CHARS, LONGEST, N_GRAMS = 600, 6000, 10_000_000, 250_000, 2000
_WORD = re.compile(r"[^\W\d_]+")
#: Words that a worker remembers, numbers in its table of them, the longest word that recurs,
#: and letters of a longer one that are looked at together.
_REMEMBERED, _CELLS, _LONGEST, _PIECE = 500_000, 4_000_000, 40, 20_000


def grams(word: str) -> list[str]:
    """Its letters, and all pairs and triples with the borders."""
    w = f" {word} "
    n = len(w)
    return [*word, *(w[i : i + 2] for i in range(n - 1)), *(w[i : i + 3] for i in range(n - 2))]


def family(lang: str) -> str:
    return FAMILY.get(lang.split("-")[0].split("_")[0].lower(), lang)


def _svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 150) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss (y is 1 or -1),
    each side weighted alike, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(x.dtype)
    v = np.ones(x.shape[1], x.dtype)
    for _ in range(15):  # the largest eigenvalue bounds the step
        v = x.T @ (c * (x @ v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (2 * norm + penalty)
    w = ahead = np.zeros(x.shape[1], x.dtype)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead))
        new = ahead - step * (penalty * ahead - 2 * x.T @ (c * y * slack))
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w


@dataclass
class Model:
    """weights: n-gram by machine; the machines' two sides are families or languages."""

    gram: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    sides: list[tuple[str, str]]
    members: dict[str, list[str]]

    def _vote(self, margins: np.ndarray, among: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The index in among that wins most pairs (ties: by margin), and its least margin."""
        wins = np.zeros((len(margins), len(among)))
        total, least = np.zeros_like(wins), np.full_like(wins, np.inf)
        for a, b in combinations(range(len(among)), 2):
            m = margins[:, self.sides.index((among[a], among[b]))]
            for k, s in ((a, m), (b, -m)):
                wins[:, k] += s > 0
                total[:, k] += np.clip(s, -1, 1)
                least[:, k] = np.minimum(least[:, k], s)
        best = (wins + total / (10 * len(among))).argmax(1) if len(among) > 1 else np.zeros(len(margins), int)
        return best, least[np.arange(len(margins)), best]

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        families = sorted(self.members)
        sure = lambda m: 1 / (1 + np.exp(-4 * np.clip(m, -50, 50)))
        fam, fm = self._vote(margins, families)
        langs, score = [""] * len(margins), sure(fm)
        for k, f in enumerate(families):
            at = np.flatnonzero(fam == k)
            best, m = self._vote(margins[at], self.members[f])
            score[at] *= sure(m)
            for i, b in zip(at, best, strict=True):
                langs[i] = self.members[f][b]
        return langs, score


def fit(rows: list[tuple[str, str]], n_grams: int = N_GRAMS) -> Model | None:
    """rows: (text, lang).  Short stretches of the texts are added, so that short texts are learnt too.

    The matrix has three rows for a text and n_grams columns, in single precision.
    """
    examples: list[tuple[list[str], str]] = []
    for text, lang in rows:
        words = _WORD.findall((text or "").lower())
        if words:
            examples.append((words, lang))
            examples += [(words[k : k + n], lang) for n, k in ((4, len(words) // 3), (12, len(words) // 2)) if len(words) > 3 * n]
    if not examples:
        return None
    of_word: dict[str, list[str]] = {}
    seen: Counter[str] = Counter()
    for words, _ in examples:
        seen.update({g for w in set(words) for g in of_word.setdefault(w, grams(w))})
    gram = {g: i for i, (g, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:n_grams])}
    x = np.zeros((len(examples), len(gram)), np.float32)
    for row, (words, _) in zip(x, examples, strict=True):
        n = 0
        for w, times in Counter(words).items():
            for g in of_word[w]:
                n += times
                if (i := gram.get(g)) is not None:
                    row[i] += times
        row /= n
    scale = (1 / (np.sqrt((x * x).mean(0)) + 1e-4)).astype(np.float32) / np.float32(np.sqrt(len(gram)))
    x *= scale
    lang = np.array([y for _, y in examples])
    members: dict[str, list[str]] = {}
    for y in sorted(set(lang.tolist())):
        members.setdefault(family(y), []).append(y)
    fam = np.array([family(y) for y in lang.tolist()])
    sides, ws = [], []
    for labels, pairs in [(fam, combinations(sorted(members), 2)), *((lang, combinations(v, 2)) for v in members.values())]:
        for a, b in pairs:
            at = (labels == a) | (labels == b)
            sides.append((a, b))
            ws.append(_svm(x[at], np.where(labels[at] == a, 1, -1).astype(np.float32)))
    w = np.array(ws, np.float64).reshape(len(ws), len(gram) + 1).T
    return Model(gram, w[:-1] * scale[:, None].astype(np.float64), w[-1], sides, members)


class Scorer:
    """Margins of whole texts; remembers what words add."""

    def __init__(self, model: Model) -> None:
        self.model, self._at, self._long = model, {}, 0
        self._most = min(_REMEMBERED, _CELLS // (model.weights.shape[1] + 1))
        self._weights = np.vstack([model.weights, np.zeros((1, model.weights.shape[1]))])  # the last row: no known n-gram
        self._table = np.zeros((1024, model.weights.shape[1] + 1))

    def _add(self, words: list[str]) -> None:
        at, get = len(self._at), self.model.gram.get
        while at + len(words) > len(self._table):
            self._table = np.vstack([self._table, np.zeros_like(self._table)])
        found = [grams(w) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        known = np.array([get(g, -1) for x in found for g in x], np.int64)
        self._table[at : at + len(words), :-1] = np.add.reduceat(self._weights[known], np.cumsum(sizes) - sizes)
        self._table[at : at + len(words), -1] = sizes
        self._at.update(zip(words, range(at, at + len(words)), strict=True))
        self._long += sum(len(w) > _LONGEST for w in words)

    def sums(self, words: list[str]) -> np.ndarray:
        """The machines' sums over the words, and the number of n-grams."""
        if len(self._at) > self._most or self._long > 1000:
            self._at.clear()
            self._long = 0
        get, out = self._at.get, np.zeros(self._table.shape[1])
        if any(len(w) > _PIECE for w in words):
            out += sum(self._piecewise(w) for w in words if len(w) > _PIECE)
            words = [w for w in words if len(w) <= _PIECE]
        for k in range(0, len(words), 200_000):
            part = words[k : k + 200_000]
            if new := list(dict.fromkeys(w for w in part if w not in self._at)):
                self._add(new)
            out += self._table[list(map(get, part))].sum(0)
        return out

    def _piecewise(self, word: str) -> np.ndarray:
        """The sums of one very long word, its n-grams made some at a time."""
        w, get, out = f" {word} ", self.model.gram.get, np.zeros(self._table.shape[1])
        for k in range(0, len(w), _PIECE):
            part = w[k : k + _PIECE + 2]
            n = min(_PIECE, len(w) - k)  # n-grams that start here
            found = [*part[:n], *(part[i : i + 2] for i in range(min(n, len(part) - 1))), *(part[i : i + 3] for i in range(min(n, len(part) - 2)))]
            out[:-1] += self._weights[np.fromiter((get(g, -1) for g in found if g != " "), np.int64)].sum(0)
            out[-1] += len(found) - found.count(" ")
        return out

    def _text(self, text: str) -> np.ndarray:
        """The sums of a whole text, its words found some at a time."""
        if len(text) <= LONGEST:
            return self.sums(_WORD.findall(text.lower()))
        out, run = np.zeros(self._table.shape[1]), []
        for m in _WORD.finditer(text.lower()):
            run.append(m[0])
            if len(run) == 50_000:
                out, run = out + self.sums(run), []
        return out + self.sums(run)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        sums = np.array([self._text(t or "") for t in texts]).reshape(len(texts), -1)
        n = sums[:, -1]
        langs, score = self.model.decide(sums[:, :-1] / np.maximum(n, 1)[:, None] + self.model.bias)
        ok = np.array([k > 0 and any(map(str.isalpha, t)) for k, t in zip(n, texts, strict=True)], bool)
        return [x if k else "und" for x, k in zip(langs, ok, strict=True)], np.where(ok, score, 0.0)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs (without text_col) with lang_pred and score.

    "und" and 0 for a null text, a text without letters, or without a model.  Whole texts are
    read, the words of a very long one some at a time.  A row's result depends on no other
    row; repeated rows stay.  Columns named like those that are made, whatever their case, give
    way.  No rows give no rows.
    """
    docs = tidy(docs, (text_col,), ("lang_pred", "score"))
    keep = [c for c in docs.columns if c != text_col]
    given = docs.select(*[F.col(f"`{c}`") for c in keep], text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model) if model else None
        for b in batches:
            parts = []
            for k in range(0, b.num_rows, 500):
                texts = b.column(len(keep)).slice(k, 500).to_pylist()
                parts.append(scorer(texts) if scorer else (["und"] * len(texts), np.zeros(len(texts))))
            langs = [x for p in parts for x in p[0]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(np.concatenate([p[1] for p in parts] or [np.zeros(0)]))], [*keep, "lang_pred", "score"])

    return given.mapInArrow(run, wider(given.drop(text_col).schema, "lang_pred string, score double"))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = ROWS, chars: int = FIT_CHARS) -> Model | None:
    """A model of docs' text and lang; rows without either teach nothing.

    Every label is learnt, from at least one expected document; the number of machines grows
    with the square of the families, and of the languages in each.
    """
    docs = tidy(docs, ("doc_id", "text", "lang"))
    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", F.col("lang").alias("label"))
    labels = known.select("label").distinct().count()
    ids, _ = sampled_ids(known, max(1, min(per_language, rows // max(labels, 1))), labels)
    return fit([(r.text, r.label) for r in bounded_texts(ids.select("doc_id", "text", "label"), chars, LONGEST)])


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learnt from rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False)))
    model = learn(docs.where("NOT held_out"))
    return identify(docs.select("doc_id", "held_out", "text"), model)
