"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad.  Its evidence is what it looks like and what the lines
before and after it look like; neighbouring labels are coupled.  Forward-backward
gives every line's marginal probability of being good; a document's score is their
mean weighted by length, put on the scale of the labels by one logistic step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import apart, fields, table, tidy, wider
from tessera.llm.sampling import bounded_texts, fold, sampled_ids

#: The fit sees about PER_CLASS documents of each label, and FIT_CHARS characters of
#: text at most: the rest of the sample, in hash order, is left out of the fit alone.
PER_CLASS, FIT_CHARS, ACCEPT = 1500, 10_000_000, 0.3
#: Characters whose features are made at a time, and lines of a chain that is walked line by
#: line; a text of more is scored in pieces.
_AT_ONCE, _LINES = 250_000, 4000

_CLASSES = ("blank", "letter", "upper", "digit", "symbol", "stop", "comma", "shout", "bar", "accent")
_BLANK, _LETTER, _UPPER, _DIGIT, _SYMBOL, _STOP, _COMMA, _SHOUT, _BAR, _ACCENT = (1 << k for k in range(10))


def _char_table() -> np.ndarray:
    """Bit set of classes by code point below 0x600; all others count as letters."""
    t = np.zeros(0x600, np.uint16)
    for i in range(0x600):
        c = chr(i)
        t[i] = (
            _BLANK * (c in " \t\n\x0b\x0c\r\xa0")
            | _LETTER * c.isalpha()
            | _UPPER * c.isupper()
            | _DIGIT * c.isdigit()
            | _SYMBOL * (c in "#*$%&<>{}[]\\^~=+_@/")
            | _STOP * (c in ".?;:)\"'")
            | _COMMA * (c == ",")
            | _SHOUT * (c == "!")
            | _BAR * (c == "|")
            | _ACCENT * (i > 127 and c.isalpha())
        )
    return t


_TABLE = _char_table()
_OWN = 22


@dataclass
class _Lines:
    """What is counted of lines: by class of characters, points, words, and words equal to one
    of the two before; a hash of the words; and the classes of the first and last character of words."""

    counts: np.ndarray
    hashed: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def put_behind(self, other: _Lines) -> _Lines:
        """Both, where the first line of other goes on the last line of these."""
        had, has = self.counts[-1, _WORDS] > 0, other.counts[0, _WORDS] > 0
        self.counts[-1] += other.counts[0]
        self.hashed[-1] += other.hashed[0]
        if has:
            self.last[-1] = other.last[0]
            self.first[-1] = self.first[-1] if had else other.first[0]
        return _Lines(*(np.concatenate([getattr(self, f), getattr(other, f)[1:]]) for f in ("counts", "hashed", "first", "last")))


#: Columns of _Lines.counts behind those of the classes.
_POINTS, _WORDS, _REPEATED = len(_CLASSES), len(_CLASSES) + 1, len(_CLASSES) + 2


def _counted(joined: str, fresh: np.ndarray, before: np.ndarray, at_word: int) -> tuple[_Lines, np.ndarray]:
    """The lines of a string, and its last two words.

    fresh: where texts start in it; before: the (up to two) words before it, and at_word: how
    many words the line that it goes on has already.
    """
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.full(len(points), _LETTER, np.uint16)
    low = points < 0x600
    kinds[low] = _TABLE[points[low]]
    ends = np.append(np.flatnonzero(points == 10), len(points))
    starts = np.concatenate([[0], ends[:-1] + 1])

    def per_line(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[ends] - total[starts]

    blank = (kinds & _BLANK) > 0
    word_start = ~blank & np.concatenate([[True], blank[:-1]])
    # words by a polynomial hash, from running sums (arithmetic modulo 2**64)
    at = np.flatnonzero(word_start)
    upto = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    step = np.arange(len(points), dtype=np.uint64)
    mixed = (points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
    turn = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed * step, dtype=np.uint64)])
    plain = total[upto] - total[at]
    word = plain * np.uint64(0x94D049BB133111EB) + (turn[upto] - turn[at]) - at.astype(np.uint64) * plain
    every = np.concatenate([before, word])
    new = np.searchsorted(at, fresh) + len(before)  # the first word of each text, among every

    def same_as(k: int) -> np.ndarray:
        hit = np.zeros(len(every), bool)
        hit[k:] = every[k:] == every[:-k]
        for j in range(k):
            hit[(new + j)[new + j < len(hit)]] = False
        flags = np.zeros(len(points), np.uint8)
        flags[at[hit[len(before) :]]] = 1
        return per_line(flags)

    last = np.zeros(len(starts), np.uint16)
    if len(upto):
        k = np.searchsorted(upto, ends, "right") - 1
        ok = (k >= 0) & (at[np.maximum(k, 0)] >= starts)
        last[ok] = kinds[upto[k[ok]] - 1]
    first = np.zeros(len(starts), np.uint16)
    if len(at):
        k = np.minimum(np.searchsorted(at, starts), len(at) - 1)
        ok = (at[k] >= starts) & (at[k] < ends)
        first[ok] = kinds[at[k[ok]]]
    line = np.zeros(len(starts), np.uint64)
    if len(at):
        owner = np.searchsorted(starts, at, "right") - 1
        base = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
        index = np.arange(len(at), dtype=np.uint64) - np.repeat(base, np.diff(np.append(base, len(at)))).astype(np.uint64)
        index[owner == 0] += np.uint64(at_word)
        weight = word * (index * np.uint64(2) + np.uint64(1)) + (word >> np.uint64(17)) * index
        line[owner[base]] = np.add.reduceat(weight, base)
    counts = [*(per_line((kinds >> k) & 1) for k in range(len(_CLASSES))), ends - starts, per_line(word_start), same_as(1) + same_as(2)]
    return _Lines(np.column_stack(counts).astype(np.uint32), line, first, last), every[-2:]


def _long_text(text: str) -> _Lines:
    """The lines of one text, counted in pieces that end between words where they can."""
    out, before, at = None, np.zeros(0, np.uint64), 0
    while True:
        to = min(len(text), at + _AT_ONCE)
        if to < len(text):
            cut = max(text.rfind(" ", at, to), text.rfind("\n", at, to)) + 1
            to = cut if cut > at else to
        words = int(out.counts[-1, _WORDS]) if out else 0
        part, before = _counted(text[at:to], np.zeros(0 if out else 1, np.int64), before, words)
        out = out.put_behind(part) if out else part
        at = to
        if at >= len(text):
            return out


def _repeated(hashed: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a line is equal to one before it in its text."""
    order = np.lexsort((hashed, doc))
    out = np.zeros(len(hashed), bool)
    out[order[1:]] = (hashed[order[1:]] == hashed[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    return out


def _own(lines: _Lines, again: np.ndarray) -> np.ndarray:
    """Features of lines by themselves."""
    n = {name: lines.counts[:, k].astype(np.float64) for k, name in enumerate((*_CLASSES, "points", "words", "repeated"))}
    chars, words = n["points"] - n["blank"], n["words"]
    c, w = np.maximum(chars, 1), np.maximum(words, 1)
    share = lambda x, y: np.minimum(x / y, 1.0)
    over = lambda x, limit: (x > limit).astype(np.float64)
    repeated = share(n["repeated"], w)
    symbols, upper, bars, shouts = share(n["symbol"], c), share(n["upper"], np.maximum(n["letter"], 1)), share(n["bar"], w), share(n["shout"], w)
    return np.column_stack(
        [
            (chars == 0).astype(np.float64),
            np.minimum(np.log1p(words) / 5, 2.0),
            over(words, 3),
            over(words, 200),
            share(n["letter"], c),
            symbols,
            over(symbols, 0.05),
            upper,
            over(upper, 0.5),
            share(n["digit"], c),
            bars,
            over(bars, 0.2),
            shouts,
            over(shouts, 0.2),
            repeated,
            over(repeated, 0.15),
            share(n["comma"] + n["stop"], w),
            np.minimum(chars / w / 10, 3.0),
            ((lines.last & (_STOP | _SHOUT)) > 0).astype(np.float64),
            ((lines.first & _UPPER) > 0).astype(np.float64),
            again.astype(np.float64),
            share(n["accent"], c),
        ]
    )


def _visible(lines: _Lines) -> np.ndarray:
    return (lines.counts[:, _POINTS] - lines.counts[:, 0]).astype(np.float64)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, lengths in characters without blanks, lines of each text).

    Every text has at least one line.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    got, _ = _counted("\n".join(texts), np.cumsum(sizes + 1) - sizes - 1, np.zeros(0, np.uint64), 0)
    lines = np.array([t.count("\n") + 1 for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), lines)
    own = _own(got, _repeated(got.hashed, doc))
    inner = np.concatenate([[False], doc[1:] == doc[:-1]])[:, None]
    before = np.vstack([np.zeros((1, _OWN)), own[:-1]]) * inner
    after = np.vstack([own[1:], np.zeros((1, _OWN))]) * np.vstack([inner[1:], [[False]]])
    edge = np.column_stack([~inner[:, 0], np.append(~inner[1:, 0], True), np.ones(len(own))])
    return np.hstack([own, before, after, edge]), _visible(got), lines


def _batches(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about _AT_ONCE characters, so that features are made in bounded memory."""
    run, n = [], 0
    for t in texts:
        if run and n + len(t) > _AT_ONCE:
            yield run
            run, n = [], 0
        run.append(t)
        n += len(t)
    if run:
        yield run


@dataclass
class Model:
    """weights: of the log-odds of "good" that a line's features give; couple: what
    neighbouring (bad, good) labels give; gain, shift: from the mean marginal to the score."""

    weights: np.ndarray
    couple: np.ndarray
    gain: float
    shift: float


def marginals(odds: np.ndarray, couple: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    odds: log-odds of good of all lines; (P(good) by line, expected label pairs by
    chain, log partition by chain).
    """
    chains, first = len(lines), np.concatenate([[0], np.cumsum(lines)[:-1]])
    order = np.argsort(-lines, kind="stable")
    longest = int(lines.max(initial=0))
    alive = np.searchsorted(-lines[order], -np.arange(longest), "left")  # chains with more than t lines
    node = np.stack([np.zeros_like(odds), odds], 1)
    alpha, scale = np.zeros((len(odds), 2)), np.zeros(len(odds))
    e = np.exp(couple)
    at = first[order]
    for t in range(longest):
        k = at[: alive[t]] + t
        x = np.exp(node[k] - node[k].max(1, keepdims=True))
        if t:
            x = x * (alpha[k - 1] @ e)
        s = x.sum(1, keepdims=True)
        alpha[k] = x / s
        scale[k] = np.log(s[:, 0]) + node[k].max(1)
    beta = np.ones((len(odds), 2))
    pairs = np.zeros((chains, 2, 2))
    for t in range(longest - 2, -1, -1):
        m = alive[t + 1]
        k = at[:m] + t
        x = np.exp(node[k + 1] - node[k + 1].max(1, keepdims=True)) * beta[k + 1]
        b = x @ e.T
        p = alpha[k][:, :, None] * e[None] * x[:, None, :]
        pairs[order[:m]] += p / p.sum((1, 2), keepdims=True)
        beta[k] = b / b.sum(1, keepdims=True)
    good = alpha * beta
    good = good[:, 1] / np.maximum(good.sum(1), 1e-300)
    partition = np.add.reduceat(scale, first) if len(scale) else np.zeros(chains)
    return good, pairs, partition


def long_marginals(odds: np.ndarray, couple: np.ndarray) -> np.ndarray:
    """P(good) by line of one long chain: forward-backward in blocks that take their steps
    together, about the square root of its lines; first the products of each block's steps,
    then what enters each block, then the messages inside."""
    size = max(1, int(len(odds) ** 0.5))
    n = -(-len(odds) // size)
    node = np.zeros((n * size, 2))
    node[: len(odds), 1] = odds
    x = np.exp(node - node.max(1, keepdims=True)).reshape(n, size, 2)
    real = (np.arange(n * size) < len(odds)).reshape(n, size)
    e = np.exp(couple)

    def messages(steps: list[int], forward: bool) -> np.ndarray:
        """The normalised message that enters each line, in the order of steps; into the first, (1, 1)."""
        m = e if forward else e.T
        through = np.broadcast_to(np.eye(2), (n, 2, 2))
        for t in steps:
            new = (through * x[:, None, t]) @ m
            through = np.where(real[:, t, None, None], new / new.max((1, 2), keepdims=True), through)
        into = np.ones((n, 2))
        blocks = range(n) if forward else range(n - 1, -1, -1)
        now = np.ones(2)
        for k in blocks:
            into[k] = now
            now = now @ through[k]
            now = now / now.sum()
        out = np.empty((n, size, 2))
        for t in steps:
            out[:, t] = into
            new = (into * x[:, t]) @ m
            into = np.where(real[:, t, None], new / new.sum(1, keepdims=True), into)
        return out

    both = messages(list(range(size)), True) * messages(list(range(size - 1, -1, -1)), False) * x
    return (both[..., 1] / np.maximum(both.sum(2), 1e-300)).ravel()[: len(odds)]


def _long_score(text: str, model: Model) -> tuple[float, int]:
    """(length-weighted mean marginal, bad lines) of one text, its features made some lines at a time."""
    lines = _long_text(text)
    again, n = _repeated(lines.hashed, np.zeros(len(lines.hashed), np.int8)), len(lines.hashed)
    odds = np.empty(n)
    for k in range(0, n, _LINES):
        lo, hi = max(0, k - 1), min(n, k + _LINES + 1)
        own = _own(_Lines(*(getattr(lines, f)[lo:hi] for f in ("counts", "hashed", "first", "last"))), again[lo:hi])
        at = np.arange(k, min(n, k + _LINES)) - lo
        pad = np.vstack([own, np.zeros((1, _OWN))])
        edge = np.column_stack([at + lo == 0, at + lo == n - 1, np.ones(len(at))])
        odds[at + lo] = np.hstack([own[at], np.where((at + lo > 0)[:, None], pad[at - 1], 0), np.where((at + lo < n - 1)[:, None], pad[at + 1], 0), edge]) @ model.weights
    good, chars = long_marginals(odds, model.couple), _visible(lines)
    if not chars.sum():
        return -1.0, 0
    return float((good * chars).sum() / chars.sum()), int(((good < 0.5) & (chars > 0)).sum())


def _mean(good: np.ndarray, chars: np.ndarray, lines: np.ndarray) -> np.ndarray:
    first = np.concatenate([[0], np.cumsum(lines)[:-1]])
    return np.add.reduceat(good * chars, first) / np.maximum(np.add.reduceat(chars, first), 1)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(texts: list[str], labels: list[int], weights: list[float], rounds: int = 200, penalty: float = 0.02) -> Model | None:
    """Maximum conditional likelihood; a document's lines all have its label.

    weights: of the documents.  None without both labels.
    """
    use = [k for k, t in enumerate(texts) if t and t.strip()]
    y = np.array([labels[k] for k in use], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    x, chars, lines = (np.concatenate(c) for c in zip(*(line_features(t) for t in _batches([texts[k] for k in use])), strict=True))
    x = x.astype(np.float32)
    doc_w = np.array([weights[k] for k in use])
    doc_w = doc_w / doc_w.sum()
    row_w, row_y = np.repeat(doc_w / lines, lines), np.repeat(y, lines)
    seen = np.stack([(lines - 1) * (y == 0), (lines - 1) * (y == 1)], 1)
    w, c = np.zeros(x.shape[1]), np.zeros((2, 2))
    m1, m2 = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for k in range(1, rounds + 1):
        good, pairs, _ = marginals((x @ w.astype(np.float32)).astype(np.float64), c, lines)
        gw = x.T @ (row_w * (good - row_y)).astype(np.float32) + penalty * w / 10
        expected = pairs
        expected[:, 0, 0] -= seen[:, 0]
        expected[:, 1, 1] -= seen[:, 1]
        gc = ((doc_w / lines)[:, None, None] * expected).sum(0) + penalty * c
        g = np.concatenate([gw, gc.ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        move = 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-8)
        w, c = w - move[:-4], c - move[-4:].reshape(2, 2)
    good, _, _ = marginals(x @ w, c, lines)
    s = _logit(_mean(good, chars, lines))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression on one number
        p = 1 / (1 + np.exp(-(a * s + b)))
        r, h = doc_w * (p - y), doc_w * p * (1 - p) + 1e-9
        grad = np.array([(r * s).sum() + 1e-3 * (a - 1), r.sum()])
        hess = np.array([[(h * s * s).sum() + 1e-3, (h * s).sum()], [(h * s).sum(), h.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    return Model(w, c, float(max(a, 0.0)), float(b))


def score_texts(texts: list[str | None], model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """(score, number of lines taken for bad) of each text; 0 for a text without a visible character."""
    out, bad = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    if model is None:
        return out, bad
    known = [t or "" for t in texts]
    long = [len(t) > _AT_ONCE or t.count("\n") >= _LINES for t in known]
    mean = np.full(len(texts), -1.0)
    for k in np.flatnonzero(long):
        mean[k], bad[k] = _long_score(known[k], model)
    short = np.flatnonzero(~np.array(long, bool))
    at = 0
    for run in _batches([known[k] for k in short]):
        x, chars, lines = line_features(run)
        good, _, _ = marginals(x @ model.weights, model.couple, lines)
        first, these = np.concatenate([[0], np.cumsum(lines)[:-1]]), short[at : at + len(run)]
        mean[these] = np.where(np.add.reduceat(chars, first) > 0, _mean(good, chars, lines), -1)
        bad[these] = np.add.reduceat((good < 0.5) & (chars > 0), first)
        at += len(run)
    ok = mean >= 0
    out[ok] = 1 / (1 + np.exp(-(model.gain * _logit(mean[ok]) + model.shift)))
    return out, bad


def classify(docs: DataFrame, model: Model | None, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """docs (without text_col) with score, predicted and n_bad_lines.

    A null or blank text, and every text without a model, has score 0.  Whole texts
    are read; one of more than 250,000 characters, or 4000 lines, is counted in pieces and its
    features are made some lines at a time, so it costs a few bytes a character.  A text's
    score doesn't depend on other rows; repeated rows stay.  Columns named like those that are
    made, whatever their case, give way.  No rows give no rows.
    """
    docs = tidy(docs, (text_col,), ("score", "predicted", "n_bad_lines"))
    keep = [c for c in docs.columns if c != text_col]
    given = docs.select(*[F.col(f"`{c}`") for c in keep], text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, bad = [np.zeros(0)], [np.zeros(0, np.int64)]
            for k in range(0, b.num_rows, 500):
                s, n = score_texts(b.column(len(keep)).slice(k, 500).to_pylist(), model)
                score.append(s)
                bad.append(n)
            s = np.concatenate(score)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= accept).astype(np.int32)), pa.array(np.concatenate(bad))], [*keep, "score", "predicted", "n_bad_lines"])

    return given.mapInArrow(run, wider(given.drop(text_col).schema, "score double, predicted int, n_bad_lines long"))


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, chars: int = FIT_CHARS) -> Model | None:
    """A model of the texts and labels.quality of documents that are not held out.

    The sampled ids are bounded, so they are broadcast; documents are only read, and at most
    `chars` characters of them come to the driver.  None without both labels.
    """
    docs, labels = tidy(docs, ("doc_id", "text")), tidy(labels, ("doc_id", "quality"))
    labelled = labels.where(fold(5) != 0).select("doc_id", F.col("quality").alias("label"))
    ids, counts = sampled_ids(labelled.where("label IN (0, 1)"), per_class, 2)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id").where("text IS NOT NULL")
    taken = bounded_texts(rows, chars, _AT_ONCE)
    have = {y: sum(r.label == y for r in taken) for y in (0, 1)}
    return fit([r.text for r in taken], [r.label for r in taken], [counts.get(r.label, 0) / max(1, have[r.label]) for r in taken])


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_bad_lines of every document."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out")
    return classify(docs.select("doc_id", held_out, "text"), model)


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that the model accepts, with the columns of docs.

    Without a model (no labels of both kinds) nothing is known against any row: all stay,
    though classify() gives them no score.  Of columns that differ in case only, the first stays.
    """
    if model is None:
        return docs
    given, names = apart(docs, ("text",), whole=True)
    return classify(given.withColumnRenamed("_row", "row"), model).where("predicted = 1").select(*fields(names, "row"))
