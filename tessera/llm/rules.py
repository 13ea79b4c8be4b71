"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at a few numbers of a text and votes good (1), bad (-1) or abstains
(0).  Expectation-maximisation over the vote patterns of all documents estimates,
without labels, how often each rule is right on good and on bad documents; the
posterior probability of "good" then decides, in place of a filter that every rule
must pass.  There are at most 3 ** len(RULES) vote patterns, and only their counts
reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import apart, durable, fields, table, tidy

_BLANK = " \t\n\x0b\x0c\r"
_BLANKS = r"[\x20\x09-\x0D]+"
#: Words in a window, and rounds of expectation-maximisation.
WINDOW, ROUNDS = 5, 40
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


#: What features() counts.
COUNTS = (*BASE, "n_lines", "n_ended_lines", "n_upper", "n_distinct_words")


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs (without text_col) and the counts of each whole text (long; a null text has
    none).  Columns of docs that are named like these counts, whatever their case, give way.

    A text's repeated windows are found inside its own row: the window hashes are
    an array, and only a text with a repeat sorts them.  So no words are shuffled, and a
    very long text costs memory in proportion to its length.  Repeated rows stay.
    """
    docs, names = apart(docs, (text_col,), COUNTS)
    others = ["_row"]
    size = lambda c: F.size(c).cast("long")
    rest = lambda pattern: F.length(F.regexp_replace("_t", pattern, "")).cast("long")
    step = docs.select(*others, F.coalesce(F.col(text_col), F.lit("")).alias("_t")).select(
        *others,
        "_t",
        F.expr(f"CASE WHEN _t RLIKE '[^\\\\x20\\\\x09-\\\\x0D]' THEN split(btrim(_t, '{_BLANK}'), '{_BLANKS.replace(chr(92), chr(92) * 2)}') ELSE CAST(array() AS ARRAY<STRING>) END").alias("_w"),
        F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    step = step.select(
        *others,
        size("_w").alias("n_words"),
        rest(_BLANKS).alias("word_chars"),
        rest(r"[^#*$%&|<>]+").alias("n_symbols"),
        (size("_l") - size(F.array_distinct("_l"))).alias("n_dup_lines"),
        size("_l").alias("n_lines"),
        size(F.filter("_l", lambda x: x.rlike(r"""[.!?"'»”)][\x20\x09-\x0D]*$"""))).alias("n_ended_lines"),
        rest(r"\P{Lu}+").alias("n_upper"),
        size(F.array_distinct("_w")).alias("n_distinct_words"),
        F.expr(f"CASE WHEN size(_w) < {WINDOW} THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0, size(_w) - {WINDOW}), i -> xxhash64({', '.join(f'_w[i + {k}]' for k in range(WINDOW))})) END").alias("_h"),
    )
    given = [*others, *(c for c in COUNTS if c != "n_repeat_words")]
    step = step.select(*given, F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> named_struct('h', h, 'i', i))) END").alias("_s"))
    step = step.select(*given, F.expr("sort_array(transform(filter(_s, (x, k) -> x.h = get(_s, k - 1).h OR x.h = get(_s, k + 1).h), x -> x.i))").alias("_p"))
    covered = f"coalesce(aggregate(_p, named_struct('last', -{WINDOW}, 'n', 0), (a, p) -> named_struct('last', p, 'n', a.n + least({WINDOW}, p - a.last))).n, 0)"
    return step.select(*fields(names), *given[1:], F.expr(covered).cast("long").alias("n_repeat_words"))


@dataclass(frozen=True)
class Rule:
    """good and bad: SQL conditions on the counts; bad is tested first, neither is an abstention."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("length", "n_words >= 50", "n_words < 10"),
    Rule("repeated_windows", "n_repeat_words = 0", "100 * n_repeat_words > 10 * n_words"),
    Rule("symbols", "50 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    Rule("word_length", "word_chars BETWEEN 3 * n_words AND 8 * n_words", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    Rule("repeated_lines", "n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    Rule("upper_case", "10 * n_upper <= word_chars", "2 * n_upper > word_chars"),
    Rule("line_ends", "10 * n_ended_lines >= 9 * n_lines", "2 * n_ended_lines < n_lines"),
    Rule("variety", "3 * n_distinct_words >= n_words", "10 * n_distinct_words < n_words"),
)


#: What a rule is taken to do before any document is seen: its chances to vote good,
#: to vote bad and to abstain, on a good and on a bad document; each counts as so
#: many documents.
PRIOR_GOOD, PRIOR_VOTES, PRIOR_SIZE = 0.85, ((0.88, 0.005, 0.115), (0.68, 0.20, 0.12)), 20


@dataclass
class Model:
    """P(good), and by rule its chances to vote good, bad and abstain on good and on bad documents."""

    prior: float
    rates: list[tuple[tuple[float, float, float], tuple[float, float, float]]]

    def weights(self) -> list[dict[int, float]]:
        """The log-odds of "good" that each vote of a rule adds."""
        return [{v: math.log(g[k] / b[k]) for k, v in enumerate((1, -1, 0))} for g, b in self.rates]

    def accuracy(self) -> list[float]:
        """The chance that a vote of a rule is right."""
        right = lambda g, b: self.prior * g[0] + (1 - self.prior) * b[1]
        return [right(g, b) / (self.prior * (g[0] + g[1]) + (1 - self.prior) * (b[0] + b[1])) for g, b in self.rates]


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation on (votes, number of documents).

    The rules are taken to be independent given the class.  Without documents the
    model is the prior one.
    """
    m = Model(PRIOR_GOOD, [PRIOR_VOTES] * (len(patterns[0][0]) if patterns else 0))
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        w, base = m.weights(), math.log(m.prior / (1 - m.prior))
        post = [1 / (1 + math.exp(-max(-500.0, min(500.0, base + sum(w[j][v] for j, v in enumerate(votes)))))) for votes, _ in patterns]
        good = sum(p * n for p, (_, n) in zip(post, patterns, strict=True))
        rates = []
        for j in range(len(m.rates)):
            of = []
            for k, (mass, p_of) in enumerate(((good, lambda p: p), (total - good, lambda p: 1 - p))):
                got = [sum(p_of(p) * n for p, (votes, n) in zip(post, patterns, strict=True) if votes[j] == v) for v in (1, -1, 0)]
                of.append(tuple((x + PRIOR_SIZE * y) / (mass + PRIOR_SIZE) for x, y in zip(got, PRIOR_VOTES[k], strict=True)))
            rates.append(tuple(of))
        m = Model((good + PRIOR_SIZE * PRIOR_GOOD) / (total + PRIOR_SIZE), rates)
    return m


def votes(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    return [F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0).alias(f"vote_{r.name}") for r in rules]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def judge(counted: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """counted (of features(), written) with the votes, p_good and kept.

    kept: not base_failed, and p_good >= least.  A text without words fails the base.
    No rows give no rows.  Columns named like the votes, p_good, base_failed and kept, whatever
    their case, give way.
    """
    counted = tidy(counted, COUNTS, (*(f"vote_{r.name}" for r in rules), "p_good", "base_failed", "kept"))
    voted = counted.select("*", *votes(rules))
    names = [f"vote_{r.name}" for r in rules]
    m = fit([(tuple(r)[:-1], r[-1]) for r in voted.groupBy(*names).count().orderBy(*names).collect()])
    odds = F.lit(math.log(m.prior / (1 - m.prior)))
    for name, w in zip(names, m.weights() or [{1: 0.0, -1: 0.0, 0: 0.0}] * len(names), strict=True):
        odds = odds + F.when(F.col(name) == 1, w[1]).when(F.col(name) == -1, w[-1]).otherwise(w[0])
    return (
        voted.withColumn("p_good", 1 / (1 + F.exp(-odds)))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and p_good of every document."""
    counted = durable(features(table(spark, sf_dir, "documents").select("doc_id", "text")), "rules")
    return judge(counted).select("doc_id", *BASE, "base_failed", "kept", F.round("p_good", 6).alias("p_good"))


def _oracle() -> str:
    """Counts by windows and sets of rows; then expectation-maximisation as a recursion whose
    row holds the prior and, by rule r and vote v, the rates g{r}_{v} and b{r}_{v}."""
    ks, vs = range(len(RULES)), ((1, "p"), (-1, "m"), (0, "z"))
    cells = [(r, v, n, side) for side in "gb" for r in ks for v, n in vs]
    prior = lambda side, v: PRIOR_VOTES["gb".index(side)][(1, -1, 0).index(v)]
    odds = "ln(prior / (1 - prior))" + "".join(f" + CASE v{r} WHEN 1 THEN ln(g{r}_p / b{r}_p) WHEN -1 THEN ln(g{r}_m / b{r}_m) ELSE ln(g{r}_z / b{r}_z) END" for r in ks)
    mass = {"g": "p * n", "b": "(1 - p) * n"}
    sums = ", ".join(f"sum(CASE WHEN v{r} = {v} THEN {mass[side]} ELSE 0 END) AS {side}{r}_{n}" for r, v, n, side in cells)
    rates = ", ".join(f"({side}{r}_{n} + {PRIOR_SIZE} * {prior(side, v)}::DOUBLE) / ({'good' if side == 'g' else 'total - good'} + {PRIOR_SIZE}) AS {side}{r}_{n}" for r, v, n, side in cells)
    start = ", ".join(f"{prior(side, v)}::DOUBLE AS {side}{r}_{n}" for r, v, n, side in cells)
    votes = ", ".join(f"CASE WHEN {x.bad} THEN -1 WHEN {x.good} THEN 1 ELSE 0 END AS v{r}" for r, x in enumerate(RULES))
    all_v = ", ".join(f"v{r}" for r in ks)
    blank = r"[\x20\x09-\x0D]"
    return f"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS nr FROM documents
), w AS (
  SELECT doc_id, nr, t, list_filter(regexp_split_to_array(t, '{blank}+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t
), g AS (
  SELECT nr, i, count(*) OVER (PARTITION BY nr, w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS times FROM (SELECT nr, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= {WINDOW})
), p AS (
  SELECT nr, count(DISTINCT i + k) AS n FROM g, range({WINDOW}) s(k) WHERE times > 1 GROUP BY nr
), c AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '{blank}+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '[.!?"''»”)]{blank}*$'))) AS n_ended_lines, length(regexp_replace(t, '\\P{{Lu}}+', '', 'g')) AS n_upper, len(list_distinct(w)) AS n_distinct_words
  FROM w LEFT JOIN p USING (nr)
), v AS (
  SELECT *, {votes} FROM c
), q AS (
  SELECT {all_v}, count(*)::DOUBLE AS n FROM v GROUP BY {all_v}
), em AS (
  SELECT 0 AS k, {PRIOR_GOOD}::DOUBLE AS prior, {start}
  UNION ALL
  SELECT k + 1, (good + {PRIOR_SIZE} * {PRIOR_GOOD}::DOUBLE) / (total + {PRIOR_SIZE}), {rates}
  FROM (SELECT k, sum(n) AS total, sum(p * n) AS good, {sums} FROM (SELECT *, 1 / (1 + exp(-greatest(-500, least(500, {odds})))) AS p FROM em CROSS JOIN q WHERE k < {ROUNDS}) GROUP BY k)
), j AS (
  SELECT v.*, round(1 / (1 + exp(-({odds}))), 6) AS p_good FROM v CROSS JOIN (SELECT * FROM em WHERE k = {ROUNDS})
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p_good >= 0.5 AS kept, p_good
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM j)
"""


ORACLE_OP2 = _oracle()
