"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Time is cut into slots; each slot takes one block of documents of one source.  In
the ideal (fluid) schedule all sources with blocks left run at once, at rates in
proportion to their weights, which are whole numbers; when one has run out, the others
share its part.  A source must have its j-th block (from 0) between the release, the
slot in which the ideal one begins it, and the deadline, by which the ideal one has
finished it: in weights of sum 1 and until a source runs out floor(j / w) and
ceil((j + 1) / w).  The released block with the earliest deadline goes first.  So
every block meets its deadline, and in every prefix each source is less than one
block off its share.

Frames: whenever every source has had a whole multiple of its weight in blocks (or
all of its blocks), the ideal schedule has no block begun, so all that is released is
placed and the next frame starts afresh.  A frame has at most as many slots as the
weights sum to.  Frames in which no source has its last block are alike between
two that have one.  So the driver schedules at most two frames a source and one,
whatever the number of documents; which frame a block is in, and where, is arithmetic.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import apart, fields, table, written

#: Documents in a block, the exponent that flattens corpus shares to target weights where
#: none are given, and about what those weights sum to at most.
BLOCK, FLATTEN, PARTS = 8, 0.7, 16384
#: Ranges of frames that are looked up by an equi-join, at most; and rows of a table up to which
#: it is broadcast, so that documents stay where they are.
_RANGES, _FEW = 1 << 16, 1 << 18
#: What mix() adds; columns of these names give way.
OWN = ("mix_source", "block", "release", "deadline", "slot", "position")


def whole(weights: dict[str, float]) -> dict[str, int]:
    """The least whole numbers in the same proportions; a float counts as the decimal it prints as."""
    exact = {s: Fraction(str(w)) if isinstance(w, float) else Fraction(w) for s, w in weights.items()}
    if any(x <= 0 for x in exact.values()):
        raise ValueError("weights must be positive")
    unit = math.lcm(*(x.denominator for x in exact.values()))
    out = {s: int(x * unit) for s, x in exact.items()}
    common = math.gcd(*out.values())
    return {s: x // common for s, x in out.items()}


def target_weights(counts: dict[str, int], flatten: float = FLATTEN, parts: int = PARTS) -> dict[str, int]:
    """The counts to the power `flatten`, as whole numbers from 1; scaled down where their sum exceeds `parts`."""
    flat = {s: n**flatten for s, n in sorted(counts.items()) if n}
    scale = max(1.0, math.fsum(flat.values()) / parts)
    return {s: max(1, math.floor(x / scale + 0.5)) for s, x in flat.items()}


def _frame(v: int, blocks: dict[str, int], weights: dict[str, int]) -> Iterator[tuple[str, int, int, int, int]]:
    """(source, block, release, deadline, slot) of frame v, block and slots counted from its start."""
    left = {s: min(weights[s], blocks[s] - v * weights[s]) for s in weights if blocks[s] > v * weights[s]}
    # within the frame, at time u (0 to 1) source s has min(left, u * weight) blocks done;
    # the slots used are a function of u that bends where a source runs out
    ends = sorted({Fraction(n, weights[s]) for s, n in left.items()})
    done, rate = [], []  # slots used and rate just after the k-th bend, from the start
    for u in [Fraction(0), *ends]:
        over = [s for s, n in left.items() if Fraction(n, weights[s]) <= u and u > 0]
        done.append(sum(left[s] for s in over))
        rate.append(sum(w for s, w in weights.items() if s in left and s not in set(over)))

    def of(s: str) -> Iterator[tuple[int, int]]:
        k, release, w = 0, 0, weights[s]
        for j in range(1, left[s] + 1):
            while k < len(ends) - 1 and j * ends[k].denominator > ends[k].numerator * w:
                k += 1
            used = j * rate[k] + done[k] * w  # times w
            yield release, -(-used // w)
            release = used // w

    each = {s: of(s) for s in left}
    waiting, ready = [(*next(x), s, 0) for s, x in each.items()], []
    heapq.heapify(waiting)
    for slot in range(sum(left.values())):
        while waiting and waiting[0][0] <= slot:
            release, deadline, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, j, release))
        deadline, s, j, release = heapq.heappop(ready)
        assert release <= slot < deadline
        yield s, j, release, deadline, slot
        after = next(each[s], None)
        if after:
            heapq.heappush(waiting, (*after, s, j + 1))


@dataclass
class Run:
    """Frames v_from to v_to - 1, all scheduled like frame v_from, which starts at slot
    `start`; each has `size` slots."""

    v_from: int
    v_to: int
    start: int
    size: int


def runs(blocks: dict[str, int], weights: dict[str, int]) -> list[Run]:
    """All frames until all blocks are placed; one that has the last block of a source is alone."""
    last = sorted({(n - 1) // weights[s] for s, n in blocks.items() if n})
    out, v, start = [], 0, 0

    def add(v_to: int) -> None:
        nonlocal v, start
        size = sum(max(0, min(weights[s], n - v * weights[s])) for s, n in blocks.items())
        out.append(Run(v, v_to, start, size))
        start, v = start + (v_to - v) * size, v_to

    for x in last:
        if v < x:
            add(x)
        add(x + 1)
    return out


def plan(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int, int, int]]:
    """(source, block, release, deadline) of slot 0, 1, ... until all blocks are placed."""
    w = whole({s: x for s, x in weights.items() if blocks.get(s)}) if any(blocks.values()) else {}
    blocks = {s: blocks[s] for s in w}
    for r in runs(blocks, w):
        like = list(_frame(r.v_from, blocks, w))
        for v in range(r.v_from, r.v_to):
            at = r.start + (v - r.v_from) * r.size
            yield from ((s, v * w[s] + j, at + release, at + deadline) for s, j, release, deadline, _ in like)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """docs with mix_source, block, release, deadline, slot and position (long, from 0, gapless).

    Within a source documents go in the order of a seeded hash of doc_id.  weights:
    by source, positive; without them, every source gets target_weights() of the
    document counts, and null is the source ''.  With them, null and the sources that
    they don't name are one source '' of the rest (weighted by '', or as the smallest).
    Every row is placed once; rows whose doc_ids are equal or null are placed in any
    order.  No rows give no rows.  Texts of any length are only carried.  Columns
    named like those that are made, whatever their case, give way.

    A source may hold most of the rows: it is numbered in 4096 ranges of the hash.
    To the driver come the counts by source; back goes the plan (see above), a written
    table that is joined by its keys, and broadcast only where its rows are few (_FEW).
    """
    spark = docs.sparkSession
    given, names = apart(docs, ("doc_id", "source"), OWN, whole=True)
    own = F.coalesce("source", F.lit(""))
    if weights is not None:
        own = F.when(F.col("source").isin([s for s in weights if s]), F.col("source")).otherwise(F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")).cast("binary"))
    hashed = given.select("doc_id", "_row", own.alias("mix_source"), key.alias("_h")).withColumn("_b", F.substring("_h", 1, 3))
    by_range = hashed.groupBy("mix_source", "_b").count()
    counts = {r.mix_source: r.n for r in by_range.groupBy("mix_source").agg(F.sum("count").alias("n")).collect()}
    w = target_weights(counts) if weights is None else whole(({"": min(weights.values(), default=1.0)} | weights)) if weights else {"": 1}
    w = {s: w[s] for s in sorted(counts)}
    blocks = {s: -(-n // block) for s, n in counts.items()}
    number = {s: k for k, s in enumerate(w)}
    short = {s: (-n) % block for s, n in counts.items()}  # rows that the last block lacks
    frames = runs(blocks, w)
    shift = max(0, ((frames[-1].v_to if frames else 1) - 1).bit_length() - _RANGES.bit_length() + 1)

    def slots() -> Iterator[str]:
        lacking = 0
        for k, r in enumerate(frames):
            for s, j, release, deadline, slot in _frame(r.v_from, blocks, w):
                yield f"{k},{number[s]},{j},{release},{deadline},{slot},{lacking}"
                if r.v_from * w[s] + j == blocks[s] - 1:
                    lacking += short[s]

    sources = written(spark, (f"{k},{w[s]},{s.encode().hex()}" for s, k in number.items()), "_s int, _w long, _name string", "sources")
    sources = sources.select("_s", "_w", F.coalesce(F.unhex("_name").cast("string"), F.lit("")).alias("mix_source"))
    ranges = written(spark, (f"{x},{k},{r.v_from},{r.v_to},{r.start},{r.size}" for k, r in enumerate(frames) for x in range(r.v_from >> shift, ((r.v_to - 1) >> shift) + 1)), "_range long, _like int, _from long, _to long, _start long, _size long", "frames")
    placed = written(spark, slots(), "_like int, _s int, _j long, _release long, _deadline long, _slot long, _short long", "slots")
    rows_of = lambda r: sum(max(0, min(w[s], b - r.v_from * w[s])) for s, b in blocks.items())
    few = lambda df, n: F.broadcast(df) if n <= _FEW else df
    sources, ranges, placed = few(sources, len(w)), few(ranges, _RANGES + len(frames)), few(placed, sum(map(rows_of, frames)))
    before = by_range.select("mix_source", "_b", (F.sum("count").over(W.partitionBy("mix_source").orderBy("_b")) - F.col("count")).alias("_before"))
    nth = F.row_number().over(W.partitionBy("mix_source", "_b").orderBy("_h", "doc_id")) - 1
    ranked = hashed.withColumn("_n", nth.cast("long")).join(few(before, len(w) * 16**3), ["mix_source", "_b"]).join(sources, "mix_source")
    ranked = ranked.select("mix_source", "_row", "_s", "_w", (F.col("_n") + F.col("_before")).alias("_n")).withColumn("block", F.floor(F.col("_n") / block))
    ranked = ranked.withColumns({"_v": F.expr("block div _w"), "_j": F.expr("block % _w")}).withColumn("_range", F.shiftright("_v", shift))
    found = ranked.join(ranges, "_range").where("_v >= _from AND _v < _to").withColumn("_at", F.expr("_start + (_v - _from) * _size"))
    out = found.join(placed, ["_like", "_s", "_j"])
    at = lambda c: (F.col("_at") + F.col(c)).alias(c[1:])
    position = (F.col("_at") + F.col("_slot")) * block - F.col("_short") + F.col("_n") % block
    return out.select(*fields(names), "mix_source", "block", at("_release"), at("_deadline"), at("_slot"), position.alias("position"))


def in_order(docs: DataFrame, **given) -> DataFrame:
    """docs, all rows and columns, written in mixed order: the n-th part of the result
    holds the n-th run of positions, sorted.

    No rows give no rows; of columns that differ in case only, the first stays.
    """
    n = docs.count()
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    whole_row, names = apart(docs, ("doc_id", "source"), whole=True)
    mixed = mix(whole_row.withColumnRenamed("_row", "row"), **given)
    dealt = mixed.repartitionById(parts, F.expr(f"CAST(position * {parts} div {max(n, 1)} AS INT)"))
    return dealt.sortWithinPartitions("position").select(*fields(names, "row"))


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block, release, deadline, slot, position of every document."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("doc_id", "source", "block", "release", "deadline", "slot", "position")


#: The same by the definitions: windows from the ideal schedule over all sources, then one
#: slot after another in a recursion.  state holds the next block of each source.
ORACLE_OP6 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS s, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(concat_ws(':', '7', doc_id::VARCHAR)), doc_id) - 1 AS n FROM documents
), c AS (
  SELECT s, count(*) AS rows, pow(count(*)::DOUBLE, {FLATTEN}::DOUBLE) AS flat FROM d GROUP BY s
), w AS (
  SELECT s, (rows + {BLOCK - 1}) // {BLOCK} AS b, greatest(1, floor(flat / greatest(1, (SELECT sum(flat) FROM c) / {PARTS}) + 0.5))::BIGINT AS w, row_number() OVER (ORDER BY s) AS k FROM c
), e AS (
  SELECT a.s, a.k, a.j, any_value(a.w) AS w, sum(least(o.b * a.w, a.j * o.w))::BIGINT AS before, sum(least(o.b * a.w, (a.j + 1) * o.w))::BIGINT AS after
  FROM (SELECT *, unnest(range(b)) AS j FROM w) a CROSS JOIN w o GROUP BY a.s, a.k, a.j
), p AS (
  SELECT s, k, j, before // w AS release, (after + w - 1) // w AS deadline FROM e
), r AS (
  SELECT 0::BIGINT AS slot, (SELECT list(0::BIGINT) FROM w) AS state, 0::BIGINT AS pick, 0::BIGINT AS block
  UNION ALL
  SELECT slot + 1, list_transform(state, lambda x, i: x + (i = pick.k)::BIGINT), pick.k, pick.j
  FROM (SELECT r.slot, r.state, arg_min({{'k': p.k, 'j': p.j}}, (p.deadline, p.s)) AS pick FROM r JOIN p ON p.j = r.state[p.k] AND p.release <= r.slot GROUP BY r.slot, r.state)
), f AS (
  SELECT r.slot - 1 AS slot, p.s, p.j, p.release, p.deadline FROM r JOIN p ON p.k = r.pick AND p.j = r.block WHERE r.slot > 0
)
SELECT d.doc_id, d.source, f.j AS block, f.release, f.deadline, f.slot, row_number() OVER (ORDER BY f.slot, d.n) - 1 AS position
FROM d JOIN f ON f.s = d.s AND f.j = d.n // {BLOCK}
"""
