"""Mixing sources to target weights: Pfair scheduling, native.

Each source's rows form blocks of `block_rows` (of BLOCK_ROWS, or of as many as make MAX_BLOCKS blocks of a corpus that
would have more, if that is not given). A source's due is its share of the slots by weight among the sources
that last, until all its blocks are due; its i-th block has as release time and deadline the slots before which i - 1
and i blocks are due, and each slot of the mix takes the released block with the earliest deadline; at every slot each
source is then within less than one block of its due, also where others end, and no row is dropped or repeated. Every
source is scheduled on its own. The driver works out the slots from numbers of blocks and weights alone, one block of
each source at a time: it holds a record of each source and eight bytes of each block, at most 128 MB by the rule above,
which executors get as a table.
Numbers of blocks come from counts of hash buckets (see common.slots): a source that holds most rows is numbered by
many tasks.

Cases: a null source is a source of its own; sources without a weight share `rest`; columns are not looked at except for
a hash that tells rows apart and orders those of a source; repeated rows are rows of their own; an empty table gives an empty result;
other columns are kept as they are.
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slots

#: Rows of a block, and the number of blocks from which on blocks grow instead.
BLOCK_ROWS, MAX_BLOCKS = 32, 1 << 24
#: Blocks of a row of the table of slots.
TURN_BLOCKS = 1024
#: Slots that are broadcast at most; a longer table is joined by shuffles.
BROADCAST_SLOTS = 10_000_000
#: Rows of a hash bucket, about.
BUCKET_ROWS = 500


@dataclass
class Turn:
    """From block `start` to before `end` the source has these slots of each period of `period` slots from `base` on."""

    source: str
    start: int
    end: int
    base: int
    period: int
    slots: list[int]


def edf(blocks: dict[str, int], weights: dict[str, float]) -> dict[str, array]:
    """The slots of each source's blocks, from 0 on without gaps: earliest deadline first among released blocks."""
    names = sorted(s for s, n in blocks.items() if n)
    many, w = [blocks[s] for s in names], [weights[s] for s in names]
    # Until "time" n / w of a source all its blocks are due; by time v, done[k] + v * rate[k] are due in all, where k sources have ended.
    order = sorted(range(len(names)), key=lambda j: many[j] / w[j])
    ends = [many[j] / w[j] for j in order]
    done = [0, *accumulate(many[j] for j in order)]
    rate = [0.0, *accumulate(w[j] for j in reversed(order))][::-1]
    total = done[-1]
    near = 1e-9 + 1e-13 * total  # of rounding errors

    def due(j: int, i: int) -> float:
        v = i / w[j]
        k = bisect_left(ends, v)
        return done[k] + v * rate[k]

    out = [array("q") for _ in names]
    waiting = [(0, j) for j in range(len(names))]  # release times of each source's next block
    ready: list[tuple[int, bool, float, int]] = []
    for t in range(total):
        while waiting and (waiting[0][0] <= t or not ready):
            _, j = heapq.heappop(waiting)
            end = due(j, len(out[j]) + 1)
            deadline = math.ceil(end - near)
            # Among equal deadlines first the block whose window overlaps the next one's, then the heavier source.
            heapq.heappush(ready, (deadline, deadline - end <= near, -w[j], j))
        *_, j = heapq.heappop(ready)
        out[j].append(t)
        if len(out[j]) < many[j]:
            heapq.heappush(waiting, (math.floor(due(j, len(out[j])) + near), j))
    return dict(zip(names, out))


def edf_period(weights: dict[str, int]) -> list[str]:
    """The sources of the slots of one period, sum(weights) long, in which each source has as many blocks as it weighs."""
    at = {t: s for s, own in edf(weights, weights).items() for t in own}
    return [at[t] for t in range(len(at))]


def make_turns(blocks: dict[str, int], weights: dict[str, float]) -> list[Turn]:
    """Turns of all blocks of each source, TURN_BLOCKS in each but its last one."""
    return [Turn(s, i, i + len(own), 0, 0, own) for s, at in edf(blocks, weights).items() for i in range(0, len(at), TURN_BLOCKS) for own in [at[i : i + TURN_BLOCKS].tolist()]]


def scheduled(docs: DataFrame, weights: dict[str, float] | None = None, *, temperature: float = 0.5, rest: float | None = None, block_rows: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`__row` (a row of docs as a struct), its block and its position.

    weights: target weights of sources; without them a source weighs its number of rows to the power of temperature.
    Sources not in weights are one stream, which weighs `rest`, or as much as its rows do among all.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("null"))
    sizes = docs.groupBy(named.alias("s")).count()
    total = sizes.agg(F.sum("count")).first()[0] or 0
    block_rows = block_rows or max(BLOCK_ROWS, math.ceil(total / MAX_BLOCKS))
    known = {f"={s}": w for s, w in weights.items()} if weights else None
    top = sizes.where(F.col("s").isin(list(known))) if known else sizes
    counts = {r["s"]: r["count"] for r in top.collect()}
    own = {s: known[s] if known else n**temperature for s, n in counts.items()}
    if other := total - sum(counts.values()):
        counts["rest"] = other
        own["rest"] = rest if rest is not None else (sum(own.values()) * other / max(1, total - other) if own else 1.0)
    stream = F.when(named.isin(list(known)), named).otherwise(F.lit("rest")) if known else named
    least = min((w for w in own.values() if w > 0), default=1.0)  # a source without weight comes after the others
    turns = make_turns({s: math.ceil(n / block_rows) for s, n in counts.items()}, {s: w if w > 0 else least * 1e-9 for s, w in own.items()})

    buckets = max(1, math.ceil(total / BUCKET_ROWS))
    told_apart = [id_col, text_col, *(f"`{f.name}`" for f in docs.schema.fields if f.name not in (id_col, text_col) and not re.search("map<|variant", f.dataType.simpleString()))]
    # The row travels as a struct, so that no column of its own can clash.
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), stream.alias("__stream"), F.xxhash64(*told_apart).alias("__hash"))
    keyed = keyed.withColumn("__bucket", F.pmod(F.xxhash64("__hash"), F.lit(buckets)))
    ranked = slots(keyed, "__stream", "__bucket", ["__hash"], "__rank")
    ranked = ranked.withColumn("block", F.floor(F.col("__rank") / block_rows))
    kinds = {"__s": pa.string(), "__turn": pa.int64(), "__slots": pa.list_(pa.int64())}
    columns = [[t.source for t in turns], [t.start // TURN_BLOCKS for t in turns], [t.slots for t in turns]]
    table = docs.sparkSession.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds)))
    # A row of at most TURN_BLOCKS slots for each source and turn.
    table = F.broadcast(table) if sum(len(t.slots) for t in turns) <= BROADCAST_SLOTS else table
    turn = F.floor(F.col("block") / TURN_BLOCKS)
    joined = ranked.join(table, (F.col("__stream") == F.col("__s")) & (turn == F.col("__turn")))
    # Null beyond the end: a filter on the position may come before the join.
    slot = F.get("__slots", F.pmod("block", F.lit(TURN_BLOCKS)).cast("int"))
    # Slots are gapless; a source's last block may be short and leaves a gap behind it.
    return joined.select("__row", "block", (slot * block_rows + F.col("__rank") % block_rows).alias("position"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, **kw) -> DataFrame:
    """The rows of docs with `block` (of its source) and `position` (long, from 0; the order of the mix), which replace
    columns of these names. For the arguments see scheduled()."""
    kept = [F.col(f"__row.`{c}`") for c in docs.columns if c not in ("block", "position")]
    return scheduled(docs, weights, **kw).select(*kept, "block", "position")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, **kw) -> DataFrame:
    """The rows and columns of docs, dealt to partitions by the mix's order and sorted by it, so that files follow it."""
    out = scheduled(docs, weights, **kw)
    return out.repartitionByRange("position").sortWithinPartitions("position").select("__row.*")


def mixing_report(docs: DataFrame, **kw) -> DataFrame:
    out = mix(docs.select("doc_id", F.xxhash64("text").alias("text"), "source"), **kw)
    return out.select("doc_id", "source", "block", "position")
