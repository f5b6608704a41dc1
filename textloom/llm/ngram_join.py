"""N-gram Jaccard join in the metric space of shingle sets: an exact self-join, given as numbers of links and components.

Regions of two kinds of pivots follow each other.

1. Pivots that are single shingles, as one-element sets. Distances between unrelated texts are exactly 1, so that a
   window around a few documents would leave nothing out; a document's nearest such pivots are its own shingles, and the
   first in one order for all documents, rarer ones first, is its region. By the triangle inequality of the symmetric
   difference a text within the distance lacks at most a quarter of a set's shingles: a document is replicated to the
   regions of the first quarter of its shingles and no further, and each linked pair meets in the region of its first
   common shingle. A region keeps one summary for the sets of a task that crowd in it, so that no task holds it whole.
2. Pivots that are documents. Each region names one, and each set goes to the cell of a pivot that it links with, its
   exact distance kept; what links with none is a cell of its own. Two cells are compared only where they meet in a
   region and the window of the triangle inequality around both pivots, widened by the cells' radii, allows a link
   (bitmaps bound the distance of pivots from below). The sets of the smaller one then visit the larger.
3. Within a cell, members that are together no farther from the pivot than the distance of a link do link, and need no
   comparison; those whose distances differ by more do not. What is left open is compared on whole sets, in blocks: a
   block of members meets a part of the visitors.

Links are counted, not listed: a row of the result has the number of rows it links with. Counting them in a cell of
many different texts that are all far from its pivot takes a comparison of each with each, in tasks of bounded size.
Documents with equal sets are one node from the start. Shingles are known by 64-bit hashes, sets by 64 bits of a digest
of these. The order comes from counts of all shingles in a fixed number of slots (SLOTS), so that what is broadcast has
one size for any corpus.

Cases: null and empty texts and texts without words have an empty set and link with nothing; texts with fewer words
than n have one shingle; rows of equal text link; a row with a null id links with nothing and has no component; long
texts are taken whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import frozen, release

SLOTS = 1 << 20
BLOCKS = 64
#: Bytes of text whose shingles are held at a time.
SEGMENT = 2 << 20
#: Sets that ask one pivot, or visit one block of a cell, together.
ASK_ROWS, VISIT_ROWS = 500, 1000
#: Rows of regions that a task looks at together, and sets of one region among them that travel apart from it.
SEGMENT_ROWS, HOT_ROWS = 1_000_000, 64
#: Shingles of the members of a cell that are in one block.
BLOCK_TOKENS = 100_000
#: Places that one row asks a set for, and bytes of a set that are written at a time.
LIST_ROWS, SENT_BYTES = 500, 4 << 20
#: Of distances in floating point: what is this near to a bound is compared exactly.
SLACK = 1e-9

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


@cache
def _random(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def shingle_sets(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, one text after the other; where each text's begin, with an end)."""
    data = _lower()[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    powers = np.full(len(data), _ODD, dtype=np.uint64)
    powers[:1] = 1
    powers = np.cumprod(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_random(1, 256)[data] * powers)])
    # A word's polynomial, shifted to where a word at 0 would stand.
    down = np.full(len(data), _INVERSE, dtype=np.uint64)
    down[:1] = 1
    down = np.cumprod(down)
    words = _mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(_ODD))
    first = np.searchsorted(start, begins)  # of each text's words
    many = np.diff(first)
    grams = np.where(many >= n, many - n + 1, np.minimum(many, 1))
    owner = np.repeat(np.arange(len(texts)), grams)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams) + first[owner]
    size = np.minimum(many, n)[owner]
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    out = size.astype(np.uint64)
    for i in range(n):
        out += np.where(i < size, padded[at + i], np.uint64(0)) * _random(2, n)[i]
    out = _mix(out)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parities of the numbers of tokens with each remainder by 64, 128, 256 ...: for up to 256 tokens the first of these
    not below four times the size, for up to 1024 not below twice, and for more not below it (nor below 2048).

    Two bitmaps of one length differ in no more bits than their sets in tokens; the halves of a bitmap, xor-ed, are the
    bitmap of half the length.
    """
    n = len(tokens)
    n = 4 * n if n <= 256 else max(1024, 2 * n) if n <= 1024 else max(2048, n)
    size = 64 << max(0, (n - 1).bit_length() - 6)
    bits = np.bincount((tokens >> np.uint64(20)) & np.uint64(size - 1), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def _texts(batches: Iterator[pa.RecordBatch], most: int = SEGMENT) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for b in batches:
        step = max(1, int(b.num_rows * most / max(1, b.column("text").get_total_buffer_size())))
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            yield part, [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()]


def may_link(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can link."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def shingle_components(docs: DataFrame, *, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, n_links (with how many other rows it links) for each row of docs; two rows link
    if 100 * |a & b| >= percent * |a | b|."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    surveyed = frozen(_survey(rows, n))
    classes = _slot_classes(surveyed)
    # One node per set. rep: the smallest id that has it; copies: how many rows; rows without an id are no nodes.
    known = surveyed.where("block is null")
    nodes = frozen(known.where("n > 0 and id is not null").groupBy("sid", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("map").alias("map")))
    n_nodes = nodes.count()
    members = frozen(_members(_regions(rows, classes, n, percent)))
    release(docs, n_nodes)
    homes = frozen(_homes(rows, members, nodes, n, percent))
    cells = frozen(_cells(homes, nodes, percent))
    release(docs, n_nodes)
    visits = frozen(_visits(members, homes, cells, nodes, percent))
    release(docs, n_nodes)
    found = frozen(_compared(rows, visits, homes, cells, nodes, n, percent))
    release(docs, n_nodes)

    # Members of a cell hang together by its pivot, and a pivot that lives in another cell by that cell's.
    crossing = found.where("host is not null").join(homes.select("sid", "cell"), "sid").select(F.col("cell").alias("a"), F.col("host").alias("b")).where("a <> b").distinct()
    moved = cells.select(F.col("cell").alias("a")).join(homes.select(F.col("sid").alias("a"), F.col("cell").alias("b")), "a").where("a <> b")
    parts = components(crossing.unionByName(moved).distinct())
    counted = found.groupBy("sid").agg(F.sum("links").alias("links"))
    # Any two members within half the distance of the pivot link.
    near = F.when(F.col("dist") <= _half(percent), F.col("core") - F.col("copies")).otherwise(0)
    inside = homes.join(cells.select("cell", "core"), "cell").select("sid", "cell", near.alias("near"))
    inside = inside.join(counted, "sid", "left").join(parts.withColumnRenamed("sid", "cell"), "cell", "left")
    reps = nodes.select("sid", "rep", "copies").join(inside, "sid", "left").withColumn("part", F.coalesce("part", "cell", "sid"))
    reps = reps.withColumn("n_links", F.col("copies") - 1 + F.coalesce("near", F.lit(0)) + F.coalesce("links", F.lit(0)))
    reps = frozen(reps.select("sid", "rep", "part", "n_links"))
    least = reps.groupBy("part").agg(F.min("rep").alias("component_id"))
    final = frozen(reps.join(least, "part").select("sid", "component_id", "n_links"))
    release(docs, n_nodes)
    out = known.join(final, "sid", "left")
    named = F.col("id").isNotNull()
    mine = F.when(named, F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), mine.alias("component_id"), F.when(named, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def _far(percent: int) -> float:
    """The greatest distance of a link."""
    return 1 - percent / 100


def _half(percent: int) -> float:
    return _far(percent) / 2 - SLACK


def _survey(rows: DataFrame, n: int) -> DataFrame:
    """A row per document (id, sid, n, bitmap), and per task and block of slots the counts of its sets' shingles."""
    names = ["id", "sid", "n", "map", "block", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(SLOTS, np.int64), set()
        for part, texts in _texts(batches):
            tokens, cut = shingle_sets(texts, n)
            sids, maps, new = np.empty(len(texts), np.int64), [], np.zeros(len(texts), bool)
            for i in range(len(texts)):
                own = tokens[cut[i] : cut[i + 1]]
                sids[i] = set_id(own)
                maps.append(bitmap(own))
                new[i] = sids[i] not in seen
                seen.add(sids[i])
            counts += np.bincount(tokens[np.repeat(new, np.diff(cut))] & np.uint64(SLOTS - 1), minlength=SLOTS)
            none = [pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sids), pa.array(np.diff(cut)), pa.array(maps, pa.list_(pa.int64())), *none], names)
        if seen:
            blocks = [x.tobytes() for x in counts.reshape(BLOCKS, -1)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(BLOCKS, pa.int64())] * 3, pa.nulls(BLOCKS, pa.list_(pa.int64())), pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(blocks, pa.binary())], names)

    return rows.mapInArrow(run, "id long, sid long, n long, map array<long>, block int, counts binary")


def _slot_classes(surveyed: DataFrame) -> np.ndarray:
    """The frequency class of each slot: 0 up to what chance explains, then the logarithm of the count."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}  # one array per block, however many tasks counted
        for b in batches:
            for block, counts in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, dtype=np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["block", "counts"])

    blocks = surveyed.where("block is not null").select("block", "counts").repartition(BLOCKS, "block").mapInArrow(total, "block int, counts binary").collect()
    counts = np.zeros((BLOCKS, SLOTS // BLOCKS), np.int64)
    for r in blocks:
        counts[r["block"]] = np.frombuffer(bytes(r["counts"]), dtype=np.int64)
    counts = counts.reshape(-1)
    mean = counts.mean()
    extra = counts - mean - 6 * np.sqrt(mean) - 4
    return np.where(extra > 0, 1 + np.log2(np.maximum(counts - mean, 1)), 0).astype(np.uint8)


#: Kinds of rows of _regions.
ROW, SUMMARY, HELD = 0, 1, 2


def _regions(rows: DataFrame, classes: np.ndarray, n: int, percent: int) -> DataFrame:
    """Each set in the regions of its first shingles: h, sid and code, which holds place, share, core and kind.

    ROW: place is the shingle's number in the set's order, from 0; share thousandths of the set's shingles that are
    frequent; core whether the set can be the smaller one of a pair that meets here. Where many sets of one segment of a
    task are in a region, the segment gives a SUMMARY, the row that would be the pivot, under the segment's number seg;
    the sets themselves are HELD rows, dealt out by salt.
    """
    names = ["h", "salt", "sid", "code", "seg"]
    hot_rows, segment_rows = HOT_ROWS, SEGMENT_ROWS

    def given(h, salt, sid, place, share, core, kind, seg) -> Iterator[pa.RecordBatch]:
        code = ((share.astype(np.int64) * 2 + core) * 4 + kind) << 32 | place.astype(np.int64)
        for i in range(0, len(h), 200_000):
            s = slice(i, i + 200_000)
            columns = [(h, np.int64), (salt, np.int16), (sid, np.int64), (code, np.int64)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[s].astype(k)) for x, k in columns), pa.array(np.full(len(h[s]), seg), mask=kind[s] == ROW)], names)

    def segment(held: list[tuple], seg: int) -> Iterator[pa.RecordBatch]:
        h, sid, size, place, share = (np.concatenate(x) for x in zip(*held))
        core = place <= size - -(-2 * percent * size // (100 + percent))
        order = np.lexsort((sid, -share, h))  # a region's pivot comes first
        cut = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        many = np.diff(np.append(cut, len(h)))
        crowded = many >= hot_rows
        hot = np.zeros(len(h), bool)
        hot[order] = np.repeat(crowded, many)
        # In the order of documents: a document's rows compress well side by side.
        yield from given(h, np.where(hot, 1 + (sid & 63), 0), sid, place, share, core, np.where(hot, HELD, ROW), seg)
        if crowded.any():
            top = order[cut[crowded]]
            any_core = np.logical_or.reduceat(core[order], cut)[crowded]
            yield from given(h[top], np.zeros(len(top)), sid[top], place[top], share[top], any_core, np.full(len(top), SUMMARY), seg)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, many, seg = [], 0, TaskContext.get().partitionId() << 24
        for part, texts in _texts(batches):
            tokens, cut = shingle_sets(texts, n)
            sizes = np.diff(cut)
            sids = np.array([set_id(tokens[cut[i] : cut[i + 1]]) for i in range(len(texts))], dtype=np.int64)
            new = sizes > 0
            for i in range(len(texts)):
                new[i] &= sids[i] not in seen
                seen.add(int(sids[i]))
            owner = np.repeat(np.arange(len(texts)), sizes)
            kind = classes[tokens & np.uint64(SLOTS - 1)]
            share = 1000 * np.bincount(owner, weights=kind > 0, minlength=len(texts)).astype(np.int64) // np.maximum(sizes, 1)
            order = np.lexsort((tokens, kind, owner))
            place = np.arange(len(tokens)) - cut[:-1][owner]
            # A linked set has ceil(percent / 100 * size) of these shingles at least.
            window = sizes - -(-percent * sizes // 100) + 1
            pick = new[owner] & (place < window[owner])
            own = owner[pick]
            held.append((tokens[order][pick].view(np.int64), sids[own], sizes[own].astype(np.int32), place[pick].astype(np.int32), share[own].astype(np.int16)))
            many += len(own)
            if many >= segment_rows:
                yield from segment(held, seg)
                held, many, seg = [], 0, seg + 1
        if many:
            yield from segment(held, seg)

    return rows.where("id is not null").select("text").mapInArrow(run, "h long, salt short, sid long, code long, seg long")


def _members(regions: DataFrame) -> DataFrame:
    """(h, sid, place, pivot, rank) of the sets in regions where a pair can meet.

    A region's pivot is the set with the largest share of frequent shingles: of a large group of edited copies the text
    that they come from, near all of them. A region comes together from rows and summaries, however many sets it has.
    """
    upper = F.shiftright("code", 32)
    kind, core, share = upper.bitwiseAND(3), F.shiftright(upper, 2).bitwiseAND(1), F.shiftright(upper, 3)
    w = Window.partitionBy("h", "salt")
    seen = regions.withColumns({"lo": F.min("sid").over(w), "hi": F.max("sid").over(w), "hot": F.max(kind).over(w) == SUMMARY, "any": F.max(core).over(w) == 1, "top": F.min(F.struct((-share).alias("share"), F.col("sid"))).over(w)})
    met = seen.where((kind == HELD) | ((F.col("lo") != F.col("hi")) | F.col("hot")) & F.col("any"))
    place = F.col("code").bitwiseAND(0xFFFFFFFF).cast("int").alias("place")
    met = frozen(met.select("h", kind.cast("byte").alias("kind"), "seg", "sid", place, F.col("top.sid").alias("pivot"), (-F.col("top.share")).cast("short").alias("rank")))
    rows = met.where(F.col("kind") == ROW).select("h", "sid", "place", "pivot", "rank")
    tops = met.where(F.col("kind") == SUMMARY).select("h", "seg", "pivot", "rank")
    held = met.where(F.col("kind") == HELD).select("h", "seg", "sid", "place").join(tops, ["h", "seg"])
    return rows.unionByName(held.drop("seg")).distinct()


def _bits_apart(a: Column, b: Column) -> Column:
    """A lower bound of |a ^ b| from bitmaps; 0 where they can't be compared."""
    least = F.least(F.size(a), F.size(b))

    def folded(x: Column) -> Column:
        halves = F.zip_with(F.slice(x, F.lit(1), least), F.slice(x, least + 1, least), lambda y, z: y.bitwiseXOR(z))
        return F.when(F.size(x) > least, halves).otherwise(x)

    differ = F.aggregate(F.zip_with(folded(a), folded(b), lambda y, z: F.bit_count(y.bitwiseXOR(z))), F.lit(0), lambda y, z: y + z)
    return F.when(F.greatest(F.size(a), F.size(b)) > 2 * least, F.lit(0)).otherwise(differ)


def _within(map_a: Column, map_b: Column, n_a: Column, n_b: Column, distance: Column) -> Column:
    """Whether sets with these bitmaps and sizes may be within the distance: |a ^ b| = x makes it 2x / (|a| + |b| + x)."""
    apart = F.greatest(_bits_apart(map_a, map_b), F.abs(n_a - n_b))
    return 2 * apart <= (distance + SLACK) * (n_a + n_b + apart)


def _homes(rows: DataFrame, members: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """(sid, n, copies, cell, dist): each set in the cell of a pivot within the distance of a link, or in its own.

    Of its regions' pivots that bitmaps allow a set asks the first, by share; dist is the exact distance.
    """
    asks = members.where("pivot <> sid").select(F.col("pivot").alias("a"), F.col("sid").alias("b"), "rank").distinct()
    one, two = (nodes.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("map").alias(f"m{x}")) for x in ("a", "b"))
    able = asks.join(two, "b").join(one, "a").where(may_link(F.col("na"), F.col("nb"), percent))
    able = able.where(_within(F.col("ma"), F.col("mb"), F.col("na"), F.col("nb"), F.lit(_far(percent))))
    first = frozen(able.groupBy("b").agg(F.min_by("a", F.struct(-F.col("rank"), "a")).alias("a")))
    tasks = first.groupBy("a").agg(F.ceil(F.count("*") / ASK_ROWS).cast("int").alias("blocks"))
    none = F.lit(0.0).alias("dist"), F.lit(0).cast("long").alias("copies")
    visitors = first.join(tasks, "a").select(F.col("b").alias("sid"), _to("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"), VISITOR, *none))
    pivots = tasks.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(F.col("a").alias("sid"), _to("a", F.col("block"), PIVOT, *none))
    found = _met(rows, visitors.unionByName(pivots), nodes, n, _attach(percent), "sid long, cell long, dist double")
    every = members.select("sid").distinct().join(nodes.select("sid", "n", "copies"), "sid").join(found, "sid", "left")
    return every.select("sid", "n", "copies", F.coalesce("cell", "sid").alias("cell"), F.coalesce("dist", F.lit(0.0)).alias("dist"))


def _cells(homes: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of each cell: its number of sets, their least and greatest size and sum of sizes, its radius, the rows within
    half the distance of a link, and the pivot's size and bitmap."""
    core = F.sum(F.when(F.col("dist") <= _half(percent), F.col("copies")).otherwise(0))
    cells = homes.groupBy("cell").agg(F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("tokens"), F.max("dist").alias("radius"), core.alias("core"))
    return cells.join(nodes.select(F.col("sid").alias("cell"), F.col("n").alias("pivot_n"), F.col("map").alias("pivot_map")), "cell")


def _visits(members: DataFrame, homes: DataFrame, cells: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(sid, host, dist): the sets that must be compared with the members of a cell. Of two cells the larger is host.

    dist: of a cell's own members that are farther from the pivot than half the distance of a link; else null.
    """
    far = _far(percent)
    slack = F.max(100 * F.col("n") - (100 + percent) * F.col("place"))
    here = members.join(homes.select("sid", "cell", "n"), "sid").groupBy("h", "cell").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), slack.alias("slack"))
    here = here.withColumn("others", F.count("*").over(Window.partitionBy("h"))).where("others > 1").drop("others")
    here = here.join(cells.select("cell", "size", "radius", "pivot_n", "pivot_map"), "cell")
    one, two = (here.select("h", *(F.col(c).alias(f"{c}{i}") for c in here.columns if c != "h")) for i in (1, 2))
    rule = F.struct("size1", "cell1") < F.struct("size2", "cell2")
    rule = rule & (F.col("hi1") * 100 >= F.col("lo2") * percent) & (F.col("hi2") * 100 >= F.col("lo1") * percent)
    # All that a pair has in common stands no earlier than its first common shingle.
    rule = rule & (F.col("slack1") >= F.col("lo2") * percent) & (F.col("slack2") >= F.col("lo1") * percent)
    # The window of the triangle inequality between pivots, widened by both radii.
    rule = rule & _within(F.col("pivot_map1"), F.col("pivot_map2"), F.col("pivot_n1"), F.col("pivot_n2"), far + F.col("radius1") + F.col("radius2"))
    pairs = one.join(two, "h").where(rule).select(F.col("cell1").alias("cell"), "size1", F.col("cell2").alias("host")).distinct()
    alone = pairs.where("size1 = 1").join(homes.where("dist = 0").select("sid", "cell"), "cell").select("sid", "host")
    crowd = pairs.where("size1 > 1").join(homes.select("sid", "cell", "n"), "cell").join(nodes.select("sid", "map"), "sid")
    hosts = cells.select(F.col("cell").alias("host"), "least", "most", "radius", "pivot_n", "pivot_map")
    crowd = crowd.join(hosts, "host").where((F.col("n") * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= F.col("n") * percent))
    crowd = crowd.where(_within(F.col("map"), F.col("pivot_map"), F.col("n"), F.col("pivot_n"), far + F.col("radius"))).select("sid", "host")
    # size 1 and a pivot elsewhere: the cell's only member is not its pivot.
    lone = pairs.where("size1 = 1").join(homes.where("dist > 0").select("sid", "cell"), "cell").select("sid", "host")
    others = alone.unionByName(lone).unionByName(crowd).select("sid", "host", F.lit(None).cast("double").alias("dist"))
    shell = homes.where(F.col("dist") > _half(percent)).join(cells.where("size > 1").select("cell"), "cell")
    return others.unionByName(shell.select("sid", F.col("cell").alias("host"), "dist"))


#: Roles in a task of _met.
PIVOT, MEMBER, VISITOR, OWN = 0, 1, 2, 3


def _to(host: str, block: Column, role: int, dist: Column, copies: Column) -> Column:
    return F.struct(F.col(host).alias("host"), block.alias("block"), F.lit(role).cast("byte").alias("role"), dist.alias("dist"), copies.alias("copies")).alias("to")


def _compared(rows: DataFrame, visits: DataFrame, homes: DataFrame, cells: DataFrame, nodes: DataFrame, n: int, percent: int) -> DataFrame:
    """(sid, links, host): numbers of rows that a set links with; host: a cell that a visitor is linked to, null of members.

    A host's members are dealt over blocks of about BLOCK_TOKENS shingles, its visitors over parts of about VISIT_ROWS
    sets; each block meets each part in a task of its own.
    """
    hosts = visits.groupBy(F.col("host").alias("cell")).agg(F.ceil(F.count("*") / VISIT_ROWS).cast("int").alias("parts"))
    hosts = hosts.join(cells.select("cell", "tokens", "size"), "cell")
    hosts = frozen(hosts.select("cell", "size", "parts", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int").alias("blocks")))
    number = F.col("block") * F.col("parts") + F.col("part")
    blocks, parts = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("blocks", "parts"))
    dealt = lambda c: F.pmod(F.xxhash64("sid"), F.col(c)).cast("int")
    own = homes.join(hosts, "cell").withColumn("block", dealt("blocks")).withColumn("part", parts)
    own = own.select("sid", _to("cell", number, MEMBER, F.col("dist"), F.col("copies")))
    none = F.lit(0.0), F.lit(0).cast("long")
    pivots = hosts.where("size > 1").withColumn("block", blocks).withColumn("part", parts).select(F.col("cell").alias("sid"), _to("cell", number, PIVOT, *none))
    guests = visits.join(nodes.select("sid", "copies"), "sid").join(hosts.select(F.col("cell").alias("host"), "blocks", "parts"), "host")
    guests = guests.withColumn("part", dealt("parts")).withColumn("block", blocks)
    strangers = guests.where("dist is null").select("sid", _to("host", number, VISITOR, F.lit(0.0), F.col("copies")))
    shell = guests.where("dist is not null").select("sid", _to("host", number, OWN, F.col("dist"), F.col("copies")))
    asked = own.unionByName(pivots).unionByName(strangers).unionByName(shell)
    return _met(rows, asked, nodes, n, _count(percent), "sid long, links long, host long")


def _met(rows: DataFrame, asked: DataFrame, nodes: DataFrame, n: int, compare, schema: str) -> DataFrame:
    """What compare gives for asked: rows (sid, to), the sets that go to a block of a host.

    The sets are made again from the texts of the documents concerned. A set that is asked for in many places is made
    in several tasks, for about LIST_ROWS of them in each.
    """
    asked = frozen(asked)
    many = asked.groupBy("sid").agg(F.ceil(F.count("*") / LIST_ROWS).cast("int").alias("parts")).where("parts > 1")
    spread = asked.join(many, "sid", "left").withColumn("part", F.pmod(F.xxhash64("to.host", "to.block"), F.coalesce("parts", F.lit(1))))
    lists = spread.groupBy("sid", "part").agg(F.collect_list("to").alias("to")).join(nodes.select("sid", "rep"), "sid")
    found = rows.join(lists, F.col("id") == F.col("rep")).select("sid", "to", "text")
    names = ["host", "block", "role", "dist", "copies", "sid", "tokens"]
    kinds = dict(zip(names, (pa.int64(), pa.int32(), pa.int8(), pa.float64(), pa.int64())))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            tokens, cut = shingle_sets(texts, n)
            sids = part.column("sid").to_pylist()
            for i, to in enumerate(part.column("to").to_pylist()):
                own = tokens[cut[i] : cut[i + 1]]
                if set_id(own) != sids[i]:
                    continue  # another row with the same id
                blob = own.tobytes()
                step = max(1, SENT_BYTES // len(blob))
                for k in range(0, len(to), step):
                    t = to[k : k + step]
                    yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in t], kind) for c, kind in kinds.items()), pa.array([sids[i]] * len(t), pa.int64()), pa.array([blob] * len(t), pa.binary())], names)

    sent = found.mapInArrow(sets, "host long, block int, role byte, dist double, copies long, sid long, tokens binary")
    return sent.repartition("host", "block").sortWithinPartitions("host", "block", "role", "sid").mapInArrow(compare, schema)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a):
        return 0
    return int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(host, block, role, sid, dist, copies, set) of sorted rows; rows that come twice, from repeated documents, once."""
    last = None
    for b in batches:
        for *key, dist, copies, blob in zip(*(b.column(c).to_pylist() for c in ("host", "block", "role", "sid", "dist", "copies", "tokens"))):
            if key != last:
                last = key
                yield *key, dist, copies, np.frombuffer(blob, dtype=np.uint64)


def _attach(percent: int):
    """compare of _homes: the visitors within the distance of a link from the pivot, with their distance."""

    def given(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["sid", "cell", "dist"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, left, out = None, np.zeros(0, np.uint64), []
        for host, block, role, sid, _, _, right in _rows_of(batches):
            if role == PIVOT:
                key, left = (host, block), right
            elif key == (host, block):
                common = _common(left, right)
                both = len(left) + len(right) - common
                if 100 * common >= percent * both:
                    out.append((sid, host, 1 - common / both))
            if len(out) >= 10_000:
                yield given(out)
                out = []
        yield given(out)

    return compare


class _Block:
    """The members of one block of a cell, and its pivot."""

    def __init__(self, host: int, percent: int):
        self.host, self.percent = host, percent
        self.pivot: np.ndarray | None = None
        self.sids: list[int] = []
        self.dists: list[float] = []
        self.copies: list[int] = []
        self.sets: list[np.ndarray] = []
        self.ready = False

    def index(self) -> None:
        self.ready = True
        self.sid, self.dist, self.copy = np.array(self.sids, np.int64), np.array(self.dists), np.array(self.copies, np.int64)
        self.size = np.array([len(x) for x in self.sets], np.int64)
        self.credit = np.zeros(len(self.sids), np.int64)
        if len(self.sets) > 1:
            tokens = np.concatenate(self.sets)
            order = np.argsort(tokens, kind="stable")
            self.owner = np.repeat(np.arange(len(self.sets)), self.size)[order]
            self.token, self.start = np.unique(tokens[order], return_index=True)
            self.start = np.append(self.start, len(tokens))

    def common(self, right: np.ndarray) -> np.ndarray:
        if len(self.sets) == 1:
            return np.array([_common(self.sets[0], right)])
        at = np.minimum(np.searchsorted(self.token, right), len(self.token) - 1)
        at = at[self.token[at] == right]
        begin, many = self.start[at], self.start[at + 1] - self.start[at]
        if not len(at):
            return np.zeros(len(self.sets), np.int64)
        places = np.arange(many.sum()) + np.repeat(begin - np.cumsum(many) + many, many)
        return np.bincount(self.owner[places], minlength=len(self.sets))

    def visit(self, sid: int, right: np.ndarray, own: bool, dist: float, copies: int) -> int:
        """The rows that a visitor links with; members are credited with the visitor's."""
        far, half = _far(self.percent), _half(self.percent)
        open_ = np.ones(len(self.sids), bool)
        if own:  # pairs of the core are known; a pair beyond it is looked at once
            open_ = (self.sid != sid) & ((self.dist <= half) | (self.sid < sid))
        linked = np.zeros(len(self.sids), bool)
        if self.pivot is not None:
            if not own:
                common = _common(self.pivot, right)
                dist = 1 - common / (len(self.pivot) + len(right) - common)
            open_ &= np.abs(self.dist - dist) <= far + SLACK
            linked = open_ & (self.dist + dist <= far - SLACK)
            open_ &= ~linked
        if open_.any():
            common = self.common(right)
            linked |= open_ & (100 * common >= self.percent * (self.size + len(right) - common))
        self.credit[linked] += copies
        return int(self.copy[linked].sum())


def _count(percent: int):
    """compare of _compared."""

    def given(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], ["sid", "links", "host"])

    def closed(block: _Block | None) -> list[tuple]:
        if block is None or not block.ready:
            return []
        return [(int(s), int(c), None) for s, c in zip(block.sid, block.credit) if c]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, out = None, None, []
        for host, number, role, sid, dist, copies, right in _rows_of(batches):
            if key != (host, number):
                out += closed(block)
                key, block = (host, number), _Block(host, percent)
            if role == PIVOT:
                block.pivot = right
            elif role == MEMBER:
                block.sids.append(sid)
                block.dists.append(dist)
                block.copies.append(copies)
                block.sets.append(right)
            elif block.sids:
                if not block.ready:
                    block.index()
                if links := block.visit(sid, right, role == OWN, dist, copies):
                    out.append((sid, links, None if role == OWN else host))
            if len(out) >= 10_000:
                yield given(out)
                out = []
        yield given(out + closed(block))

    return compare


def components(links: DataFrame) -> DataFrame:
    """(sid, part) of each node of links (a, b): part is the smallest node that links lead to.

    Labels go along links and jump to their labels' labels; each round's labels are kept in the shared folder.
    """
    both = frozen(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = frozen(both.groupBy(F.col("a").alias("sid")).agg(F.least(F.min("b"), F.first("a")).alias("part")))
    while True:
        near = both.join(labels, F.col("b") == F.col("sid")).groupBy("a").agg(F.min("part").alias("other"))
        step = labels.join(near, F.col("sid") == F.col("a")).select("sid", F.least("part", "other").alias("new"), "part")
        up = labels.select(F.col("sid").alias("at"), F.col("part").alias("top"))
        moved = frozen(step.join(up, F.col("new") == F.col("at"), "left").select("sid", F.least("new", F.coalesce("top", "new")).alias("part"), (F.least("new", F.coalesce("top", "new")) != F.col("part")).alias("moved")))
        labels = moved.select("sid", "part")
        if not moved.where("moved").limit(1).count():
            return labels
