"""Suffix-array dedup: repeated byte strings across documents, with deep-shallow suffix sorting.

A byte is removed if a string of `length` bytes that covers it also starts in a document with a smaller id. Suffixes
are sorted only at anchors: of the k-byte strings in each window of `length` bytes, the one with the least hash. Equal
windows have equal anchors at equal places, so that every match has an anchor in common, and about one suffix in
fourteen is looked at.

1. Each input split keeps one row per anchor hash and finds which hashes two documents share; a shuffle of these rows
   finds the hashes that splits share. A hash has at most one row per split there, however common it is.
2. Documents with shared hashes are read again; each such anchor gives its context, the bytes that windows around it
   can hold. A context that a smaller document of the same task has as well is settled there.
   Windows around an anchor that very many documents have (CROWD) are settled one by one.
3. The other contexts meet by hash, those of crowded anchors by the bytes beside the anchor too, which part them: the
   windows that reach over these bytes on one side, on both, or on the other meet apart. Right sides (the suffixes) and reversed left sides are each sorted to a
   shallow depth by multikey quicksort, eight bytes a letter, and groups that still agree by a blind trie. Longest common prefixes then give, for each window around an anchor, the smallest document that has it.
4. Documents equal to a smaller one are removed whole by their digest and take no part in 2 and 3.

Hashes only choose whom to compare; bytes decide.

Cases: a null text is empty; documents shorter than `length` bytes keep all; matches inside one document do not count,
nor do those of rows with the same id (repeated rows); rows with a null id keep all and remove nothing; an empty table
gives an empty result; other columns are not read. Texts are compared as UTF-8 bytes, whole.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frozen, release, text_batches
from .packed import packed_texts, unpacked

#: Bytes of text whose anchors are held at a time.
SEGMENT = 16 << 20
#: Bytes of text that are hashed at a time; this takes some eighty times the memory.
PART = 1 << 20
#: Contexts in a task of step 3, about.
TASK_ROWS = 120_000
SHALLOW = 16
#: Documents with an anchor from which on its contexts are dealt out by what is beside the anchor, and how many such
#: anchors at most (those with the most documents); others are compared in one task each.
CROWD, CROWDS = 2_000, 100_000
#: Bytes beside an anchor that deal out its contexts.
NEAR = 6
_ODD = 0x9E3779B97F4A7C15


@functools.cache
def _letters() -> np.ndarray:
    return np.random.default_rng(1).integers(1, 2**63, 256, dtype=np.uint64)


@functools.cache
def _weights(n: int) -> np.ndarray:
    return np.random.default_rng(2).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def _reduce(x: np.ndarray, n: int, f) -> np.ndarray:
    """f over each window of n, by doubling."""
    out, size = x, 1
    while size * 2 <= n:
        out = f(out[: len(out) - size], out[size:])
        size *= 2
    if size < n:
        out = f(out[: len(x) - n + 1], out[n - size : len(x) - size + 1])
    return out


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-byte string of data."""
    power, at = _letters()[data], 1
    out, done = None, 0
    n, left = len(data), k
    while left:
        if left & 1:
            out = power if out is None else out[: n - done - at + 1] + power[done : n - at + 1] * np.uint64(pow(_ODD, done, 1 << 64))
            done += at
        left >>= 1
        if left:
            power = power[: n - 2 * at + 1] + power[at : n - at + 1] * np.uint64(pow(_ODD, at, 1 << 64))
            at *= 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.maximum(out ^ (out >> np.uint64(32)), 1)


def anchors(texts: list[bytes], length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, position in the joined texts, the joined texts, the least hash of each window) of the anchors of texts.

    A window that leaves its text has 0 for its least hash.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.view(np.uint64), none, none, data, none.view(np.uint64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    h = gram_hashes(data, k)
    w = length - k + 1
    least = _reduce(h, w, np.minimum)
    crossing = np.zeros(len(least) + length, dtype=np.int32)
    for e in ends[:-1]:  # windows that start in the length - 1 bytes before an end leave their text
        crossing[max(0, e - length + 1)] += 1
        crossing[e] -= 1
    least = np.where(np.cumsum(crossing[: len(least)]) > 0, np.uint64(0), least)
    side = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(_reduce(np.concatenate([side, least, side]), w, np.maximum) == h)
    return h[at], np.searchsorted(ends, at, side="right"), at, data, least


def reach_of(h: np.ndarray, at: np.ndarray, least: np.ndarray, w: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): the bytes before and from each anchor that the windows whose anchor it is take up.

    These are the same in each text that has such a window, as a window's bytes alone decide its anchor.
    """
    side = np.zeros(w - 1, np.uint64)
    around = np.lib.stride_tricks.sliding_window_view(np.concatenate([side, least, side]), w)[at]  # windows that start w - 1 before to 0 before
    own = around == h[:, None]
    return w - 1 - own.argmax(axis=1), length - own[:, ::-1].argmax(axis=1)


class BlindTrie:
    """Orders strings that agree on a long prefix. Inner nodes keep a depth and branch on one byte; a string is compared
    once, with the leaf that a blind descent ends in."""

    def __init__(self, rows: np.ndarray):
        self.rows = [r.tobytes() for r in rows]
        self.root: list | int | None = None

    def add(self, i: int) -> None:
        own = self.rows[i]
        if self.root is None:
            self.root = i
            return
        node = self.root
        while isinstance(node, list):
            node = node[1].get(own[node[0]]) if own[node[0]] in node[1] else next(iter(node[1].values()))
        other = self.rows[node]
        depth = next((p for p in range(len(own)) if own[p] != other[p]), len(own))
        if depth == len(own):
            raise ValueError("strings must differ")
        parent, node = None, self.root
        while isinstance(node, list) and node[0] < depth:
            parent, node = node, node[1][own[node[0]]]
        if isinstance(node, list) and node[0] == depth:
            node[1][own[depth]] = i
            return
        new = [depth, {other[depth]: node, own[depth]: i}]
        if parent is None:
            self.root = new
        else:
            parent[1][own[parent[0]]] = new

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def row_hash(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view("<u8")
    mixed = (words ^ (words >> np.uint64(31))) * np.uint64(_ODD)
    out = ((mixed ^ (mixed >> np.uint64(29))) * _weights(words.shape[1])).sum(axis=1)
    return out ^ (out >> np.uint64(32))


def equal_rows(rows: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each class, class of each row): rows of one class agree in bytes and keys."""
    order = np.lexsort((row_hash(rows), *keys))
    new = np.ones(len(rows), dtype=bool)
    if len(rows) > 1:
        a, b = order[1:], order[:-1]
        new[1:] = (rows[a] != rows[b]).any(axis=1)
        for x in keys:
            new[1:] |= x[a] != x[b]
    out = np.empty(len(rows), np.int64)
    out[order] = np.cumsum(new) - 1
    return order[new], out


def multikey_quicksort(group: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, tied): rows sorted by group and then by their letters; tied: equal to the row before in both.

    Each segment of rows that agree so far is split in three around a pivot, the median of three of its letters at the
    segment's depth: smaller and greater ones stay at that depth, equal ones go on to the next letter. All segments are
    split at once, pass by pass, until they have one row or no letter left.
    """
    order = np.argsort(group, kind="stable")
    tied = np.zeros(len(order), dtype=bool)
    new = np.concatenate([[True], group[order][1:] != group[order][:-1]]) if len(order) else tied
    at, depth = np.arange(len(order)), np.zeros(len(order), np.int64)  # of the rows in open segments: place, and depth
    while len(at):
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(at)))
        if (size == 1).any():
            keep = np.repeat(size > 1, size)
            at, depth, new = at[keep], depth[keep], new[keep]
            continue
        rows = order[at]
        letter = letters[rows, depth]
        x, y, z = letter[start], letter[start + size // 2], letter[start + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z)), size)
        side = (letter > pivot).astype(np.int64) - (letter < pivot) + 1
        # Where each row goes: its segment's start, the rows of lesser sides, and those of its own side before it.
        first = np.repeat(start, size)
        to, before, cut = first.copy(), np.zeros(len(at), np.int64), np.empty(len(at), np.int64)
        for k in range(3):
            mine = side == k
            upto = np.cumsum(mine)
            inside = upto - mine - np.repeat(upto[start] - mine[start], size)
            to[mine] += (before + inside)[mine]
            before += np.repeat(np.add.reduceat(mine, start), size)
        moved = np.empty_like(rows)
        moved[to] = rows
        order[at] = moved
        cut[to] = side
        new = new.copy()
        new[1:] |= cut[1:] != cut[:-1]
        depth = depth + (cut == 1)  # a segment's rows have one depth
        done = depth == letters.shape[1]
        tied[at[done & ~new]] = True
        at, depth, new = at[~done], depth[~done], new[~done]
    return order, tied


def deep_shallow(group: np.ndarray, rows: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows sorted by group and then bytes, and what each has in common with its predecessor (-1: another group).

    Equal rows of a group must have been joined before. Multikey quicksort sorts the first `shallow` bytes, eight of them
    a letter; blind tries order the rows that still agree.
    """
    depth = min(shallow, rows.shape[1]) // 8 * 8
    letters = np.ascontiguousarray(rows[:, :depth]).view(">u8").astype(np.uint64)
    order, tied = multikey_quicksort(group, letters)
    if len(order) > 1:
        starts = np.flatnonzero(tied[1:] & ~tied[:-1])
        stops = np.flatnonzero(tied & ~np.concatenate([tied[1:], [False]])) + 1
        for s, e in zip(starts, stops):
            own = order[s:e]
            trie = BlindTrie(rows[own, depth:])
            for i in range(e - s):
                trie.add(i)
            order[s:e] = own[trie.order()]
    common = np.full(len(order), -1, np.int64)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        differs = rows[a] != rows[b]
        n = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
        common[1:] = np.where(group[a] == group[b], n, -1)
    return order, common


def _classes(group: np.ndarray, rows: np.ndarray):
    """depth -> class of each row among those of its group that agree on the first depth bytes."""
    first, own = equal_rows(rows, group)
    order, common = deep_shallow(group[first], rows[first])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return lambda depth: np.cumsum(common < depth)[place[own]]


def settled_windows(group: np.ndarray, context: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, length: int, k: int, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(known, settled): of each row and number of bytes before the anchor, whether the row has that window, and whether
    a smaller document of its group has it too. left, right: the bytes that the text has on either side of the anchor's
    start within the context; mask: bits of the windows that are looked at."""
    reach = length - k
    ends = _classes(group, np.ascontiguousarray(context[:, reach:]))
    begins = _classes(group, np.ascontiguousarray(context[:, :reach][:, ::-1]))
    known, settled = (np.zeros((len(doc), reach + 1), dtype=bool) for _ in range(2))
    for s in range(reach + 1):
        known[:, s] = (left >= s) & (right >= length - s)
        if mask is not None:
            known[:, s] &= (mask >> np.int64(s)) & 1 == 1
        own = np.flatnonzero(known[:, s])
        if len(own) < 2:
            continue
        key = (ends(length - s)[own] * (len(doc) + 1)) + begins(s)[own]
        order = np.argsort(key, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        least = np.repeat(np.minimum.reduceat(doc[own][order], cut), np.diff(np.append(cut, len(order))))
        settled[own[order[least < doc[own][order]]], s] = True
    return known, settled


def outer(settled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): the least and greatest settled window of each row; -1 if there are none. What lies between overlaps."""
    some = settled.any(axis=1)
    low = np.where(some, settled.argmax(axis=1), -1)
    high = np.where(some, settled.shape[1] - 1 - settled[:, ::-1].argmax(axis=1), -1)
    return low, high


def content_keys(h: np.ndarray, context: np.ndarray, length: int, k: int) -> list[tuple[np.ndarray, range]]:
    """Keys of a crowded anchor's contexts by what their windows hold, and the windows that each is for.

    All windows with NEAR bytes or more before the anchor agree on these, all with as many behind it on those.
    """
    reach = length - k
    near = min(NEAR, reach // 3)
    before, behind = np.ascontiguousarray(context[:, reach - near : reach]), np.ascontiguousarray(context[:, reach + k : reach + k + near])
    a, b = row_hash(before), row_hash(behind)
    mixed = lambda *x: functools.reduce(lambda p, q: (p ^ q) * np.uint64(_ODD), x, h.astype(np.uint64)) >> np.uint64(33)
    top = reach - near
    return [(mixed(b, np.uint64(1)), range(0, near)), (mixed(a, b, np.uint64(2)), range(near, top + 1)), (mixed(a, np.uint64(3)), range(top + 1, reach + 1))]


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _batches(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.Table]:
    """The batches joined or cut to about `most` bytes of text each."""
    held, size = [], 0
    for b in batches:
        step = max(1, int(b.num_rows * most / max(1, b.column(text).nbytes)))
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            if held and size + part.column(text).nbytes > most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            held.append(part)
            size += part.get_total_buffer_size() * part.num_rows // max(1, b.num_rows)
    if held:
        yield pa.Table.from_batches(held)


def repeated_spans(docs: DataFrame, *, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash and `spans` (sorted, disjoint, not touching: start, end) of the rows of docs that lose bytes.

    A row is known by its id and a hash of its text.
    """
    if length < 16:
        raise ValueError("length must be at least 16 bytes")
    k = length // 2 - 1
    reach = length - k
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    rows = rows.where(F.octet_length("text") >= length)

    # Copies: narrow rows, a digest's smallest id found with map-side sums.
    digests = rows.select("id", F.hash("text").alias("text_hash"), F.md5(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").cast("long").alias("size"))
    first = digests.groupBy("digest", "size").agg(F.min("id").alias("first"))
    copies = frozen(digests.join(first, ["digest", "size"]).where("id > first").select("id", "text_hash", F.lit(0).cast("long").alias("start"), F.col("size").alias("end")))

    def shared(known: bool):
        """Rows (h, id): one per hash and segment, or those of hashes that several documents of a segment have."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _batches(batches, "text", SEGMENT):
                ids = table.column("id").to_numpy()
                texts = _bytes(table.column("text").combine_chunks())
                keep: dict[bytes, int] = {}
                for i in np.argsort(ids, kind="stable"):
                    keep.setdefault(hashlib.blake2b(texts[i], digest_size=16).digest(), i)
                own = np.array(sorted(keep.values()), dtype=np.int64)
                hs, ds = [], []
                for part in _groups([len(texts[i]) for i in own], PART):
                    h, t, *_ = anchors([texts[i] for i in own[part]], length, k)
                    hs.append(h.view(np.int64))
                    ds.append(ids[own[part]][t])
                h, d = np.concatenate(hs), np.concatenate(ds)
                order = np.lexsort((d, h))
                h, d = h[order], d[order]
                new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
                if known:
                    cut = np.flatnonzero(new)
                    many = np.repeat(np.maximum.reduceat(d, cut) != d[cut], np.diff(np.append(cut, len(h)))) if len(h) else new
                    pick = many & (new | np.concatenate([[True], d[1:] != d[:-1]])) if len(h) else new
                else:
                    pick = new
                for i in range(0, int(pick.sum()), 100_000):
                    at = np.flatnonzero(pick)[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(h[at]), pa.array(d[at])], ["h", "id"])

        return rows.mapInArrow(run, "h long, id long")

    # At most one row a hash and segment.
    least = shared(False)
    by = Window.partitionBy("h")
    across = least.withColumns({"a": F.min("id").over(by), "b": F.max("id").over(by)}).where("a < b").select("id", "h")
    settled = copies.groupBy("id").agg(F.collect_set("text_hash").alias("settled"))
    wanted = across.unionByName(shared(True).select("id", "h")).groupBy("id").agg(F.collect_set("h").alias("hs"))
    wanted = frozen(wanted.join(settled, "id", "left"))
    total = wanted.agg(F.sum(F.size("hs"))).first()[0] or 0
    crowds = wanted.select(F.explode("hs").alias("h")).groupBy("h").count().where(F.col("count") >= CROWD).orderBy(F.desc("count"), "h").limit(CROWDS)
    crowded = np.sort(np.array([r["h"] for r in crowds.collect()], dtype=np.int64))  # at most CROWDS
    release(docs, total)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _batches(batches, "packed", PART):
            ids = table.column("id").to_numpy()
            hashes = table.column("text_hash").to_numpy()
            texts = unpacked(table.column("packed").to_pylist())
            h, t, at, data, least_hash = anchors(texts, length, k)
            hs = table.column("hs").combine_chunks()
            many = np.diff(hs.offsets.to_numpy())
            flat, owner = hs.flatten().to_numpy(), np.repeat(np.arange(len(ids)), many)
            # An anchor counts if its document wants its hash.
            asked = np.stack([np.concatenate([owner, t]), np.concatenate([flat, h.view(np.int64)])])
            order = np.lexsort((np.concatenate([np.zeros(len(flat)), np.ones(len(h))]), asked[1], asked[0]))
            x = asked[:, order]
            new = np.concatenate([[True], (x[:, 1:] != x[:, :-1]).any(axis=0)])
            led = (order < len(flat))[np.flatnonzero(new)][np.cumsum(new) - 1]
            pick = np.sort(order[led & (order >= len(flat))] - len(flat))
            if not len(pick):
                continue
            left, right = reach_of(h[pick], at[pick], least_hash, reach + 1, length)
            h, t, at = h.view(np.int64)[pick], t[pick], at[pick]
            starts = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
            column = np.arange(-reach, length, dtype=np.int16)
            edge = np.zeros(length, dtype=np.uint8)
            ctx = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge[:reach], data, edge]), reach + length)[at]
            left, right = left.astype(np.int16), right.astype(np.int16)
            ctx[(column < -left[:, None]) | (column >= right[:, None])] = 0
            d = ids[t]
            _, cls = equal_rows(ctx, h, left, right)
            least = np.full(cls.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, cls, d)
            # A smaller document of this task has the same context: all windows around the anchor are settled.
            done = least[cls] < d
            pos, th = at - starts[t], hashes[t]
            out = [(d[done], th[done], pos[done] - left[done], pos[done] + right[done], None, None)]
            # Equal contexts of one text that are no farther apart than a window go on as one, from the first to the last:
            # their answers overlap. So a text of one repeated word does not crowd its anchor.
            rest = np.flatnonzero(~done)
            rest = rest[np.lexsort((pos[rest], t[rest], cls[rest]))]
            if not len(rest):
                first = last = rest
            else:
                apart = (np.diff(cls[rest]) != 0) | (np.diff(t[rest]) != 0) | (np.diff(pos[rest]) > length)
                first = rest[np.concatenate([[True], apart])]
                last = pos[rest[np.concatenate([apart, [True]])]]
            h, d, th, pos, left, right, ctx = (x[first] for x in (h, d, th, pos, left, right, ctx))
            # Of a crowded anchor the windows are settled one by one, and what is left goes where its content leads.
            crowd = np.flatnonzero(np.isin(h, crowded))
            every = np.full(len(h), (1 << (reach + 1)) - 1, np.int64)
            if len(crowd):
                own = tuple(x[crowd] for x in (ctx, left, right))
                known, settled = settled_windows(np.unique(h[crowd], return_inverse=True)[1], *own, d[crowd], length, k)
                low, high = outer(settled)
                hit = high >= 0
                out.append((d[crowd][hit], th[crowd][hit], (pos[crowd] - high)[hit], (last[crowd] - low + length)[hit], None, None))
                open_ = known & ~settled
                for key, windows in content_keys(h[crowd], own[0], length, k):
                    bits = (open_[:, windows] * (np.int64(1) << np.array(windows, np.int64))).sum(axis=1)
                    some = bits > 0
                    rows_ = crowd[some]
                    out.append((d[rows_], th[rows_], pos[rows_], last[rows_], (key[some] & np.uint64(0x7FFFFFFF)).astype(np.int32), (ctx[rows_], left[rows_], right[rows_], bits[some])))
            others = np.delete(np.arange(len(h)), crowd)
            out.append((d[others], th[others], pos[others], last[others], (h[others] & 0x7FFFFFFF).astype(np.int32), (ctx[others], left[others], right[others], every[others])))
            for d_, th_, a, b, key, own in out:
                for i in range(0, len(d_), 20_000):
                    s = slice(i, i + 20_000)
                    n = len(d_[s])
                    if own is None:
                        a_, b_, d2, th2 = _joined(d_[s], th_[s], a[s], b[s])
                        n = len(d2)
                        yield pa.RecordBatch.from_arrays([pa.array(((d2 * 31 + a_) & 0x7FFFFFFF).astype(np.int32)), pa.array(d2), pa.array(th2), pa.array(a_), pa.array(b_), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], NAMES)
                    else:
                        flat = own[0][s].tobytes()
                        width = own[0].shape[1]
                        offsets = pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes())
                        blob = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(flat)])
                        yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(d_[s]), pa.array(th_[s]), pa.array(a[s]), pa.array(b[s]), blob, pa.array(own[1][s].astype(np.int32)), pa.array(own[2][s].astype(np.int32)), pa.array(own[3][s])], NAMES)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for b in batches:
            ready = b.filter(pc.is_null(b.column("ctx")))
            if ready.num_rows:
                yield pa.RecordBatch.from_arrays([ready.column(x) for x in SPANS], SPANS)
            rest = b.filter(pc.is_valid(b.column("ctx")))
            if rest.num_rows:
                held.append(rest)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        h, d, th, pos, last, left, right, mask = (table.column(x).to_numpy() for x in ("h", "id", "text_hash", "start", "end", "left", "right", "windows"))
        ctx = np.frombuffer(b"".join(table.column("ctx").to_pylist()), dtype=np.uint8).reshape(len(h), reach + length)
        del table, held
        order = np.argsort(h, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        sizes = np.diff(np.append(cut, len(h)))
        least, most = np.minimum.reduceat(d[order], cut), np.maximum.reduceat(d[order], cut)
        order = order[np.repeat(least < most, sizes)]
        if not len(order):
            return
        h, d, th, pos, last, left, right, mask, ctx = (x[order] for x in (h, d, th, pos, last, left, right, mask, ctx))
        group = np.cumsum(np.concatenate([[False], h[1:] != h[:-1]]))
        low, high = outer(settled_windows(group, ctx, left, right, d, length, k, mask)[1])
        hit = high >= 0
        a, b, d, th = _joined(d[hit], th[hit], (pos - high)[hit], (last - low + length)[hit])
        for i in range(0, len(d), 100_000):
            s = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (d, th, a, b)], SPANS)

    again = packed_texts(rows).join(wanted, "id").where("settled is null or not array_contains(settled, text_hash)")
    made = again.select("id", "text_hash", "packed", "hs").mapInArrow(contexts, "h int, id long, text_hash int, start long, end long, ctx binary, left int, right int, windows long")
    tasks = max(8, -(-total // TASK_ROWS))
    spans = made.repartition(tasks, "h").mapInArrow(settle, "id long, text_hash int, start long, end long")
    # A document's spans: at most as many as it has bytes.
    joined = spans.unionByName(copies).groupBy("id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    joined = frozen(joined)
    release(docs, total)
    return joined


NAMES = ["h", "id", "text_hash", "start", "end", "ctx", "left", "right", "windows"]
SPANS = ["id", "text_hash", "start", "end"]


def _groups(sizes: list[int], most: int) -> Iterator[slice]:
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    yield slice(start, len(sizes))


def _joined(d: np.ndarray, th: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, id, text_hash) of the spans [a, b) with those of one document that touch joined."""
    if not len(d):
        return a, b, d, th
    order = np.lexsort((a, th, d))
    d, th, a, b = d[order], th[order], a[order], b[order]
    same = np.concatenate([[False], (d[1:] == d[:-1]) & (th[1:] == th[:-1])])
    group = np.cumsum(~same)
    span = int(b.max()) + 1
    reached = np.maximum.accumulate(b + group * span) - group * span  # the furthest end so far in the document
    new = ~same
    new[1:] |= a[1:] > reached[:-1]
    cut = np.flatnonzero(new)
    return a[cut], np.maximum.reduceat(b, cut), d[cut], th[cut]


def cut_spans(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans and `kept`, the remaining bytes, for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = packed_texts(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    both = rows.join(spans, ["id", "text_hash"], "left").select(F.col("id").cast(kind).alias("id"), "packed", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_batches(batches, "packed", PART):
            sizes, removed, many, rest = [], [], [], []
            for data, own in zip(unpacked(b.column("packed").to_pylist()), b.column("spans").to_pylist()):
                merged: list[list[int]] = []
                for x in own or ():
                    if merged and x["start"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], x["end"])
                    else:
                        merged.append([x["start"], x["end"]])
                kept, at = [], 0
                for s, e in merged:
                    kept.append(data[at:s])
                    at = e
                sizes.append(len(data))
                removed.append(sum(e - s for s, e in merged))
                many.append(len(merged))
                rest.append(b"".join([*kept, data[at:]]))
            counts = [pa.array(x, pa.int64()) for x in (sizes, removed, many)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *counts, pa.array(rest, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = both.mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return out.withColumnRenamed("id", id_col)


def suffix_report(docs: DataFrame, *, length: int = 50) -> DataFrame:
    out = cut_spans(docs, repeated_spans(docs, length=length))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
