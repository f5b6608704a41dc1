"""Packing: non-negative least squares over shallow length combinations.

Documents are cut into pieces of at most `window` tokens. The histogram of piece lengths, in classes of `step` tokens,
is fitted by combinations of up to three classes that fill a window: non-negative least squares gives each
combination's repeat count for the corpus. Pieces are placed by frames, runs of consecutive pieces of the input: each
frame takes its share of the repeat counts, rounded to what it holds, and packs greedily, by exact lengths, what is
left. Sequences are numbered frame after frame, and in a frame by the mean place of their pieces, so that they follow
the order of the input. The solution has at most as many combinations as there are classes, whatever the corpus; a
frame is placed where it was read, without a shuffle, and only the frames' numbers of sequences are added up.

Cases: a null or empty text is the end token alone; the string of a special token is that token; texts of any length
are packed whole; ids of rows are handed on as they are, null or not; repeated rows are packed as rows of their own; an
empty table gives an empty result; other columns are not read. Every token is in exactly one piece and every piece in
exactly one sequence.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frozen, text_batches

#: Bytes of text that are encoded at a time, or one text.
ENCODE_BYTES = 4 << 20
#: Pieces that are placed together.
FRAME_PIECES = 16_384


#: The split pattern of byte-level pre-tokenizers. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: From so many white-space characters in a row on, a text is left to tokenizers.
LONG_RUN = 1_000
#: Texts that a worker encodes both ways, to see that the ids are equal.
CHECKED = 32


class Encoder:
    """Texts' ids by the tokenizers vocabulary of path; a special token's string is that one token.

    For a byte-level vocabulary whose ids follow its merges tiktoken, given that same file's vocabulary, gives the same
    ids in a third of the time. It takes the texts without a special token's string or a long run of white space (where
    it would fail), as long as it agrees with tokenizers on the worker's first texts; all others are left to tokenizers.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.special = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.run = re.compile(r"\s{%d}" % LONG_RUN)
        self.quick = quick_encoding(path)
        self.left = CHECKED

    def exact(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [self._ids(t) for t in texts]

    def _ids(self, text: str) -> np.ndarray:
        if self.quick is None or any(s in text for s in self.special) or (len(text) >= LONG_RUN and self.run.search(text)):
            return self.exact(text)
        ids = np.array(self.quick.encode_ordinary(text), dtype="<u4")
        if self.left:
            self.left -= 1
            right = self.exact(text)
            if not np.array_equal(ids, right):
                self.quick = None
            return right
        return ids


def quick_encoding(path: str):
    """The tiktoken encoding of the vocabulary in path, or None if it is not of that kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    # Printable bytes stand for themselves, the others for the characters from 256 on.
    themselves = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in themselves} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in themselves)}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if len(ranks) != 256 + len(merged) or merged != sorted(merged):
        return None
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def load_encoder(path: str) -> Encoder:
    """One for a worker's tasks."""
    return Encoder(path)


def in_file_order(docs: DataFrame) -> DataFrame:
    """docs with __file and __at: for rows read from files, the file's number in its name and the row's in the file,
    which follow the order in which the rows were written; otherwise the partition's number and the row's."""
    try:
        number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
        name = F.concat_ws(" ", F.lpad(number, 12, "0"), F.col("_metadata.file_path"))
        return docs.withColumns({"__file": name, "__at": F.col("_metadata.row_index")})
    except AnalysisException:  # not rows of files
        name = F.lpad(F.spark_partition_id().cast("string"), 12, "0")
        return docs.withColumns({"__file": name, "__at": F.monotonically_increasing_id()})


PLACED = ["file", "at", "start", "length", "ids_crc32", "doc_tokens"]


def pieces(docs: DataFrame, vocabulary: str, *, window: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: id_col, file and at (see in_file_order), start, length, ids_crc32, doc_tokens, with_ids its `ids`."""
    rows = in_file_order(docs).select(F.col(id_col).alias("doc"), F.col("__file").alias("file"), F.col("__at").alias("at"), F.col(text_col).alias("text"))
    names = ["doc", *PLACED] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(vocabulary)
        for b in text_batches(batches, "text", ENCODE_BYTES):
            owner, start, length, crc, size, cut = [], [], [], [], [], []
            for i, ids in enumerate(encode([t or "" for t in b.column("text").to_pylist()])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), window):
                    part = ids[at : at + window]
                    owner.append(i)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    size.append(len(ids))
                    if with_ids:
                        cut.append(part.astype(np.int64))
            own = [b.column(c).take(pa.array(owner, pa.int64())) for c in ("doc", "file", "at")]
            out = [*own, *(pa.array(x, pa.int64()) for x in (start, length, crc, size))] + [pa.array(cut, pa.list_(pa.int64()))] * with_ids
            yield pa.RecordBatch.from_arrays(out, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc {kind}, file string, at bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<bigint>" * with_ids
    return rows.mapInArrow(run, schema).withColumnRenamed("doc", id_col)


def nnls(a: np.ndarray, b: np.ndarray, limit: int = 3000) -> np.ndarray:
    """The x >= 0 with the least |ax - b|, by active sets: columns join by steepest descent and leave when they turn negative."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(limit):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(w.argmax())
        if w[j] <= tolerance:
            break
        passive[j] = True
        while True:
            own = np.flatnonzero(passive)
            part = a[:, own]
            s = np.linalg.lstsq(part.T @ part, part.T @ b, rcond=None)[0]
            low = s <= 1e-12
            if not low.any():
                x[:] = 0
                x[own] = s
                break
            now = x[own]
            t = np.min(now[low] / np.maximum(now[low] - s[low], 1e-300))
            now = now + min(1.0, t) * (s - now)
            gone = now <= 1e-10
            if not gone.any():
                gone[np.flatnonzero(low)[0]] = True
            x[:] = 0
            x[own[~gone]] = now[~gone]
            passive[own[gone]] = False
    return x


def combinations(classes: int) -> list[tuple[int, ...]]:
    """Up to three classes, the larger first, that fill the window exactly."""
    out: list[tuple[int, ...]] = [(classes,)]
    for a in range(classes - 1, 0, -1):
        rest = classes - a
        if rest <= a:
            out.append((a, rest))
        out += [(a, b, rest - b) for b in range(min(a, rest - 1), 0, -1) if rest - b <= b]
    return out


@dataclass
class Plan:
    """How often each combination of classes is repeated for the whole histogram, and the histogram's number of pieces."""

    window: int
    step: int
    combos: list[tuple[int, ...]]
    repeats: np.ndarray
    pieces: int


def make_plan(histogram: np.ndarray, window: int, step: int = 4) -> Plan:
    """The plan for histogram[l] pieces of each length l up to window."""
    if window % step:
        step = 1
    classes = window // step
    by_class = np.bincount(-(-np.arange(window + 1) // step), weights=histogram, minlength=classes + 1)
    combos = combinations(classes)[1:]  # a piece that fills the window alone needs no partner
    if not combos or not by_class[1:classes].sum():
        return Plan(window, step, [], np.zeros(0), int(histogram.sum()))
    a = np.zeros((classes + 1, len(combos)))
    for j, c in enumerate(combos):
        np.add.at(a[:, j], list(c), 1)
    x = nnls(a[1:classes], by_class[1:classes])
    own = np.flatnonzero(x > 0)
    own = own[np.argsort(-x[own], kind="stable")]
    return Plan(window, step, [combos[j] for j in own], x[own], int(histogram.sum()))


def place(plan: Plan, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each of a frame's pieces, in the frame's order, and the number of sequences."""
    n = len(lengths)
    cls = -(-lengths // plan.step)
    left = np.bincount(cls, minlength=plan.window // plan.step + 1)
    kinds, times = [], []  # of the chosen sequences: their combination, and when in the frame they come

    def take(combo: tuple[int, ...], most: int, have: np.ndarray) -> int:
        own, many = np.unique(combo, return_counts=True)
        k = max(0, min(most, int((have[own] // many).min())))
        have[own] -= k * many
        return k

    share = plan.repeats * (n / max(1, plan.pieces))
    whole = np.floor(share + 1e-9).astype(np.int64)
    counts = [take(c, int(k), left) for c, k in zip(plan.combos, whole)]
    for j in np.argsort(whole - share, kind="stable"):  # the largest remainders are rounded up, as far as pieces are there
        if share[j] - whole[j] >= 0.5:
            counts[j] += take(plan.combos[j], 1, left)
    for c, k in zip(plan.combos, counts):
        kinds += [c] * k
        times += ((np.arange(k) + 0.5) / max(k, 1)).tolist()
    used = np.bincount(cls, minlength=len(left)) - left
    by_class = np.argsort(cls, kind="stable")
    rank = np.empty(n, np.int64)
    rank[by_class] = np.arange(n) - np.searchsorted(cls[by_class], cls[by_class])
    fitted = rank < used[cls]
    seq = _deal(kinds, times, cls, np.flatnonzero(fitted), np.full(n, -1, np.int64), 0)
    # What is left: longest first, each sequence takes all that still fits.
    rest = np.flatnonzero(~fitted)
    have = np.bincount(lengths[rest], minlength=plan.window + 1)
    greedy: list[tuple[int, ...]] = []
    while have.any():
        space, combo, now = plan.window, [], have.copy()
        while len(fits := np.flatnonzero(now[: space + 1])):
            size = int(fits[-1])
            k = int(min(now[size], space // size))
            combo += [size] * k
            now[size] = 0
            space -= size * k
        greedy += [tuple(combo)] * take(tuple(combo), int(have.max()), have)
    seq = _deal(greedy, [(i + 0.5) / max(1, len(greedy)) for i in range(len(greedy))], lengths, rest, seq, len(kinds))
    total = len(kinds) + len(greedy)
    mean = np.bincount(seq, weights=np.arange(n), minlength=total) / np.maximum(1, np.bincount(seq, minlength=total))
    new = np.empty(total, np.int64)
    new[np.argsort(mean, kind="stable")] = np.arange(total)
    seq = new[seq]
    order = np.argsort(seq, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    offset = np.empty(n, np.int64)
    offset[order] = before - before[np.searchsorted(seq[order], seq[order])] if n else before
    return seq, offset, total


def _deal(kinds: list[tuple[int, ...]], times: list[float], key: np.ndarray, pieces: np.ndarray, seq: np.ndarray, base: int) -> np.ndarray:
    """The pieces of each key, in order, to the sequences that take that key, by time."""
    if len(pieces):
        of = np.repeat(np.arange(len(kinds)), [len(c) for c in kinds])
        want = np.concatenate([np.array(c) for c in kinds])
        by = np.lexsort((np.array(times)[of], want))
        seq[pieces[np.argsort(key[pieces], kind="stable")]] = of[by] + base
    return seq


def pack(cut: DataFrame, *, window: int = 1024, step: int = 4, frame_pieces: int = FRAME_PIECES) -> DataFrame:
    """cut (pieces()) with sequence_id, gapless from 0, and offset, gapless in the sequence; file and at are left out."""
    held = frozen(cut)
    counts = held.groupBy("length").count().collect()  # at most window rows
    histogram = np.zeros(window + 1, np.int64)
    for r in counts:
        histogram[r["length"]] = r["count"]
    plan = make_plan(histogram, window, step)
    names = held.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in _frames(batches, frame_pieces):
            seq, offset, total = place(plan, frame.column("length").to_numpy())
            n = frame.num_rows
            first, begins = frame.column("at")[0].as_py(), frame.column("start")[0].as_py()
            extra = [pa.array(seq), pa.array(offset), pa.array(np.full(n, first)), pa.array(np.full(n, begins)), pa.array(np.full(n, total))]
            for x, name in zip(extra, ("__seq", "offset", "__first", "__begins", "__total")):
                frame = frame.append_column(name, x)
            yield from frame.to_batches(max_chunksize=10_000)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)
    placed = frozen(held.mapInArrow(run, f"{kinds}, __seq bigint, offset bigint, __first bigint, __begins bigint, __total bigint"))
    # A row per frame; sums run over the frames of a file, and over files.
    frames = placed.groupBy("file", "__first", "__begins").agg(F.first("__total").alias("__total"))
    files = frames.groupBy("file").agg(F.sum("__total").alias("__n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = files.select("file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__file_base"))
    inside = Window.partitionBy("file").orderBy("__first", "__begins").rowsBetween(Window.unboundedPreceding, -1)
    bases = frames.withColumn("__base", F.coalesce(F.sum("__total").over(inside), F.lit(0))).join(files, "file")
    bases = bases.select("file", "__first", "__begins", (F.col("__base") + F.col("__file_base")).alias("__base"))
    out = placed.join(bases, ["file", "__first", "__begins"])
    return out.withColumn("sequence_id", F.col("__base") + F.col("__seq")).select(*(c for c in names if c not in ("file", "at")), "sequence_id", "offset")


def _frames(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Consecutive rows of one file, at most `most` together."""
    held: list[pa.RecordBatch] = []
    rows, key = 0, None
    for b in batches:
        codes = b.column("file").dictionary_encode().indices.to_numpy()
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            own = b.column("file")[s].as_py() if e > s else key
            while s < e:
                if held and (own != key or rows == most):
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
                key = own
                n = min(e - s, most - rows)
                held.append(b.slice(s, n))
                rows += n
                s += n
    if held:
        yield pa.Table.from_batches(held)


def packing_report(docs: DataFrame, vocabulary: str, *, window: int = 1024) -> DataFrame:
    out = pack(pieces(docs, vocabulary, window=window), window=window)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
