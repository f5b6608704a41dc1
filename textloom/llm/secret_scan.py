"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Candidates are long runs of key-like characters. For each character class a window slides over the candidate's runs
of that class; the window's entropy is kept up by adding and taking away one character's count. Windows at or over the
class's entropy join into spans. A window must also hold as many digits and letters as its class asks for (two of each
here: long words and file names of letters alone have as much entropy as keys, so that keys without digits are only
found by a class that asks for none). Spans that lie in a pattern's span, or that the allow-list matches, are not added.

Cases: a null text is empty and has no spans; texts of any length are scanned whole; repeated rows give repeated
results; ids are handed on as they are, null or not; an empty table gives an empty result; other columns are not read
(redact() keeps them as they are).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

#: Bytes of text that are scanned at a time, or one text.
SCAN_BYTES = 4 << 20
KINDS = ("assign", "access", "hex", "entropy")
_WORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile("(" + "|".join(_either_case(w) for w in _WORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_HINTS = ("passw", "secret", "token", "api")


@dataclass(frozen=True)
class EntropyClass:
    """A window over characters of `alphabet` is suspect from `bits` of entropy on, with `digits` and `letters` at least."""

    name: str
    alphabet: str
    window: int
    bits: float
    digits: int = 2
    letters: int = 2


CLASSES = (
    EntropyClass("hex", "0-9a-fA-F", 20, 3.0),
    EntropyClass("alphanumeric", "A-Za-z0-9", 20, 3.7),
    EntropyClass("base64", "A-Za-z0-9+/_=-", 24, 4.0),
)

#: Strings that look random and are no secrets: UUIDs, counting sequences, one digest given as a checksum.
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"[A-Za-z0-9+/_=-]*(0123456789|abcdefghijklmnop)[A-Za-z0-9+/_=-]*",
    r"(sha(1|256|512)|md5)[=-][A-Za-z0-9+/=]+",
    r"[A-Za-z]+([-_/][A-Za-z]+)*[-_/]?[0-9]{1,8}",
)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_DIGIT, _LETTER = frozenset("0123456789"), frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def entropy_windows(run: str, window: int, bits: float, least_digits: int = 2, least_letters: int = 2) -> Iterator[tuple[int, int]]:
    """Spans of run whose windows have at least `bits` of entropy, and as many digits and letters as given or more."""
    if len(run) < window:
        return
    plogp = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, digits, letters, start, end = 0.0, 0, 0, -1, -1
    limit = window * (math.log2(window) - bits) + 1e-9  # H >= bits exactly if the sum of c log c is at most this
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += plogp[n + 1] - plogp[n]
        digits += c in _DIGIT
        letters += c in _LETTER
        if i >= window:
            gone = run[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            total += plogp[n - 1] - plogp[n]
            digits -= gone in _DIGIT
            letters -= gone in _LETTER
        if i >= window - 1 and total <= limit and digits >= least_digits and letters >= least_letters:
            if i - window + 1 > end:
                if start >= 0:
                    yield start, end
                start = i - window + 1
            end = i + 1
    if start >= 0:
        yield start, end


class Scanner:
    def __init__(self, classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED):
        self.classes = [(c, re.compile(f"[{c.alphabet}]{{{c.window},}}")) for c in classes]
        self.allowed = [re.compile(a) for a in allowed]
        self.mixed = all(c.digits for c in classes)

    def base(self, text: str) -> list[tuple[str, int, int]]:
        found = []
        low = text.lower()
        if any(h in low for h in _HINTS):
            found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            found += [("access", *m.span()) for m in ACCESS.finditer(text)]
        return found + [("hex", *m.span()) for m in HEX.finditer(text)]

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        found: list[tuple[int, int]] = []
        for m in _CANDIDATE.finditer(text):
            word = m[0]
            if (self.mixed and word.isalpha()) or any(a.fullmatch(word) for a in self.allowed):
                continue
            for c, runs in self.classes:
                for r in runs.finditer(word):
                    for a, b in entropy_windows(r[0], c.window, c.bits, c.digits, c.letters):
                        found.append((m.start() + r.start() + a, m.start() + r.start() + b))
        joined: list[list[int]] = []
        for a, b in sorted(found):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        return [("entropy", a, b) for a, b in joined if not any(s <= a and b <= e for _, s, e in base)]

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) of all spans, in code points, by start and then by kind as listed."""
        text = text or ""
        base = self.base(text)
        return in_order(base + self.added(text, base))


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """id_col and `spans`, an array of (kind, start, end), for each row of docs. One pass, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allowed)
        for b in text_batches(batches, "text", SCAN_BYTES):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in scanner.spans(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, shape)], ["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    out, at = [], 0
    for _, a, b in spans:
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[secret]", classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """docs with each span (overlapping ones as one) replaced by mark; length_col, if there, counts code points anew."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(classes, allowed)
        for b in batches:
            yield pd.Series([t if t is None or not (s := scanner.spans(t)) else redacted(t, s, mark) for t in b], dtype=object)

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)


def secret_report(docs: DataFrame) -> DataFrame:
    """The contract's digest columns, from scan()."""

    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    found = scan(docs)
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.sha2(text(F.filter("spans", lambda x: x["kind"] != "entropy")), 256).alias("base_sha256")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), base, text(F.col("spans")).alias("spans"), of("entropy"))
