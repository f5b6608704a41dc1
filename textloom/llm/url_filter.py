"""URL filters: an exact Bloom filter cascade, native.

A cascade stores a list of keys among a known universe of keys. Level 0 is a Bloom filter of the listed keys, level 1
one of the unlisted keys of the universe that pass level 0, level 2 one of the listed keys that pass level 1, and so
on until none passes. A key's first level that it fails gives the answer, which is exact for each key of the universe.
A list is dealt over shards by a hash of its keys, so that no level has more than about MAX_BITS bits, each shard with a
cascade of its own. The levels' bits are literals in the plan, so that URLs are judged in the scan, without a join or a
shuffle; lists of many shards are judged SHARDS at a time, the rows kept in between.

Cases: a null url or one without `://` has an empty host and path; no rule fits it. Repeated rows give repeated
results. An empty table gives an empty result; an empty list of rules makes an empty cascade, which holds no key.
Other columns of the input are not read.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frozen

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits of a shard's first level, about, and shards whose levels are literals of one plan.
MAX_BITS, SHARDS = 1 << 23, 16


@dataclass
class Level:
    bits: int
    hashes: int
    words: list[int]
    seed: int

    def may_hold(self, key: Column) -> Column:
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        found = F.lit(True)
        for p in positions(key, self.bits, self.hashes, self.seed):
            word = F.element_at(words, (F.floor(p / 64) + 1).cast("int"))
            found = found & (F.getbit(word, (p % 64).cast("int")) == 1)
        return found


@dataclass
class Cascade:
    """Exact membership for each key of the universe it was built over."""

    levels: list[Level] = field(default_factory=list)

    def holds(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[depth].may_hold(key), out).otherwise(F.lit(depth % 2 == 1))
        return out


def positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 64 + i)), F.lit(bits).cast("long")) for i in range(hashes)]


def shape(n: int, false_positives: float) -> tuple[int, int]:
    """(bits, hashes) of a Bloom filter of n keys."""
    hashes = max(1, math.ceil(-math.log2(false_positives)))
    return max(64, math.ceil(n * hashes / math.log(2) / 64) * 64), hashes


def bloom(keys: DataFrame, n: int, false_positives: float, seed: int) -> Level:
    """A Bloom filter of the column key; its words are put together by a distributed bit_or."""
    bits, hashes = shape(n, false_positives)
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, seed))).alias("p"))
    one = F.expr("shiftleft(1L, CAST(p % 64 AS INT))")
    got = at.groupBy(F.floor(F.col("p") / 64).alias("word")).agg(F.bit_or(one).alias("v")).collect()  # at most bits / 64 rows
    words = [0] * (bits // 64)
    for row in got:
        words[row["word"]] = row["v"]
    return Level(bits, hashes, words, seed)


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards))


def first_levels(listed: DataFrame, universe_keys: int) -> tuple[int, dict[int, Level], dict[int, int]]:
    """(shards, level 0 of each, number of keys of each) of the distinct column key of listed.

    A level 0 lets about as many unlisted keys of the universe through as there are listed ones, so that the levels grow
    with the list and not with the corpus.
    """
    n = listed.count()
    rate = min(0.5, max(1e-9, 0.7 * n / max(universe_keys, 1)))
    shards = math.ceil(shape(n, rate)[0] / MAX_BITS) if n else 1
    counts = {r["s"]: r["count"] for r in listed.groupBy(shard_of(F.col("key"), shards).alias("s")).count().collect()}
    return shards, {s: bloom(listed.where(shard_of(F.col("key"), shards) == s), m, rate, 0) for s, m in sorted(counts.items())}, counts


def finish_cascade(first: Level, count: int, listed: DataFrame, passed: DataFrame, max_levels: int = 64) -> Cascade:
    """The cascade of level 0 `first` of the `count` keys of listed, exact over these and over passed, the unlisted keys
    that pass level 0 (columns key, distinct)."""
    levels, sides = [first], [passed, listed]
    while count := sides[0].count():
        if len(levels) == max_levels:
            raise ValueError("the cascade does not end; two keys have equal hashes")
        levels.append(bloom(sides[0], count, 0.5, len(levels)))
        sides = [sides[1].where(levels[-1].may_hold(F.col("key"))), sides[0]]
    return Cascade(levels)


def build_cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 64) -> Cascade:
    """A cascade of one shard for the column key of listed, exact over the column key of universe and listed."""
    listed = listed.select("key").where("key is not null").distinct()
    universe = universe.select("key").where("key is not null")
    shards, first, counts = first_levels(listed, universe.count())
    if not counts:
        return Cascade()
    if shards > 1:
        raise ValueError(f"{sum(counts.values())} keys need more than one shard")
    passed = frozen(universe.where(first[0].may_hold(F.col("key"))).distinct().join(listed, "key", "left_anti"))
    return finish_cascade(first[0], counts[0], listed, passed, max_levels)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty without `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def judge_urls(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]], *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id_col, host, path, rule, verdict for each row of pages.

    rules: (verdict, host, path), verdict `allow` or `block`. A rule fits its host and all subdomains if the url's
    path starts with its own. The longest fitting rule wins (host and path together, then the longer host); a url
    that no cascade lists gets `default`. A rule given with both verdicts blocks.
    """
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    labels = sorted({h.count(".") + 1 for _, h, _ in rules}, reverse=True)
    lengths = sorted({len(p) for _, _, p in rules}, reverse=True)
    # Each key a rule of this shape could have for a url: the last labels of its host, the first characters of its path.
    keys = [
        F.when((F.size(F.split("host", r"\.")) >= a) & (F.length("path") >= b), F.concat(F.substring_index("host", ".", -a), F.substring("path", 1, b)))
        for a in labels
        for b in lengths
    ]
    if not keys:
        return urls.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    tried = urls.withColumn("keys", F.filter(F.array(*keys), lambda k: k.isNotNull()))
    universe = tried.select(F.explode("keys").alias("key"))
    most = pages.count() * len(keys)
    lists = {v: _keys(spark, [h + p for w, h, p in rules if w == v]) for v in ("block", "allow")}
    begun = {v: first_levels(own, most) for v, own in lists.items()}

    def maybe(verdict: str, key: Column) -> Column:
        """Whether a key passes level 0 of its shard."""
        shards, first, _ = begun[verdict]
        out = F.lit(False)
        for s, level in first.items():
            out = F.when(shard_of(key, shards) == s, level.may_hold(key)).otherwise(out)
        return out

    # The universe's keys that a level 0 lets through are about as many as rules; they are kept, so that pages are read once for all levels.
    passes = [maybe(v, F.col("key")).alias(v) for v in lists]
    passed = frozen(universe.select("key", *passes).where(F.col("block") | F.col("allow")).distinct())
    none = F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    judged = tried.withColumn("best", none)
    steps = [(v, s) for v, (_, first, _) in begun.items() for s in first]
    for i, (verdict, s) in enumerate(steps):
        shards, first, counts = begun[verdict]
        mine = shard_of(F.col("key"), shards) == s
        others = passed.where(F.col(verdict) & mine).select("key").join(lists[verdict], "key", "left_anti")
        cascade = finish_cascade(first[s], counts[s], lists[verdict].where(mine), others)
        judged = judged.withColumn("best", _best(verdict, s, shards, cascade))
        if i % SHARDS == SHARDS - 1 and i + 1 < len(steps):
            judged = frozen(judged)
    return judged.select(id_col, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


def _keys(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame(pa.table({"key": pa.array(sorted(set(keys)), pa.string())}))


def _best(verdict: str, shard: int, shards: int, cascade: Cascade) -> Column:
    """The best rule so far, or a better one of this shard: the longer key, of equal ones that with the longer host,
    and of equal keys the one that blocks, as blocks come first. keys run from the longer host to the shorter."""
    found = F.filter("keys", lambda k: (shard_of(k, shards) == shard) & cascade.holds(k))
    place = lambda k: F.array_position("keys", k)

    def better(best: Column, k: Column) -> Column:
        longer = F.length(k) > best["n"]
        higher = (F.length(k) == best["n"]) & (place(k) < place(best["rule"]))
        return F.when(best.isNull() | longer | higher, F.struct(F.length(k).alias("n"), k.alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)

    return F.aggregate(found, F.col("best"), better)
