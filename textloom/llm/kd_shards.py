"""Sharding: K-d tree partitioning, native.

A node is split at the weighted median of its widest metadata dimension (its extent over that of all rows), until a
leaf is down to the target bytes. The weight of a row is its size. Medians are distributed: sums of sizes over buckets
of a dimension's range find the bucket that holds the median, which is divided again until its weight no longer
matters; all nodes of a level go on together. Ties in the dimension are split by a hash of id and text, and rows that
agree in these by their place in the scan, so that a value that a third of all rows share is still split in two.
The texts are read once; what is split, numbered and shuffled are rows of a few numbers. The nodes of a level, with what
is known of their medians, are a table like any other; of a level with very many of them the driver sees counts alone.

Cases: null text has size 1, null metadata counts as 0; repeated rows are rows of their own; fewer rows than shards
leave shards empty; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frozen, slots, utf8_crc32, utf8_size

BUCKETS = 512
#: A median's bucket may hold this share of its node's weight.
TOLERANCE = 2e-4
#: Levels that one plan joins up before rows are written anew.
LEVELS = 6
#: Nodes whose table is broadcast; larger ones are joined as Spark sees fit.
BROADCAST_NODES = 50_000
_MIN, _MAX = -(1 << 63), (1 << 63) - 1


def dimensions() -> dict[str, Column]:
    """The metadata of documents, as doubles; text values by a hash."""
    name = lambda c: (F.crc32(F.coalesce(F.col(c), F.lit("")).cast("binary")) / 4294967296.0).cast("double")
    return {"source": name("source"), "lang": name("lang"), "chars": F.log2(F.lit(1.0) + F.greatest(F.coalesce(F.col("n_chars"), F.lit(0)), F.lit(0))), "id": F.coalesce(F.col("doc_id"), F.lit(0)).cast("double")}


def shard(docs: DataFrame, dims: dict[str, Column], *, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, size, text_crc32, shard and slot of each row: in `shards` shards, or as many as target_bytes asks for."""
    names = [f"d{i}" for i in range(len(dims))]
    rows = docs.select(F.col(id_col).alias("id"), (utf8_size(F.col(text_col)) + 1).alias("size"), utf8_crc32(F.col(text_col)).alias("crc"), *(F.coalesce(d, F.lit(0.0)).alias(n) for n, d in zip(names, dims.values())))
    rows = rows.withColumns({"u": F.xxhash64("id", "crc"), "m": F.monotonically_increasing_id(), "node": F.lit(0).cast("long")})
    rows = frozen(rows)
    extent = [f(n).alias(f"{k}{n}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]
    whole = rows.agg(F.sum("size").alias("weight"), *extent).first()
    total = whole["weight"] or 0
    leaves = shards or max(1, math.ceil(total / target_bytes))
    spans = [max((whole[f"hi{n}"] or 0) - (whole[f"lo{n}"] or 0), 0) for n in names]
    # A node is known by the number of its first leaf.
    open_ = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("first"), F.lit(leaves).cast("long").alias("leaves"))
    many, level = int(leaves > 1 and total > 0), 0
    while many:
        near = F.broadcast if many <= BROADCAST_NODES else (lambda df: df)
        stats = rows.groupBy("node").agg(F.sum("size").alias("weight"), *extent)
        nodes, unfinished = _settled(_begin(open_.join(stats, F.col("first") == F.col("node"), "left"), names, spans), many, "not done")
        while unfinished:
            found = _median_buckets(rows, near(nodes.where("not done")), names)
            nodes, unfinished = _settled(_narrowed(nodes.join(found, "first", "left")), many, "not done")
        rows = _split(rows, near(nodes), names)
        half = F.floor(F.col("leaves") / 2)
        children = F.explode(F.array(F.struct(F.col("first"), half.alias("leaves")), F.struct((F.col("first") + half).alias("first"), (F.col("leaves") - half).alias("leaves"))))
        open_, many = _settled(nodes.select(children.alias("c")).select("c.first", "c.leaves").where("leaves > 1"), 2 * many, "true")
        level += 1
        if level % LEVELS == 0 and many:
            rows = frozen(rows)
    placed = rows.select("id", "size", "crc", F.col("node").cast("int").alias("shard"), F.shiftright("m", 33).alias("part"), "m")
    out = slots(placed, "shard", "part", ["m"], "slot")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def _settled(nodes: DataFrame, many: int, condition: str) -> tuple[DataFrame, int]:
    """(nodes computed once, how many of them meet the condition). A table of at most BROADCAST_NODES nodes goes through
    the driver, which spares writing it; a longer one is kept in the shared folder."""
    if many > BROADCAST_NODES:
        kept = frozen(nodes)
        return kept, kept.where(condition).count()
    table = nodes.withColumn("__meets", F.expr(condition)).toArrow()
    return nodes.sparkSession.createDataFrame(table.drop_columns("__meets"), nodes.schema), sum(table.column("__meets").to_pylist())


def _begin(nodes: DataFrame, names: list[str], spans: list[float]) -> DataFrame:
    """The nodes of a level before their medians are looked for.

    dim: the dimension; phase: what is bucketed, 0 the dimension, 1 the hash, 2 the place in the scan; x_low, x_high and
    w_low, w_high: its range in phase 0 and after; below: the weight before that range; x, u: the value and hash that rows
    share in phases 1 and 2; cx, cu, cm: the cut, once done.
    """
    wide = [((F.col(f"hi{n}") - F.col(f"lo{n}")) / s if s else F.lit(0.0)) for n, s in zip(names, spans)]
    dim = F.array_position(F.array(*wide), F.array_max(F.array(*wide))).cast("int") - 1
    pick = lambda k: F.get(F.array(*(F.col(f"{k}{n}") for n in names)), F.col("dim"))
    empty = F.col("weight").isNull()
    long = lambda v: F.lit(v).cast("long")
    out = nodes.withColumn("dim", F.coalesce(dim, F.lit(0)))
    return out.select(
        "first", "leaves", F.coalesce("weight", F.lit(0)).alias("weight"), "dim", F.lit(0).alias("phase"), pick("lo").alias("x_low"), pick("hi").alias("x_high"), long(_MIN).alias("w_low"), long(_MAX).alias("w_high"),
        long(0).alias("below"), F.lit(0.0).alias("x"), long(0).alias("u"), empty.alias("done"), F.lit(0.0).alias("cx"), long(_MIN).alias("cu"), long(_MIN).alias("cm"),
    )


def _pick(names: list[str]) -> Column:
    """The value of the node's dimension."""
    out = F.col(names[0])
    for i, n in enumerate(names[1:], 1):
        out = F.when(F.col("dim") == i, F.col(n)).otherwise(out)
    return out


def _target() -> Column:
    """The weight of a node's left half."""
    return F.col("weight") * F.floor(F.col("leaves") / 2) / F.col("leaves")


def _median_buckets(rows: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    """Per node: the bucket that its median falls in, with the weight before it, its own, and its least and greatest value."""
    table = nodes.select("first", "dim", "phase", "x_low", "x_high", "w_low", "w_high", F.col("x").alias("x0"), F.col("u").alias("u0"), (_target() - F.col("below")).alias("goal"))
    both = rows.join(table, F.col("node") == F.col("first")).withColumn("x", _pick(names))
    whole = F.when(F.col("phase") == 1, F.col("u")).otherwise(F.col("m"))
    early = F.col("phase") == 0
    inside = F.when(early, F.col("x").between(F.col("x_low"), F.col("x_high"))).otherwise((F.col("x") == F.col("x0")) & ((F.col("phase") == 1) | (F.col("u") == F.col("u0"))) & whole.between(F.col("w_low"), F.col("w_high")))
    value, low, high = (F.when(early, F.col(a)).otherwise(b.cast("double")) for a, b in (("x", whole), ("x_low", F.col("w_low")), ("x_high", F.col("w_high"))))
    share = F.when(high > low, (value - low) / (high - low)).otherwise(0.0)
    bucket = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1))
    sums = both.where(inside).groupBy("first", "goal", bucket.alias("bucket")).agg(F.sum("size").alias("b_weight"), F.count("*").alias("n"), F.min("x").alias("x_lo"), F.max("x").alias("x_hi"), F.min(whole).alias("w_lo"), F.max(whole).alias("w_hi"))
    # At most BUCKETS rows a node from here on.
    run = sums.withColumn("upto", F.expr("sum(b_weight) OVER (PARTITION BY first ORDER BY bucket ROWS UNBOUNDED PRECEDING)"))
    hit = run.where(F.col("upto") >= F.col("goal")).groupBy("first").agg(F.min_by(F.struct("b_weight", "n", "x_lo", "x_hi", "w_lo", "w_hi", "upto"), "bucket").alias("b"))
    return hit.select("first", "b.*")


def _narrowed(nodes: DataFrame) -> DataFrame:
    """nodes after a pass: cut at the bucket found, or its range narrowed to that bucket."""
    c = F.col
    phase, early = c("phase"), c("phase") == 0
    before = c("below") + c("upto") - c("b_weight")
    single = F.when(early, c("x_lo") == c("x_hi")).otherwise(c("w_lo") == c("w_hi"))
    ends = (c("n") == 1) | (c("b_weight") <= TOLERANCE * c("weight")) | ((phase == 2) & single)
    keeps = before + c("b_weight") - _target() <= _target() - before  # the nearer end of the bucket
    x_at, w_at = F.when(keeps, c("x_hi")).otherwise(c("x_lo")), F.when(keeps, c("w_hi")).otherwise(c("w_lo"))
    end = F.when(keeps, F.lit(_MAX)).otherwise(F.lit(_MIN))
    # Where the bucket is one value its rows are told apart by what comes next.
    on = ~ends & single
    new = {
        "done": ends,
        "cx": F.when(ends, F.when(early, x_at).otherwise(c("x"))).otherwise(c("cx")),
        "cu": F.when(ends, F.when(early, end).when(phase == 1, w_at).otherwise(c("u"))).otherwise(c("cu")),
        "cm": F.when(ends, F.when(phase == 2, F.when(keeps, w_at).otherwise(w_at - 1)).otherwise(end)).otherwise(c("cm")),
        "below": F.when(ends, c("below")).otherwise(before),
        "x": F.when(on & early, c("x_lo")).otherwise(c("x")),
        "u": F.when(on & (phase == 1), c("w_lo")).otherwise(c("u")),
        "x_low": F.when(early, c("x_lo")).otherwise(c("x_low")),
        "x_high": F.when(early, c("x_hi")).otherwise(c("x_high")),
        "w_low": F.when(on & early, F.lit(_MIN)).when(on, F.lit(0)).when(early, c("w_low")).otherwise(c("w_lo")),
        "w_high": F.when(on | early, F.lit(_MAX)).otherwise(c("w_hi")),
        "phase": F.when(on, phase + 1).otherwise(phase),
    }
    columns = [x for x in nodes.columns if x not in ("b_weight", "n", "x_lo", "x_hi", "w_lo", "w_hi", "upto")]
    new["done"] = F.coalesce(ends, F.lit(True))  # without a bucket a node keeps what it has
    return nodes.select(*(F.when(c("done") | (c("n").isNull() & F.lit(x != "done")), c(x)).otherwise(new[x]).alias(x) if x in new else c(x) for x in columns))


def _split(rows: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    table = nodes.select("first", "dim", F.floor(F.col("leaves") / 2).alias("half"), "cx", "cu", "cm")
    both = rows.join(table, F.col("node") == F.col("first"), "left")
    x = _pick(names)
    goes_left = (x < F.col("cx")) | ((x == F.col("cx")) & ((F.col("u") < F.col("cu")) | ((F.col("u") == F.col("cu")) & (F.col("m") <= F.col("cm")))))
    node = F.when(F.col("first").isNull() | goes_left, F.col("node")).otherwise(F.col("node") + F.col("half"))
    return both.withColumn("node", node).select(*rows.columns)


def shard_report(docs: DataFrame, *, shards: int = 16) -> DataFrame:
    out = shard(docs, dimensions(), shards=shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
