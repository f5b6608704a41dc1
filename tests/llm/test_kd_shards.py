import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import kd_shards as K

from . import fixtures


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("extra", [False, True])
def test_every_row_has_a_gapless_slot(spark, extra):
    got = rows_of(K.shard_report(fixtures.docs(spark, extra)))
    want = sorted((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in fixtures.rows()[:-1])
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] is not None) == want
    assert len(got) == len(fixtures.rows())
    for s in range(16):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_sizes_are_near_equal_with_one_value_everywhere(spark):
    """All rows agree in source, language and length, and a third in id and text too."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    got = rows_of(K.shard_report(df).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")))
    assert len(got) == 16 and max(r["n"] for r in got) - min(r["n"] for r in got) <= 4


def test_sizes_are_near_equal_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = rows_of(K.shard_report(docs).groupBy("shard").agg(F.sum("size").alias("b")))
    most = docs.agg(F.max(F.octet_length("text"))).first()[0]
    assert len(got) == 16 and max(r["b"] for r in got) - min(r["b"] for r in got) <= 4 * most


@pytest.mark.parametrize("shards", [11])
def test_against_a_plain_tree(spark, shards):
    """Each node is split across its widest dimension, by one threshold of (value, hash), as near to its share of the
    weight as one row or the tolerance allows."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dims = K.dimensions()
    size = F.octet_length("text") + 1
    own = docs.select("doc_id", F.xxhash64("doc_id", K.utf8_crc32(F.col("text"))).alias("u"), size.alias("weight"), *(c.alias(n) for n, c in dims.items()))
    rows = [r.asDict() for r in K.shard(docs, dims, shards=shards).select("doc_id", "shard").join(own, "doc_id").collect()]
    whole = {n: max(r[n] for r in rows) - min(r[n] for r in rows) for n in dims}

    def check(inside, first, leaves):
        if leaves == 1:
            return
        half = leaves // 2
        extents = [(max(r[n] for r in inside) - min(r[n] for r in inside)) / whole[n] for n in dims]
        n = list(dims)[extents.index(max(extents))]
        left, right = ([r for r in inside if (r["shard"] < first + half) == side] for side in (True, False))
        key = lambda r: (r[n], r["u"])
        assert max(map(key, left)) <= min(map(key, right))
        total, got = sum(r["weight"] for r in inside), sum(r["weight"] for r in left)
        edge = max(max(left, key=key)["weight"], min(right, key=key)["weight"])
        assert abs(got - total * half / leaves) <= max(edge, K.TOLERANCE * total)
        check(left, first, half)
        check(right, first + half, leaves - half)

    assert len(rows) == docs.count()
    check(rows, 0, shards)


def test_leaves_are_boxes(spark, sf_dir):
    """The first split is one threshold of one dimension, up to ties in it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dims = {"chars": F.col("n_chars").cast("double")}
    out = K.shard(docs, dims, shards=2).join(docs.select("doc_id", "n_chars"), "doc_id")
    low, high = (out.where(F.col("shard") == s).agg(F.min("n_chars"), F.max("n_chars")).first() for s in (0, 1))
    assert low[1] <= high[0]


def test_target_bytes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    total = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    assert K.shard(docs, K.dimensions(), target_bytes=total // 5).select("shard").distinct().count() == 6


def test_empty_table(spark):
    assert K.shard_report(fixtures.none(spark)).collect() == []
