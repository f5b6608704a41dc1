import math
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from textloom.llm import pfair_mix as P

from . import fixtures


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 333, "b": 1, "c": 1, "d": 665}, {f"s{i}": i + 1 for i in range(40)}, {"big": 500, **{f"s{i}": 10 for i in range(50)}}])
def test_every_source_is_within_one_block_at_every_slot(weights):
    order, period = P.edf_period(weights), sum(weights.values())
    assert len(order) == period
    done = dict.fromkeys(weights, 0)
    for t, s in enumerate(order, 1):
        done[s] += 1
        i = done[s]
        # Within its window: after its release time, up to its deadline.
        assert math.floor(Fraction((i - 1) * period, weights[s])) < t <= math.ceil(Fraction(i * period, weights[s]))
        assert all(abs(done[x] - Fraction(t * w, period)) < 1 for x, w in weights.items())


def test_turns_use_every_block_once():
    turns = P.make_turns({"a": 1000, "b": 37, "c": 400}, {"a": 0.5, "b": 0.3, "c": 0.2})
    slots = []
    for t in turns:
        for i in range(t.end - t.start):
            slots.append((t.base + i // len(t.slots) * t.period + t.slots[i % len(t.slots)], t.source, t.start + i))
    assert sorted(s[0] for s in slots) == list(range(1437))
    for s, n in (("a", 1000), ("b", 37), ("c", 400)):
        assert [x[2] for x in sorted(slots) if x[1] == s] == list(range(n))


def slots_of(turns):
    return {(t.source, t.start + i): t.base + i // len(t.slots) * t.period + t.slots[i % len(t.slots)] for t in turns for i in range(t.end - t.start)}


def test_small_targets_are_kept_within_one_block():
    weights = {"a": 0.6, "b": 0.3994, "c": 0.0006}
    got = slots_of(P.make_turns({"a": 60_000, "b": 39_940, "c": 60}, weights))
    assert sorted(got.values()) == list(range(100_000))
    for (s, i), t in got.items():
        assert abs(i + 1 - weights[s] * (t + 1)) < 1 + 1e-6 and abs(i - weights[s] * t) < 1 + 1e-6


def test_dues_hold_where_sources_end():
    blocks = {f"s{i}": 1 + i * i % 97 for i in range(700)}
    weights = {s: n**0.5 for s, n in blocks.items()}
    got = slots_of(P.make_turns(blocks, weights))
    total = sum(blocks.values())
    assert len(got) == total and sorted(got.values()) == list(range(total))
    for (s, i), t in list(got.items())[::50]:
        for v, at in ((i / weights[s], 0), ((i + 1) / weights[s], 1)):
            due = sum(min(blocks[x], weights[x] * v) for x in blocks)
            assert t > due - 1 - 1e-6 if at == 0 else t < due + 1e-6 + 1


def test_every_source_is_scheduled(spark):
    df = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.concat(F.lit("s"), F.col("id") % 300).alias("source"))
    first = {f"s{i}": (3.0 if i == 299 else 1.0) for i in range(300)}
    for weights in (None, first):
        rows = P.mix(df, weights, block_rows=1).orderBy("position").collect()
        assert [r["position"] for r in rows] == list(range(1200))
        ranks = {}
        for r in rows:
            ranks.setdefault(r["source"], []).append((r["block"], r["position"]))
        # Each source has blocks of its own, 0 to 3, in the order of the mix.
        assert len(ranks) == 300 and all([b for b, _ in own] == [0, 1, 2, 3] for own in ranks.values())
    assert ranks["s299"][3][1] < 450


@pytest.mark.parametrize("extra", [False, True])
def test_rows_are_kept(spark, extra):
    df = fixtures.docs(spark, extra)
    got = P.mix(df, block_rows=2)
    assert got.columns == [c for c in df.columns if c not in ("block", "position")] + ["block", "position"]
    rows = got.collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in rows) == sorted((r[0] or -1, r[1] or "") for r in fixtures.rows()) and len({r["position"] for r in rows}) == len(rows)
    kept = P.mixed(df, block_rows=2)
    assert kept.columns == df.columns and kept.count() == len(fixtures.rows())


def test_weights_hold_while_sources_last(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("source"))
    rows = P.mix(df, {"a": 0.6, "b": 0.4}, block_rows=10).orderBy("position").collect()
    for t in range(10, 1600, 10):
        share = sum(r["source"] == "b" for r in rows[:t])
        assert abs(share - 0.4 * t) < 10
    again = P.mix(df.repartition(3), {"a": 0.6, "b": 0.4}, block_rows=10).orderBy("position").collect()
    assert [r["doc_id"] for r in rows] == [r["doc_id"] for r in again]


def plain_mix(rows, temperature=0.5, size=32):
    """Source, block and position of rows (id, source): at each slot the source furthest behind among those whose next
    block is released; what is due is found by bisection."""
    blocks = Counter(s for _, s in rows)
    blocks = {s: -(-n // size) for s, n in blocks.items()}
    weights = {s: Counter(x for _, x in rows)[s] ** temperature for s in blocks}

    def due(s, t):
        """Blocks of s due before slot t: weights' shares, none beyond a source's own number."""
        low, high = 0.0, max(blocks[x] / weights[x] for x in blocks)
        for _ in range(200):
            v = (low + high) / 2
            low, high = (v, high) if sum(min(blocks[x], weights[x] * v) for x in blocks) < t else (low, v)
        return min(blocks[s], weights[s] * high)

    return blocks, due


def test_report_against_dues(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = P.mixing_report(docs, block_rows=4).collect()
    rows = [(r["doc_id"], r["source"]) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["source"]) for r in got), key=str) == sorted(rows, key=str)
    blocks, due = plain_mix(rows, size=4)
    at = {}
    for r in got:
        at.setdefault((r["source"], r["block"]), []).append(r["position"])
    assert set(at) == {(s, b) for s, n in blocks.items() for b in range(n)}
    slots = {k: {p // 4 for p in v} for k, v in at.items()}
    assert all(len(v) == 1 for v in slots.values()) and sorted(t for v in slots.values() for t in v) == list(range(sum(blocks.values())))
    for (s, b), own in slots.items():
        (t,) = own
        assert due(s, t + 1) > b - 1e-6 and due(s, t) < b + 1 + 1e-6  # released, and not late


def test_blocks_grow_where_there_would_be_too_many(spark, monkeypatch):
    monkeypatch.setattr(P, "MAX_BLOCKS", 10)
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("source"))
    rows = P.mix(df).collect()
    assert {(r["source"], r["block"]) for r in rows} == {("a", i) for i in range(8)} | {("b", i) for i in range(3)}


def test_filter_on_position(spark):
    out = P.mixing_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    every = sorted(r["position"] for r in out.collect())
    assert sorted(r["position"] for r in out.where("position < 100").collect()) == [p for p in every if p < 100]
    assert sorted(r["position"] for r in out.where("position > 100 and block = 1").collect()) == sorted(r["position"] for r in out.collect() if r["position"] > 100 and r["block"] == 1)


def test_large_ids_beside_null_ids(spark):
    df = spark.createDataFrame([(d, t, "a") for d, t in fixtures.LARGE_IDS], "doc_id bigint, text string, source string").coalesce(1)
    assert sorted((r["doc_id"] for r in P.mixing_report(df).collect()), key=str) == sorted((d for d, _ in fixtures.LARGE_IDS), key=str)


def test_empty_table(spark):
    assert P.mixing_report(fixtures.none(spark)).collect() == [] and P.mixed(fixtures.none(spark)).collect() == []
