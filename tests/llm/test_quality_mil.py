import math
import zlib

import numpy as np
import pytest

from textloom.llm import quality_mil as Q

from . import fixtures


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = Q.quality_report(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def test_scores_in_blocks_equal_scores_alone():
    r = np.random.default_rng(0)
    bags = [Q.passage_features(bytes(r.integers(97, 120, r.integers(1, 3000), dtype=np.uint8))) for _ in range(40)]
    model = Q.fit(bags, np.arange(40) % 2, epochs=2)
    texts = [b"", b"a", bytes(r.integers(0, 256, 5000, dtype=np.uint8)), b"x" * Q.PASSAGE, b"y" * (Q.PASSAGE * Q.BLOCK + 17)]
    together = model.scores(texts)
    for t, s in zip(texts, together):
        h, a = model.encode(Q.passage_features(t))
        e = np.exp(a - a.max())
        one = Q._sigmoid((e[:, None] * h).sum(axis=0) / e.sum() @ model.c + model.c0[0])
        assert abs(one - s) < 1e-5


def plain_features(passage):
    """Features of one passage, counted one by one."""
    n = max(1, len(passage))
    out = [0.0] * Q.FEATURES
    for b in passage:
        out[b] += 1
    for a, b in zip(passage, passage[1:]):
        out[256 + ((a * 40503 + b * 2654435761) >> 7) % Q.PAIRS] += 1
    out = [math.sqrt(x / n) for x in out]
    four = {((a * 73856093 ^ b * 19349663 ^ c * 83492791 ^ d * 2654435761) >> 5) % Q.VARIETY for a, b, c, d in zip(passage, passage[1:], passage[2:], passage[3:])}
    out[-2], out[-1] = len(four) / max(1, len(passage) - 3), len(passage) / (len(passage) + Q.HALF)
    return out


def plain_score(m, text):
    """The forward pass of gated attention, passage by passage."""
    sig = lambda z: 1 / (1 + math.exp(-z))
    hs, weights = [], []
    for at in range(0, max(1, len(text)), Q.PASSAGE):
        x = plain_features(text[at : at + Q.PASSAGE])
        x = [(v - mean) * scale * x[-1] for v, mean, scale in zip(x, m.mean, m.scale)]
        h = [math.tanh(sum(v * w for v, w in zip(x, column)) + b) for column, b in zip(m.w.T, m.b)]
        gate = [math.tanh(sum(v * w for v, w in zip(h, c))) * sig(sum(v * w for v, w in zip(h, d))) for c, d in zip(m.v.T, m.u.T)]
        hs.append(h)
        weights.append(math.exp(sum(g * a for g, a in zip(gate, m.a))))
    z = [sum(w * h[k] for w, h in zip(weights, hs)) / sum(weights) for k in range(len(m.c))]
    return sig(sum(v * c for v, c in zip(z, m.c)) + m.c0[0])


def test_scores_against_a_plain_forward_pass(spark):
    docs = fixtures.docs(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, quality int")
    model = Q.train(docs, labels.where(~Q.held_out("doc_id")))
    got = {r["doc_id"]: r["score"] for r in Q.quality_report(docs, labels).collect()}
    for doc, text, *_ in fixtures.rows():
        if doc is not None:
            assert abs(got[doc] - plain_score(model, (text or "").encode())) < 1e-4, doc


def test_repeated_ids_and_many_passages(spark):
    texts = [(i % 6, fixtures.words(40 + 30 * (i % 5), i)) for i in range(30)] + [(7, fixtures.words(5000, 9))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id bigint, quality int")
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    scores = [sorted((r["doc_id"], round(r["score"], 5)) for r in Q.quality_report(x, labels, train_passages=3).collect()) for x in (df.coalesce(1), df.repartition(5), df.orderBy("text"))]
    assert scores[0] == scores[1] == scores[2]
    whole = Q.passage_features(texts[-1][1].encode())
    own = Q.spread_features(texts[-1][1].encode(), 3)
    assert len(own) == 3 and (own[0] == whole[0]).all() and (own[-1] == whole[-1]).all()


def test_gradient_by_differences():
    r = np.random.default_rng(1)
    bags = [r.random((n, 5)) for n in (1, 3, 2)]
    y = np.array([0.0, 1.0, 1.0])
    p = {"w": r.normal(size=(5, 4)), "b": r.normal(size=4), "v": r.normal(size=(4, 3)), "u": r.normal(size=(4, 3)), "a": r.normal(size=3), "c": r.normal(size=4), "c0": r.normal(size=1)}

    def loss():
        total = 0
        for x, t in zip(bags, y):
            h = np.tanh(x @ p["w"] + p["b"])
            a = (np.tanh(h @ p["v"]) * Q._sigmoid(h @ p["u"])) @ p["a"]
            e = np.exp(a - a.max())
            s = Q._sigmoid((e[:, None] * h).sum(axis=0) / e.sum() @ p["c"] + p["c0"][0])
            total -= t * np.log(s) + (1 - t) * np.log(1 - s)
        return total / len(y)

    g = Q._gradient(p, bags, y)
    for k, v in p.items():
        i = tuple(r.integers(0, n) for n in v.shape)
        old, step = v[i], 1e-6
        v[i] = old + step
        up = loss()
        v[i] = old - step
        down = loss()
        v[i] = old
        assert abs((up - down) / (2 * step) - g[k][i]) < 1e-6


@pytest.mark.parametrize("extra", [False, True])
def test_edge_rows(spark, extra):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(3, None, 0), (5, 0, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = Q.quality_report(fixtures.docs(spark, extra), labels).collect()
    assert len(got) == len(fixtures.rows()) and all(0 <= r["score"] <= 1 for r in got)
    for few in (labels.limit(0), labels.where("quality = 1")):
        got = Q.quality_report(fixtures.docs(spark, extra), few).collect()
        assert len({r["score"] for r in got}) == 1


def test_empty_table(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    assert Q.quality_report(fixtures.none(spark), labels).collect() == []
