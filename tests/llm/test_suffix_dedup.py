import hashlib
import random

import numpy as np
import pytest

from textloom.llm import suffix_dedup as S

from . import fixtures


def plain(rows, length=50):
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        if doc is not None:
            for p in range(len(b) - length + 1):
                g = b[p : p + length]
                first[g] = min(first.get(g, doc), doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - length + 1) if doc is not None else ():
            if first[b[p : p + length]] < doc:
                gone[p + 1 : p + 1 + length] = True
        kept = bytes(c for c, g in zip(b, gone[1:]) if not g)
        out.append((doc, len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df):
    return sorted((tuple(r) for r in S.suffix_report(df).collect()), key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_edge_rows(spark, extra):
    assert run(fixtures.docs(spark, extra)) == plain([(r[0], r[1]) for r in fixtures.rows()])


def test_planted_passages(spark):
    r = random.Random(5)
    passages = [fixtures.words(n, 50 + n) for n in (9, 10, 11, 30, 200)] + ["ab" * 60, "z" * 49, "z" * 50]
    rows = []
    for i in range(60):
        parts = [fixtures.words(r.randint(0, 40), 1000 + i)]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            parts += [p[r.randint(0, 5) : len(p) - r.randint(0, 5)], fixtures.words(r.randint(0, 20), 2000 + i)]
        rows.append((100 - i if i % 2 else i, "".join(parts)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert run(df) == plain(rows)


@pytest.mark.parametrize("seed", range(2))
def test_crowded_anchors(spark, monkeypatch, seed):
    """Every shared anchor counts as crowded; tasks of a few documents see a part of a crowd each."""
    monkeypatch.setattr(S, "CROWD", 2)
    r = random.Random(seed)
    passage = fixtures.words(40, seed)
    rows = []
    for i in range(80):
        a, b = sorted((r.randint(0, len(passage)), r.randint(0, len(passage))))
        rows.append((i * 37 % 80, fixtures.words(r.randint(0, 3), i % 9) + r.choice(["", " ", "ab"]) + passage[a if r.random() < 0.4 else 0 : b if r.random() < 0.4 else None] + fixtures.words(r.randint(0, 3), i % 7)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert run(df) == plain(rows)


def test_runs_of_one_word(spark):
    """A word over and over, at many places of a text, in few and in many texts, with other text in between."""
    r = random.Random(1)
    rows = []
    for i in range(30):
        word = r.choice(["a", "ab ", "the line\n", "z" * 49 + " "])
        rows.append((i * 7 % 30, fixtures.words(r.randint(0, 6), i) + word * r.randint(20, 90) + fixtures.words(r.randint(0, 12), i) + word * r.randint(0, 40)))
    assert run(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)) == plain(rows)


def test_same_id_with_two_texts(spark):
    a, b = fixtures.words(40, 1), fixtures.words(40, 2)
    rows = [(5, a), (5, b), (7, "k" + b), (3, a)]
    assert run(spark.createDataFrame(rows, "doc_id bigint, text string")) == plain(rows)


def test_deep_shallow_orders_like_sorted():
    r = np.random.default_rng(0)
    rows = np.unique(np.concatenate([r.integers(97, 99, (300, 26), dtype=np.uint8), np.hstack([np.full((200, 20), 97, np.uint8), r.integers(97, 100, (200, 6), dtype=np.uint8)])]), axis=0)
    r.shuffle(rows)
    group = r.integers(0, 3, len(rows))
    order, common = S.deep_shallow(group, rows)
    keys = [(int(group[i]), rows[i].tobytes()) for i in order]
    assert keys == sorted(keys)
    for i in range(1, len(keys)):
        (g, a), (h, b) = keys[i - 1], keys[i]
        assert common[i] == (-1 if g != h else next((k for k in range(26) if a[k] != b[k]), 26))


@pytest.mark.parametrize("seed", range(6))
def test_multikey_quicksort_against_sorted(seed):
    r = np.random.default_rng(seed)
    n = [0, 1, 2, 50, 1000, 5000][seed]
    letters = r.integers(0, 3 + 50 * (seed % 2), (n, 3)).astype(np.uint64) * np.uint64(2**61)
    group = r.integers(0, 1 + n // 20, n)
    order, tied = S.multikey_quicksort(group, letters)
    keys = [(int(group[i]), *letters[i].tolist()) for i in order]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(n))
    assert tied.tolist() == [i > 0 and keys[i] == keys[i - 1] for i in range(n)]


def test_large_ids_beside_null_ids(spark):
    df = spark.createDataFrame(fixtures.LARGE_IDS, "doc_id bigint, text string").coalesce(1)
    assert sorted((r["doc_id"] for r in S.suffix_report(df).collect()), key=str) == sorted((d for d, _ in fixtures.LARGE_IDS), key=str)


def test_empty_table(spark):
    assert run(fixtures.none(spark)) == []
