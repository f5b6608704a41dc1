import random
import re
from itertools import combinations

import numpy as np
import pytest

from textloom.llm import ngram_join as J

from . import fixtures

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_sets(texts, n=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    return out


def plain_components(rows, percent=75):
    sets = plain_sets([t for _, t in rows])
    part, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if rows[i][0] is not None and rows[j][0] is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
            part[top(j)] = top(i)
            links[i] += 1
            links[j] += 1
    out = []
    for i, (doc, _) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), None if doc is None else min(same), links[i]))
    return sorted(out, key=str)


def test_shingle_sets_match_words():
    texts = [t or "" for _, t, *_ in fixtures.rows()]
    tokens, cut = J.shingle_sets([t.encode() for t in texts])
    assert np.diff(cut).tolist() == [len(s) for s in plain_sets(texts)]
    own = [frozenset(tokens[a:b].tolist()) for a, b in zip(cut, cut[1:])]
    for (a, x), (b, y) in combinations(zip(own, plain_sets(texts)), 2):
        assert len(a & b) == len(x & y)


def test_bitmaps_bound_the_difference():
    r = np.random.default_rng(0)
    for _ in range(50):
        a = np.unique(r.integers(0, 2**63, 300, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:250], r.integers(0, 2**63, 40, dtype=np.uint64)]))
        x, y = J.bitmap(a), J.bitmap(b)
        assert len(x) == len(y) and sum(int(v & (2**64 - 1)).bit_count() for v in (x ^ y).tolist()) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("extra", [False, True])
def test_edge_rows(spark, extra):
    got = sorted((tuple(r) for r in J.shingle_components(fixtures.docs(spark, extra)).collect()), key=str)
    assert got == plain_components([(r[0], r[1]) for r in fixtures.rows()])


def test_random_chains_of_edits(spark):
    r = random.Random(3)
    rows, base = [], [fixtures.words(60, s).split() for s in range(4)]
    passage = fixtures.words(30, 99).split()
    for i in range(120):
        w = list(base[i % 4])
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice("pqrstuv") * 3
        if r.random() < 0.3:
            w += passage
        if r.random() < 0.2:
            w = w[: r.randint(3, 50)]
        rows.append((i, " ".join(w)))
    got = sorted((tuple(x) for x in J.shingle_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == plain_components(rows)


def test_empty_table(spark):
    assert J.shingle_components(fixtures.none(spark)).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_groups_over_blocks_parts_and_summaries(spark, monkeypatch, seed):
    """Groups of edited copies, at every distance from their text, with blocks and segments of a few sets."""
    for name, value in (("HOT_ROWS", 3), ("SEGMENT_ROWS", 900), ("BLOCK_TOKENS", 300), ("ASK_ROWS", 4), ("VISIT_ROWS", 5), ("LIST_ROWS", 2)):
        monkeypatch.setattr(J, name, value)
    r = random.Random(seed)
    rows = []
    for g in range(3):
        base = fixtures.words(70, 10 * seed + g).split()
        for i in range(60):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 2, 3, 4, 6])):
                w[r.randrange(len(w))] = f"e{r.randrange(12)}"
            rows.append((1000 * g + i, " ".join(w[: r.choice([70, 70, 64, 58])])))
    rows += [(r[0] + 500, r[1]) for r in rows[::20]] + [rows[0], (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    got = sorted((tuple(x) for x in J.shingle_components(df).collect()), key=str)
    assert got == plain_components(rows)
