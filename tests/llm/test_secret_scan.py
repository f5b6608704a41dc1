import hashlib
import math
import random
import re
from collections import Counter

import pytest

from textloom.llm import secret_scan as S

from . import fixtures


def plain_base(text):
    found = []
    pattern = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [("assign", *m.span()) for m in re.finditer(pattern, text) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


TEXTS = [
    "password = 'hunter22' token:abc", 'API_KEY="AbC123+/=" x', "apikey = 12345", "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 16, "f" * 23 + " " + "0a" * 12, "secret: " + "ab" * 20, "ſecret=abcdefg toKen=abcdefg", "passwordpassword=longvalue1",
    "key Zx9Qw3Er7Ty1Ui5Op0As8Df6 end", "id 123e4567-e89b-12d3-a456-426614174000 ok", "😀 token = äöü123456 token=abcdef", "", None,
]


def test_base_spans_are_the_plain_ones():
    r = random.Random(1)
    alphabet = "pasword=tkenAKI0f9\"' :_api"
    for text in [t or "" for t in TEXTS] + ["".join(r.choice(alphabet) for _ in range(200)) for _ in range(300)]:
        spans = S.Scanner().spans(text)
        assert [s for s in spans if s[0] != "entropy"] == plain_base(text)


def test_windows_by_counting_anew():
    r = random.Random(2)
    for _ in range(200):
        run = "".join(r.choice("abcdef0123456789XYZ") for _ in range(r.randint(5, 60)))
        w, bits = 20, r.choice([2.5, 3.2, 3.6])
        want = []
        for i in range(len(run) - w + 1):
            part = run[i : i + w]
            h = -sum(c / w * math.log2(c / w) for c in Counter(part).values())
            if h >= bits - 1e-9 and sum(c.isdigit() for c in part) >= 2 and sum(c.isalpha() for c in part) >= 2:
                if want and i <= want[-1][1]:
                    want[-1][1] = i + w
                else:
                    want.append([i, i + w])
        assert [list(x) for x in S.entropy_windows(run, w, bits)] == want


def test_random_keys_are_found_and_plain_words_are_not():
    s = S.Scanner()
    assert any(k == "entropy" for k, *_ in s.spans("key Zx9Qw3Er7Ty1Ui5Op0As8Df6 end"))
    for text in ("id 123e4567-e89b-12d3-a456-426614174000 ok", "internationalization-and-localization", "see release-candidate-2024 now", fixtures.words(300, 1)):
        assert s.spans(text) == []


@pytest.mark.parametrize("extra", [False, True])
def test_report_and_redaction(spark, extra):
    df = fixtures.docs(spark, extra)
    rows = [*fixtures.rows(), *((100 + i, t, None, None, None) for i, t in enumerate(TEXTS))]
    both = df.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows[len(fixtures.rows()) :], fixtures.DOCS))
    got = {(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in S.secret_report(both).collect()}
    want = set()
    for doc, text, *_ in rows:
        base = plain_base(text or "")
        n = Counter(k for k, *_ in base)
        want.add((doc, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()))
    assert got == want
    out = S.redact(both)
    assert out.columns == both.columns
    texts = {r["doc_id"]: r for r in out.collect()}
    assert "hunter22" not in texts[100]["text"] and texts[100]["n_chars"] == len(texts[100]["text"]) and texts[113]["text"] is None
    clean = {r[0]: r[1] for r in fixtures.rows() if r[0] is not None}
    assert all(texts[d]["text"] == t for d, t in clean.items())
    if extra:
        assert S.redact(df).columns == df.columns


def test_clashing_columns(spark):
    df = fixtures.docs(spark, True)
    assert sorted(map(str, S.secret_report(df).collect())) == sorted(map(str, S.secret_report(fixtures.docs(spark)).collect()))


def test_keys_of_letters_need_a_class_that_asks_for_no_digits():
    key = "key QwErTyUiOpAsDfGhJkLzXcVb end"
    assert S.Scanner().spans(key) == []
    assert S.Scanner((S.EntropyClass("letters", "A-Za-z", 20, 4.0, digits=0),)).spans(key)


def test_large_ids_beside_null_ids(spark):
    df = spark.createDataFrame(fixtures.LARGE_IDS, "doc_id bigint, text string").coalesce(1)
    assert sorted((r["doc_id"] for r in S.secret_report(df).collect()), key=str) == sorted((d for d, _ in fixtures.LARGE_IDS), key=str)


def test_empty_table(spark):
    assert S.secret_report(fixtures.none(spark)).collect() == [] and S.redact(fixtures.none(spark)).collect() == []
