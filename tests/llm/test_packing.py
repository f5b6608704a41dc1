import random
import zlib

import numpy as np
import pytest

from textloom.llm import packing as P
from textloom.llm.queries import vocabulary

from . import fixtures

VOCABULARY = vocabulary()


@pytest.mark.parametrize("extra", [False, True])
def test_every_token_is_in_one_piece(spark, extra):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    got = [r.asDict() for r in P.packing_report(fixtures.docs(spark, extra), VOCABULARY).collect()]
    want = []
    for doc, text, *_ in fixtures.rows():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(doc, i, len(ids[i : i + 1024]), zlib.crc32(ids[i : i + 1024].tobytes()), len(ids)) for i in range(0, len(ids), 1024)]
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(by) == list(range(len(by)))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_long_and_special_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    texts = ["<|endoftext|>", "one <|endoftext|> two", " " * 2_000_000, "a" * 2_000_000, "\n" * 2_000_000, "a" + " \n" * 60_000, ""]
    for text, ids in zip(texts, P.load_encoder(VOCABULARY)(texts)):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text[:40]


def test_quick_encoding_stands_for_the_vocabulary():
    """Each token is what its own bytes merge to, so merging by ranks and by listed pairs comes to the same; and each
    kind of character is split alike."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    special = {token.content for token in t.get_added_tokens_decoder().values()}
    vocabulary = {token: i for token, i in t.get_vocab(with_added_tokens=True).items() if token not in special}
    assert all([x.id for x in t.model.tokenize(token)] == [i] for token, i in vocabulary.items())
    r, quick = random.Random(2), P.quick_encoding(VOCABULARY)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 61 == 0)]  # all of them were compared once
    texts = ["a{0}a 1{0}1 !{0}! {0}{0}".format(chr(c)) for c in points]
    pool = "aZ 09é  \u0085\x1c\t\n\r'sll　中😀_-\u200b\u0301ſK\xa0"
    texts += ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    for text, plain in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert quick.encode_ordinary(text) == plain.ids, repr(text)


def test_a_quick_encoding_that_differs_is_given_up():
    encode = P.Encoder(VOCABULARY)
    encode.quick = type("Wrong", (), {"encode_ordinary": lambda self, text: [1]})()
    texts = ["one two"] * 50
    assert all(x.tolist() == encode.exact("one two").tolist() for x in encode(texts)) and encode.quick is None


def test_long_texts_are_packed(spark):
    texts = {1: " " * 2_000_000, 2: "a" * 2_000_000, 3: "\n" * 2_000_000}
    got = P.packing_report(spark.createDataFrame([*texts.items()], "doc_id bigint, text string"), VOCABULARY).collect()
    for doc, ids in zip(texts, P.load_encoder(VOCABULARY)([*texts.values()])):
        own = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == doc)
        assert [s for s, _ in own] == list(range(0, len(ids) + 1, 1024)) and sum(n for _, n in own) == len(ids) + 1


def test_large_ids_beside_null_ids(spark):
    df = spark.createDataFrame(fixtures.LARGE_IDS, "doc_id bigint, text string").coalesce(1)
    assert sorted((r["doc_id"] for r in P.packing_report(df, VOCABULARY).collect()), key=str) == sorted((d for d, _ in fixtures.LARGE_IDS), key=str)


def test_least_squares_against_enumeration():
    r = np.random.default_rng(0)
    for _ in range(20):
        a, b = r.random((6, 4)), r.random(6)
        best = np.inf
        for mask in range(16):
            own = [i for i in range(4) if mask >> i & 1]
            if own:
                s = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
                if (s >= 0).all():
                    best = min(best, np.linalg.norm(a[:, own] @ s - b))
            else:
                best = min(best, np.linalg.norm(b))
        x = P.nnls(a, b)
        assert (x >= 0).all() and np.linalg.norm(a @ x - b) <= best + 1e-8


@pytest.mark.parametrize("seed", range(4))
def test_frames_place_all_pieces_with_little_padding(seed):
    r = np.random.default_rng(seed)
    lengths = np.minimum(1024, r.integers(1, 1025, 20_000) if seed % 2 else r.geometric(0.004, 20_000))
    plan = P.make_plan(np.bincount(lengths, minlength=1025), 1024)
    for frame in (lengths[:16_000], lengths[16_000:], lengths[:1], lengths[:0]):
        seq, offset, total = P.place(plan, frame)
        used = np.bincount(seq, weights=frame, minlength=total)
        assert len(used) == total and (not total or used.min() > 0 and used.max() <= 1024)
        for s in np.unique(seq)[:200]:
            own = np.argsort(offset[seq == s])
            assert offset[seq == s][own].tolist() == (np.cumsum(frame[seq == s][own]) - frame[seq == s][own]).tolist()
        if len(frame) > 1000:
            assert used.sum() / 1024 / total > 0.97


def test_sequences_follow_the_input(spark, tmp_path):
    """In each prefix of the sequences, rows come from as far into the input, but for a frame."""
    docs = spark.createDataFrame([(i, fixtures.words(20 + i * 7 % 300, i)) for i in range(1500)], "doc_id bigint, text string").coalesce(3)
    docs.write.parquet(f"{tmp_path}/in")
    cut = P.pieces(spark.read.parquet(f"{tmp_path}/in"), VOCABULARY)
    got = sorted((tuple(r) for r in P.pack(cut, frame_pieces=100).select("sequence_id", "doc_id").collect()))
    assert [s for s, _ in got][-1] == len({s for s, _ in got}) - 1 and {d for _, d in got} == set(range(1500))
    for i in range(0, len(got), 50):
        assert abs(np.mean([d for _, d in got[i : i + 50]]) - i * 1500 / len(got)) < 250


def test_empty_table(spark):
    assert P.packing_report(fixtures.none(spark), VOCABULARY).collect() == []
