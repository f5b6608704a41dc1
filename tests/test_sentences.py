import pytest
from pyspark.sql import functions as F

from textloom.functions.splitter import ALPHA, LETTER, Model, words
from textloom.functions import morphology as M
from textloom.operators import sentences as S
from textloom.plans import pipelines

TEXT = "The ferry of Capt. Olsen left at noon.  Gulls followed it to the bay.  a small one stayed behind."
NESTED = '"Was the tide low?"  (It was the\nlowest of the year.) "[So they say at the pier.]" {It rose at six!}'


def test_split():
    own = Model(abbreviations=frozenset(["mr", "capt"]))
    assert own.sentences(TEXT) == TEXT.split("  ")
    # Closing signs belong to the sentence before them.
    assert own.sentences(NESTED) == ['"Was the tide low?"', "(It was the\nlowest of the year.)", '"[So they say at the pier.]"', "{It rose at six!}"]
    assert own.sentences(NESTED, realign=False)[1].startswith('"')
    for a, b in zip(own.spans(TEXT), own.sentences(TEXT)):
        assert TEXT[slice(*a)] == b
    assert [x["reason"] for x in own.decisions("Mr. Smith came. He left.")][0] == "default decision"
    assert " ".join(own.rebuilt("One two. Three four.")) == "One two. Three four."
    assert own.sentences_of_tokens(["aa", "bb.", "Cc"]) == [["aa", "bb."], ["Cc"]]
    assert [str(w) for w in own.annotate(words("Mr. X went... ok."))] == ["Mr.<A>", "X", "went", "...<E>", "ok.<S>"]


def test_a_lower_case_word_after_an_ellipsis_is_no_break():
    own = Model(contexts={"so": 1 << 5})
    assert len(own.sentences("He waited... so long.")) == 1


@pytest.fixture(scope="module")
def corpus(spark):
    texts = []
    for i in range(60):
        texts.append(f"Yesterday Dr. Brown met Mrs. Smith{i} in town. The man said he saw the dog. However it was fine, e.g. this one. The town has one dog that came there and the end of it. The end came.")
    return spark.createDataFrame(list(enumerate(texts)), "doc long, t string")


def test_learning_finds_abbreviations(spark, corpus):
    learned = S.learn(S.word_table(corpus, "doc", "t"))
    own = learned.model()
    assert {"dr", "mrs"} <= own.abbreviations and "town" not in own.abbreviations
    assert len(own.sentences("Then Dr. Brown left. The dog ran.")) == 2


def test_learning_does_not_depend_on_partitions(spark, corpus, tmp_path):
    one, many = (S.learn(S.word_table(corpus.repartition(n), "doc", "t")) for n in (1, 7))
    assert one.model() == many.model()
    one.save(str(tmp_path / "m"))
    assert S.load(spark, str(tmp_path / "m")).model() == pipelines.load_sentence_model(spark, str(tmp_path / "m")) == one.model()
    assert pipelines.load_sentence_model(spark, str(tmp_path / "none")) is None


def test_native_properties_are_those_of_words(spark):
    texts = ["Mr. Öl paid 1,000.50 ... A. x", "One line.\n\n  Ä new paragraph (no. ٣) -5. É.\nits ß line", "", None, "ǅ ª Ⅷ _x_ 3rd a.b. U.S.", "\n\n\t\nend"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, t string")
    columns = ["doc", "pos", "tok", "type", "period_final", "parastart", "linestart", "is_number", "is_initial", "is_alpha", "is_non_punct", "case"]
    got = [tuple(r) for r in S.word_table(docs, "doc", "t").select(columns).orderBy("doc", "pos").collect()]
    plain = lambda w: (w.tok, w.type, w.period_final, bool(w.parastart), bool(w.linestart), w.is_number, w.is_initial, bool(ALPHA.match(w.tok)), bool(LETTER.search(w.type)), w.case)
    assert got == [(d, i, *plain(w)) for d, t in enumerate(texts) for i, w in enumerate(words(t or ""))]


def test_counts_are_mergeable(spark, corpus):
    w = S.word_table(corpus, "doc", "t")
    halves = [S.type_counts(w.where(F.col("doc") % 2 == i)) for i in (0, 1)]
    assert sorted(S.merged_counts(*halves).collect()) == sorted(S.type_counts(w).collect())


def test_morphology():
    assert M.Morphology().words("the gull 's cries were n't loud".split()) == ["the", "gull", "'s", "cry", "be", "n't", "loud"]
    for w, want in {"caresses": "caress", "ponies": "poni", "agreed": "agre", "motoring": "motor", "hopping": "hop", "relational": "relat", "vietnamization": "vietnam", "controll": "control", "sky": "sky", "electrical": "electr"}.items():
        assert M.porter_stem(w) == want
    assert [M.lemma(w, "v") for w in ("making", "stopped", "watches", "went", "tried")] == ["make", "stop", "watch", "go", "try"]
    assert M.Morphology(None, "porter").words(["ponies"]) == ["poni"] and M.Morphology(None).words(["x"]) == ["x"]


def test_model_of_texts(spark):
    texts = [f"Dr. Lee met Dr. Wu at {i} p.m. They talked. It rained." for i in range(40)]
    model = S.model_of_texts(spark, texts)
    assert "dr" in model.abbreviations and len(model.sentences("Dr. Lee came. It rained.")) == 2
