import random

import pytest

from textloom.config import REVIEW_FEATURES, TWITTER_FEATURES, preset
from textloom.functions.lexer import Lexer, PATTERNS, lexer
from textloom.plans.pipelines import WordTokenizer


@pytest.fixture(scope="module")
def reviews():
    return WordTokenizer(preset("reviews")["tokenizer"])


@pytest.fixture(scope="module")
def twitter():
    return WordTokenizer(preset("twitter")["tokenizer"])


NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]


@pytest.mark.parametrize("shape", ["{}/10", "{} / 10", "{} out of 10", "{} of 10", "{} stars out of 10"])
@pytest.mark.parametrize("n", [1, 4, 10])
def test_ratings_out_of_ten(reviews, shape, n):
    assert f"<{n}/10>" in reviews.words("Altogether: " + shape.format(n))


@pytest.mark.parametrize("n", range(1, 6))
def test_ratings_in_words_and_stars_are_scaled(reviews, n):
    assert f"<{2 * n}/10>" in reviews.words(f"worth {NUMBER_WORDS[n]} stars out of five")
    assert f"<{2 * n}/10>" in reviews.words(f"Stars: {'*' * n} out of *****")
    assert f"<{2 * n}/10>" in reviews.words(f"worth {'*' * n} out of five stars") or n < 2


@pytest.mark.parametrize("text, want", [("worth 1 1/2 stars out of five", "<3/10>"), ("Altogether 4.6/10", "<5/10>"), ("a total of 55/100", "<6/10>"), ("20 out of 10", "<11/10>"), ("a -3 out of 10", "<0/10>")])
def test_ratings_are_rounded_and_bounded(reviews, text, want):
    assert want in reviews.words(text)


@pytest.mark.parametrize("grade", ["A", "B", "C+", "D", "F"])
def test_grades(reviews, grade):
    assert f"<GRADE_{grade}>" in reviews.words(f"Overall grade: {grade}.")
    assert f"<GRADE_{grade}>" in reviews.words(f"that Grade {grade} picnic")
    assert f"<GRADE_{grade[0]}>" in reviews.words(f"that {grade[0]}-grade picnic")


FACES = {"<EMOTIC_WEST_HAPPY>": [eyes + nose + mouth for eyes in ":=" for nose in ("", "-", "^") for mouth in ")]" if eyes == ":" or not nose], "<EMOTIC_WEST_SAD>": [eyes + nose + mouth for eyes in ":=" for nose in ("", "-", "^") for mouth in "([" if eyes == ":" or not nose]}


@pytest.mark.parametrize("mood", FACES)
def test_faces(reviews, mood):
    for face in FACES[mood]:
        assert reviews.words(f"sailing {face} today") == ["sail", face, mood, "today"], face


def test_mirrored_and_eastern_faces_come_back(reviews):
    for text in ("(: [: ): ]:", "*_* -_- t_t ;_; (^_^)"):
        assert " ".join(w for w in reviews.words(text) if not w.startswith("<EMOTIC")) == text
    assert reviews.words("tea <3 coffee </3")[1::2] == ["<EMOTIC_HEART_HAPPY>", "</3"] or "<EMOTIC_HEART_SAD>" in reviews.words("tea <3 coffee </3")


@pytest.mark.parametrize("text", ["rows (4 to 6) hold 9", "a list (of eight): -  end", "gap ( inside ) here", "time 8) no"])
def test_brackets_and_numbers_make_no_face(text):
    assert not [f for _, f, *_ in lexer(REVIEW_FEATURES).matches(text) if f == "EMOTIC_HEART"]
    if not text.startswith("time"):
        assert not [f for _, f, *_ in lexer(REVIEW_FEATURES).matches(text) if f.startswith("EMOTIC")]


@pytest.mark.parametrize("text, want", [
    ("the ferry wasn't late", ["the", "ferry", "be", "n't", "late"]), ("Kim's boat", ["kim", "'s", "boat"]), ("Q&A at the U.N.", ["q&a", "at", "the", "u.n."]),
    ("rain--then sun", ["rain", "--", "then", "sun"]), ("rain \u2013 then \u2014 sun", ["rain", "--", "then", "---", "sun"]), ("wow!!!!!!", ["wow", "!!!"]),
    ("a *splash* and a _dive_", ["a", "<EMPHASIS_B>", "splash", "and", "a", "<EMPHASIS_U>", "dive"]), ("north ==> south <== east", ["north", "<ASCIIARROW_R>", "south", "<ASCIIARROW_L>", "east"]),
    ("see http://example.net/x or kim@example.net", ["see", "<URI>", "or", "<EMAIL>"]), ("in 3D and 3-D", ["in", "<3D>", "and", "<3D>"]), ("what a b**ch", ["what", "a", "b**ch"]),
])
def test_words_of_a_sentence(reviews, text, want):
    assert reviews.words(text) == want


@pytest.mark.parametrize("day", ["1", "17"])
def test_dates(reviews, day):
    assert "<DATE>" in reviews.words(f"sailed 5/{day}/21, back soon")


def test_sentences(reviews):
    from textloom.functions.splitter import Model

    own = WordTokenizer(preset("reviews")["tokenizer"], Model())
    got = own.sentences("Gulls circle. Terns dive! Who eats?")
    assert [s[-1] for s in got] == [".", "!", "?"] and len(got) == 3
    assert reviews.sentences("Gulls circle. Terns dive.") == [sum(own.sentences("Gulls circle. Terns dive."), [])]


def test_twitter(twitter):
    names = ["@gull", "@tern2", "@sea_lion"]
    words = twitter.words("hello " + " and ".join(names) + " at kim@example.net")
    assert words.count("<MENTION>") == len(names) and words.count("<EMAIL>") == 1
    assert twitter.words("@gull hello")[0] == "<REPLY>"
    for kisses, sign in (("xx", "<XX>"), ("xxx", "<XX>"), ("xoxo", "<XOXO>")):
        assert sign in twitter.words(f"bye {kisses}")
    assert "<TIMEOFDAY>" in twitter.words("boards 9:15 sharp") and "<TIMEOFDAY>" not in twitter.words("costs $9.15")
    assert twitter.words("#lowtide")[0] == "<HASHTAG>"


@pytest.mark.parametrize("value", [3, 42, 9000])
def test_numbers(value):
    tokens = lexer(TWITTER_FEATURES).tokens
    assert tokens(f"{value:,}")[0] == "<NUM>" and tokens(f"${value}")[0] == "$"
    assert tokens(f"${value}.25")[-2:] == ["<FLOAT>", "<FLOAT_2>"]
    assert tokens(f"#{value}") == ["#", f"#{value}"]


def test_decades():
    for text, word in (("1920s", "1920s"), ("30's", "30s")):
        assert lexer(TWITTER_FEATURES).tokens(text) == [word, "<DECADE>"]


@pytest.mark.parametrize("features", [REVIEW_FEATURES, TWITTER_FEATURES, tuple(PATTERNS)])
def test_features_left_out_for_a_text_change_nothing(monkeypatch, features):
    r = random.Random(3)
    pool = "ab xXoO tTdDgrade10 /-'@#_*.()[]:;=<>^\\$3 !?&+–—…ˇ~\n"
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 14))) for _ in range(4000)]
    found = [list(Lexer(features).matches(t)) for t in texts[:1]] + [list(x) for x in map(Lexer(features).matches, texts[1:])]
    monkeypatch.setattr("textloom.functions.lexer.NEEDS", {})
    whole = Lexer(features)
    assert found == [list(whole.matches(t)) for t in texts] and len(whole.kept) == 1


def test_unknown_features_are_left_out_and_handlers_can_be_replaced():
    assert Lexer(["NOPE", "ANYWORD"]).features == ("ANYWORD",)
    assert Lexer(["ANYWORD"], handlers={"ANYWORD": lambda name, text, groups: [text.upper()]}).tokens("a b") == ["A", "B"]
    assert len(PATTERNS) == 41 and Lexer().tokens(None) == []
