"""Presets, as plain dictionaries that are passed on explicitly."""

from __future__ import annotations

from copy import deepcopy

# The features of each preset, in the order in which they are tried.
REVIEW_FEATURES = (
    "CUSTOMTOKEN", "CENSORED", "EMPHASIS_B", "EMPHASIS_U", "TIMEOFDAY", "DATE", "EMOTIC_EAST_LO", "EMOTIC_EAST_HI",
    "EMOTIC_EAST_SAD", "EMOTIC_WEST_L", "EMOTIC_WEST_R", "EMOTIC_WEST_CHEER", "EMOTIC_WEST_L_MISC",
    "EMOTIC_WEST_R_MISC", "EMOTIC_RUSS_HAPPY", "EMOTIC_RUSS_SAD", "EMOTIC_HEART", "CONTRACTION", "STARRATING",
    "STARRATING_FULL", "STARRATING_X", "MPAARATING", "GRADE_POST", "GRADE_PRE", "THREED", "DECADE", "ASCIIARROW_R",
    "ASCIIARROW_L", "MNDASH", "ABBREV1", "ABBREV2", "ABBREV3", "ELLIPSIS", "XOXO", "PUNKT", "ANYWORD",
)
TWITTER_FEATURES = (
    "CUSTOMTOKEN", "REPLY", "CENSORED", "EMPHASIS_B", "EMPHASIS_U", "TIMEOFDAY", "DATE", "EMOTIC_EAST_LO",
    "EMOTIC_EAST_HI", "EMOTIC_EAST_SAD", "EMOTIC_WEST_L", "EMOTIC_WEST_R", "EMOTIC_WEST_CHEER", "EMOTIC_WEST_L_MISC",
    "EMOTIC_WEST_R_MISC", "EMOTIC_RUSS_HAPPY", "EMOTIC_RUSS_SAD", "EMOTIC_HEART", "CONTRACTION", "MPAARATING",
    "GRADE_POST", "GRADE_PRE", "THREED", "NUMBER", "HASHTAG", "MENTION", "ASCIIARROW_R", "ASCIIARROW_L", "MNDASH",
    "ABBREV1", "ABBREV2", "ABBREV3", "ELLIPSIS", "XOXO", "XX", "PUNKT", "ANYWORD",
)

# Characters that are replaced by one character, by target; dashes that become ASCII.
INVERSE_MAP = {
    "@": "\uff20",
    "#": "\uff03",
    "'": "\u0060\u2018\u2019\u201a\u201b\u275b\u275c",
    '"': "\u201c\u201d\u201e\u201f\u275d\u275e",
    "x": "\u00d7",
}
DASHES = {"\u2013": "--", "\u2014": "---"}

# Abbreviations that the sentence model always knows; words that must not count as sentence starters.
ABBREVIATIONS = (
    "c.s.i", "m.i.a", "d.j", "p.c", "st", "d.c", "n.y.c", "l.a", "s.f", "bros", "v", "co", "u.s", "dr", "vs", "jr",
    "sr", "ms", "mr", "mrs", "prof", "inc", "pron", "col", "lt", "gen", "sgt",
)
NOT_STARTERS = ("seuss", "strangelove", "jekyll", "moreau", "hackenstein", "blandings", "atoz", "john")

_TOKENIZER = {
    "features": TWITTER_FEATURES,
    "unicode_form": "NFKC",
    "max_char_repeats": 3,
    "html_renderer": "default",
    "unescape_html": True,
    "inverse_map": INVERSE_MAP,
    "replace_map": DASHES,
    "abbreviations": ABBREVIATIONS,
    "not_starters": NOT_STARTERS,
    "lemmatizer": "wordnet",
    "stemmer": None,
}
_SOURCE = {"sep": ",", "quote": '"', "header": True, "encoding": "UTF-8"}

PRESETS: dict[str, dict] = {
    "twitter": {
        "data": {"labeled": {"Y": "Sentiment", "X": "SentimentText"}, "unlabeled": {}, "options": _SOURCE},
        "tokenizer": _TOKENIZER,
        "preprocess": {"sample_labeled": None, "sample_unlabeled": None, "random_state": 0},
        "pretrain": {"algorithm": "word2vec", "embedding": "word2vec", "split_by_sentence": False, "labels": ("sentence",)},
        "train": {"sample_labeled": {0: 30000, 1: 30000}, "test_size": 0.2, "random_state": 0, "classifier": "svm", "scoring": "accuracy", "features": ("bow", "embedding"), "stop_words": None},
        "word2vec": {"size": 400, "min_count": 40, "window": 20, "sample": 0.001, "sg": 1, "seed": 1337},
        "doc2vec": {"size": 400, "min_count": 40, "window": 20, "sample": 0.001, "dm": 1, "seed": 1337},
        "glove": {"size": 400, "learning_rate": 0.04, "epochs": 20, "window": 40},
    },
}
PRESETS["reviews"] = deepcopy(PRESETS["twitter"]) | {"data": {"labeled": {"Y": "sentiment", "X": "review"}, "unlabeled": {"X": "review"}, "options": _SOURCE | {"sep": "\t", "escape": "\\"}}}
PRESETS["reviews"]["tokenizer"] = _TOKENIZER | {"features": REVIEW_FEATURES}
PRESETS["headerless"] = deepcopy(PRESETS["reviews"]) | {"data": {"labeled": {"Y": 0, "X": 1}, "unlabeled": {"X": 0}, "options": _SOURCE | {"sep": "\t", "header": False}}}


def preset(name: str, **tokenizer) -> dict:
    """A copy of a preset; keyword arguments override its tokenizer's settings."""
    out = deepcopy(PRESETS[name])
    out["tokenizer"] |= tokenizer
    return out


def lookup(config: dict, path: str):
    """The value at a dotted path of keys."""
    for key in path.split("."):
        config = config[key]
    return config
