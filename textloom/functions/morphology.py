"""Word forms: a compact part-of-speech tagger, a lemmatizer, and Porter's stemmer.

The tagger and the lemmatizer are rules and small tables, as no model or dictionary is at hand; both can be replaced
(see Morphology).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Treebank tags' first letters and the word classes that are lemmatized.
WORD_CLASSES = {"J": "a", "V": "v", "N": "n", "R": "r"}

# Irregular forms, by word class.
IRREGULAR = {
    "v": {
        "am": "be", "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be", "'m": "be",
        "has": "have", "had": "have", "does": "do", "did": "do", "done": "do", "goes": "go", "went": "go",
        "gone": "go", "said": "say", "made": "make", "took": "take", "taken": "take", "came": "come", "saw": "see",
        "seen": "see", "got": "get", "gotten": "get", "gave": "give", "given": "give", "knew": "know",
        "known": "know", "thought": "think", "found": "find", "told": "tell", "felt": "feel", "left": "leave",
        "kept": "keep", "began": "begin", "begun": "begin", "wrote": "write", "written": "write", "ran": "run",
        "brought": "bring", "bought": "buy", "stood": "stand", "heard": "hear", "lost": "lose", "met": "meet",
        "paid": "pay", "sat": "sit", "spoke": "speak", "spoken": "speak", "grew": "grow", "grown": "grow",
        "fell": "fall", "fallen": "fall", "led": "lead", "held": "hold", "meant": "mean", "became": "become",
        "slept": "sleep", "spent": "spend", "built": "build", "sent": "send", "won": "win", "ate": "eat",
        "eaten": "eat", "broke": "break", "broken": "break", "chose": "choose", "chosen": "choose", "drew": "draw",
        "drove": "drive", "driven": "drive", "flew": "fly", "forgot": "forget", "sang": "sing", "sung": "sing",
        "swam": "swim", "taught": "teach", "threw": "throw", "thrown": "throw", "wore": "wear", "worn": "wear",
    },
    "n": {
        "men": "man", "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse",
        "geese": "goose", "people": "people", "lives": "life", "wives": "wife", "knives": "knife", "leaves": "leaf",
        "selves": "self", "series": "series", "species": "species", "news": "news",
    },
    "a": {"better": "good", "best": "good", "worse": "bad", "worst": "bad", "further": "far", "farther": "far"},
    "r": {"better": "well", "best": "well", "worse": "badly", "worst": "badly"},
}

_CLOSED = {
    "DT": "the a an this that these those each every some any no all both".split(),
    "IN": "of in on at by for with from about into over after before between under against during without within through as if because while than like".split(),
    "PRP": "i you he she it we they me him her us them myself yourself himself herself itself".split(),
    "PRP$": "my your his its our their".split(),
    "CC": "and or but nor yet so".split(),
    "TO": ["to"],
    "MD": "can could will would shall should may might must 'll 'd wo".split(),
    "RB": "not n't very too also just only never always often really quite still even well here there then now again".split(),
    "WP": "who whom what which whose where when why how".split(),
    "VBZ": "is has does 's".split(),
    "VBP": "am are have do 'm 're 've".split(),
    "VBD": "was were had did".split(),
    "JJ": "good bad great big small old new long little own other same few many much first last better best worse worst".split(),
}
_KNOWN = {w: tag for tag, words in _CLOSED.items() for w in words}
_SUFFIXES = (("ly", "RB"), ("ing", "VBG"), ("ed", "VBD"), ("ous", "JJ"), ("ful", "JJ"), ("less", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("ive", "JJ"), ("ic", "JJ"), ("al", "JJ"), ("est", "JJS"))


def tag_words(words: list[str]) -> list[tuple[str, str]]:
    """(word, Treebank tag): closed classes and irregular verbs by table, others by suffix and the word before."""
    out: list[tuple[str, str]] = []
    for w in words:
        low = w.lower()
        before = out[-1][1] if out else ""
        if any(c.isdigit() for c in low):
            tag = "CD"
        elif not any(c.isalpha() for c in low) or low.startswith("<"):
            tag = "SYM"
        elif low in _KNOWN:
            tag = "POS" if low == "'s" and before.startswith("N") else _KNOWN[low]
        elif low in IRREGULAR["v"]:
            tag = "VBD"
        elif before in ("TO", "MD"):
            tag = "VB"
        elif low.endswith("s") and not low.endswith(("ss", "us", "is")):
            tag = "VBZ" if before == "PRP" else "NNS"
        else:
            tag = next((t for s, t in _SUFFIXES if low.endswith(s) and len(low) > len(s) + 2), "VBP" if before == "PRP" else "NN")
        out.append((w, tag))
    return out


def word_class(tag: str) -> str | None:
    return WORD_CLASSES.get(tag[:1])


_VOWEL = re.compile("[aeiouy]")


def _verb_stem(stem: str) -> str:
    if len(stem) > 2 and stem[-1] == stem[-2] and stem[-1] not in "lsz":
        return stem[:-1]
    if re.search(r"[^aeiou][aeiou][^aeiouwxy]$", stem) and len(re.findall("[aeiouy]+", stem)) == 1 or re.search(r"(at|iz|v|c|s|u|g|bl|tl)$", stem) and not stem.endswith(("ss", "ing")):
        return stem + "e"
    return stem


@lru_cache(50_000)
def lemma(word: str, kind: str) -> str:
    """The base form of a word of a class (n, v, a, r); a word that no rule fits stays."""
    if word in IRREGULAR[kind]:
        return IRREGULAR[kind][word]
    n = len(word)
    if kind in "nv" and n > 3 and word.endswith("s") and not word.endswith(("ss", "us", "is", "'s")):
        if word.endswith("ies") and n > 4:
            return word[:-3] + "y"
        if word.endswith(("sses", "shes", "ches", "xes", "zzes")):
            return word[:-2]
        return word[:-1]
    if kind == "v":
        if word.endswith("ied") and n > 4:
            return word[:-3] + "y"
        for end in ("ing", "ed"):
            stem = word.removesuffix(end)
            if stem != word and len(stem) > 1 and _VOWEL.search(stem):
                return _verb_stem(stem)
    if kind == "a":
        for end in ("iest", "ier"):
            if word.endswith(end) and n > len(end) + 2:
                return word.removesuffix(end) + "y"
        if word.endswith("est") and n > 5:
            return _verb_stem(word[:-3]) if word[-4] == word[-5:-4] else word[:-3]
    return word


# Porter's algorithm (1980), in its steps: endings and what they become, by step.
_STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"))
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _closed(stem: str) -> bool:
    return _shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def _replaced(word: str, endings: tuple, least: int) -> str:
    for end, new in sorted(endings, key=lambda e: -len(e[0])):
        if word.endswith(end):
            stem = word.removesuffix(end)
            return stem + new if _measure(stem) > least else word
    return word


@lru_cache(50_000)
def porter_stem(word: str) -> str:
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                stem = w.removesuffix(end)
                if "v" in _shape(stem):
                    w = stem
                    if w.endswith(("at", "bl", "iz")) or _measure(w) == 1 and _closed(w):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                        w = w[:-1]
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(w, _STEP2, 0)
    w = _replaced(w, _STEP3, 0)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w.removesuffix(end)
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _closed(w[:-1]):
            w = w[:-1]
    return w[:-1] if _measure(w) > 1 and w.endswith("ll") else w


class Morphology:
    """What happens to a text's words: lemmas (of tagged words), stems, or nothing; any part can be another function."""

    def __init__(self, lemmatizer: str | Callable | None = "wordnet", stemmer: str | Callable | None = None, tagger: Callable = tag_words):
        self.lemma = lemma if lemmatizer == "wordnet" else lemmatizer
        self.stem = porter_stem if stemmer == "porter" else stemmer
        self.tagger = tagger

    def words(self, words: list[str]) -> list[str]:
        if self.lemma:
            return [self.lemma(w, c) if (c := word_class(t)) else w for w, t in self.tagger(words)]
        return [self.stem(w) for w in words] if self.stem else words


def word_forms(column: Column | str, lemmatizer: str | None = "wordnet", stemmer: str | None = None) -> Column:
    """array<string> of words to their lemmas or stems."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Morphology(lemmatizer, stemmer)
        for b in batches:
            yield pd.Series([None if w is None else own.words(list(w)) for w in b], dtype=object)

    return run(column)


def stem_column(column: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(b: pd.Series) -> pd.Series:
        return b.map(porter_stem, na_action="ignore")

    return run(column)


def lemma_column(column: Column | str, kind: str) -> Column:
    @F.pandas_udf("string")
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda w: lemma(w, kind), na_action="ignore")

    return run(column)


def class_of_tag(column: Column | str) -> Column:
    """Native: the word class of a Treebank tag, null for tags without one."""
    pairs = [x for k, v in WORD_CLASSES.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), F.substring(F.col(column) if isinstance(column, str) else column, 1, 1))
