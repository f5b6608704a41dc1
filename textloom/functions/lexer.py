"""The feature lexer: one alternation of patterns, first match wins, each feature with its own tokens.

tokens() gives the Column; the alternation is compiled once per Python worker, texts come in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import REVIEW_FEATURES, TWITTER_FEATURES

# Number words, contraction endings and the stems that change before n't.
NUMBER_WORDS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
ENDINGS = frozenset(["ll", "d", "re", "t", "m", "ve", "s"])
STEMS = {"wo": "will", "sha": "shall", "ca": "can", "ai": "am"}

_COUNT = "|".join(NUMBER_WORDS)

# What each feature matches, in the order of the full set. Groups are numbered within their feature.
PATTERNS: dict[str, str] = {
    "CUSTOMTOKEN": r"\b__([A-Za-z]+)__\b",
    "REPLY": r"^\s*\.?\s*(?=@)",
    "CENSORED": r"\b\p{L}+(?:\*+\p{L}+)+\b",
    "EMPHASIS_B": r"\*+(\p{L}+)\*+",
    "EMPHASIS_U": r"(?<![$#@])\b_+(\p{L}+)_+\b",
    "TIMEOFDAY": r"(?<![\w\p{Sc}#])[0-2]?[0-9](?:[:\.][0-6][0-9](?:\s*[AaPp][Mm])?|(?:\s*[AaPp][Mm]))(?![\w\p{Sc}#])",
    "DATE": r"\b[0-9]+\s*\/\s*[0-9]+\s*\/\s*[0-9]+\b",
    "EMOTIC_EAST_LO": r"\(?[\+\^ˇ\*\->~](?:_+|\.)[\+\^ˇ\*\-<~]\)?",
    "EMOTIC_EAST_HI": r"\(?[\^ˇ\*][\-~oO][\^ˇ\*]\)?",
    "EMOTIC_EAST_SAD": r"\b[tTqQvV][_\.][tTqQvV]\b|;[_\.];",
    "EMOTIC_WEST_L": r"\>?(?:=|(?:[:;]|(?<![\w\(\)])[Bb])[\-=\^']?)([\(\)\*\[\]\|]+|[cCoOpPdDsSlL0xX]\b)",
    "EMOTIC_WEST_R": r"(?<!\w)([dD]|[\(\)\[\]\|]+)(?:(?:[\-=\^'][:;]?|[\-=\^']?[:;])(?![\w\(\)])|=)",
    "EMOTIC_WEST_CHEER": r"\\[om]/",
    "EMOTIC_WEST_L_MISC": r"(?<![^\p{P}\s])[;:=]([3$@\\\/]+)(?![^\s\p{P}])",
    "EMOTIC_WEST_R_MISC": r"(?<![^\p{P}\s])([$@\\\/])[:=](?![^\s\p{P}])",
    "EMOTIC_RUSS_HAPPY": r"\){2,}",
    "EMOTIC_RUSS_SAD": r"\({2,}",
    "EMOTIC_HEART": r"(?<![0-9])\<(\/?)3+\b",
    "CONTRACTION": r"\b([a-zA-Z]+)'([a-zA-Z]{1,2})\b",
    "STARRATING": r"((?:(?:\s\-)?[0-9]{1,2})|(?:\*\s?)+|" + _COUNT + r")(\.[0-9]+|[\s-]*[1-9]\s?\/\s?[1-9])?\s*(?:stars?(?:\s+rating)?)?\s*(?:\/\s*|\(?(?:out\s+)?of\s+)((?:4|5|100?|four|five|ten)\b|(?:\*\s?)+)(?:\s+stars)?",
    "STARRATING_FULL": r"\bfull\s10\b",
    "STARRATING_X": r"\b(?:a|my)\s+(\-?[0-9](?:\.[0-9])?)[\s-]+(?:star\s+)?(?:rating|for)\b",
    "MPAARATING": r"pg[-\s]?13|nc[-\s]?17",
    "GRADE_POST": r"\bgrade\s*[:-]?\s*([a-f](?:\+|\b))",
    "GRADE_PRE": r"\b([a-f]\+?)\s*-?\s*grade\b",
    "THREED": r"\b3\-?d\b",
    "DECADE": r"\b((?:18|19|20)?[0-9]0)(?:\s*'\s*)?s\b",
    "NUMBER": r"(?<!\w)([#\p{Sc}+])?\s?([0-9]+)([\s,][0-9]{3})*(\.[0-9]+)?\s?(\p{Sc}+|'?\s?s)?(?!\w)",
    "HASHTAG": r"\#[a-zA-Z_][a-zA-Z0-9_]*",
    "MENTION": r"@[a-zA-Z0-9_]+",
    "ASCIIARROW_R": r"([\-=]?\>{2,}|[\-=]+\>)",
    "ASCIIARROW_L": r"(\<{2,}[\-=]?|\<[\-=]+)",
    "MNDASH": r"\s\-\s|\-{2,3}|–|—",
    "ABBREV1": r"\b\p{L}([&\/\-\+])\p{L}\b",
    "ABBREV2": r"\b(\p{L})-(\p{L}{2,})\b",
    "ABBREV3": r"\b(?:\p{L}\.){2,}",
    "ELLIPSIS": r"(?:\.\s*){2,}|…",
    "XOXO": r"\b[xX][oO](?:\s*[xX]+[oO]?)*\b",
    "XX": r"\b[xX](?:\s*[xX])+\b",
    "PUNKT": r"::+(?!\/\/)|[!?¡¿]+|[,\.]",
    "ANYWORD": r"\w+",
}

_DIGITS = "0123456789"
#: What a text must hold for a feature to match in it: of each string one character at least. Features that ask for
#: nothing here are always tried.
NEEDS: dict[str, tuple[str, ...]] = {
    "CUSTOMTOKEN": ("_",), "REPLY": ("@",), "CENSORED": ("*",), "EMPHASIS_B": ("*",), "EMPHASIS_U": ("_",), "TIMEOFDAY": (_DIGITS,), "DATE": ("/", _DIGITS),
    "EMOTIC_EAST_LO": ("_.", "+^ˇ*->~"), "EMOTIC_EAST_HI": ("^ˇ*",), "EMOTIC_EAST_SAD": ("_.",), "EMOTIC_WEST_R": ("-=^':;",), "EMOTIC_WEST_CHEER": ("\\",),
    "EMOTIC_WEST_L_MISC": (";:=", "3$@\\/"), "EMOTIC_WEST_R_MISC": ("$@\\/", ":="), "EMOTIC_RUSS_HAPPY": (")",), "EMOTIC_RUSS_SAD": ("(",), "EMOTIC_HEART": ("<",), "CONTRACTION": ("'",),
    "STARRATING_FULL": ("1", "0"), "STARRATING_X": (_DIGITS,), "MPAARATING": ("1", "37"), "GRADE_POST": ("g",), "GRADE_PRE": ("g",), "THREED": ("3", "d"), "DECADE": ("0",), "NUMBER": (_DIGITS,),
    "HASHTAG": ("#",), "MENTION": ("@",), "ASCIIARROW_R": (">",), "ASCIIARROW_L": ("<",), "MNDASH": ("-–—",), "ABBREV1": ("&/-+",), "ABBREV2": ("-",), "ABBREV3": (".",), "ELLIPSIS": (".…",),
    "XOXO": ("xX", "oO"), "XX": ("xX",),
}
#: Alternations that a lexer keeps, one for each set of features that a text can have.
KEPT = 500

Emit = Callable[[str, str, tuple], list[str]]
_NOT_WORD, _SPACE = regex.compile(r"\W+"), regex.compile(r"\s+")


def _bare(text: str | None) -> str:
    return _NOT_WORD.sub("", text or "")


def _tight(text: str | None) -> str:
    return _SPACE.sub("", text or "")


def tag(name: str) -> str:
    return f"<{name}>"


def _face(place: int, happy: str, sad: str, keep: int) -> Emit:
    """The match, and a tag that the mouth's first (place 0) or last (-1) character decides."""

    def emit(name: str, text: str, groups: tuple) -> list[str]:
        mouth = groups[0][place]
        mood = "_HAPPY" if mouth in happy else "_SAD" if mouth in sad else ""
        return [text, tag(name[:-keep] + mood)]

    return emit


def _contraction(name: str, text: str, groups: tuple) -> list[str]:
    head, tail = groups
    if tail == "t" and head.endswith("n"):
        return [STEMS.get(head[:-1], head[:-1]), "n't"]
    return [head, f"'{tail}" if tail in ENDINGS else tail]


def _amount(text: str) -> float:
    if text in NUMBER_WORDS:
        return float(NUMBER_WORDS[text])
    return float(text.count("*") or int(text))


def half_away(x: float) -> int:
    """x rounded, halves away from zero."""
    return int(math.copysign(math.floor(abs(x) + 0.5), x))


def _out_of_ten(x: float) -> list[str]:
    return [f"<{min(11, max(0, half_away(x)))}/10>"]


def _stars(name: str, text: str, groups: tuple) -> list[str]:
    given, extra, most = groups
    n = _amount(given)
    if extra:
        top, _, bottom = extra.partition("/")
        more = float(top) / float(bottom) if bottom else float(extra)
        n += more if n >= 0 else -more
    return _out_of_ten(n * (10.0 / _amount(most)))


def _number(name: str, text: str, groups: tuple) -> list[str]:
    lead, digits, thousands, fraction, tail = _tight(groups[0]), groups[1], _bare(groups[2]), _bare(groups[3]), _tight(groups[4])
    whole = not thousands and not fraction
    ends = [tail] if tail else []
    if lead == "#" and whole:
        return ["#", "#" + digits, *ends]
    century = len(digits) == 4 and digits[0] in "12"
    if not lead and tail.endswith("s") and whole and digits.endswith("0") and (century or len(digits) == 2):
        return [digits + "s", tag("DECADE")]
    out = ([lead] if lead else []) + [tag("NUM"), tag(f"NUM_{len(digits) + len(thousands)}")]
    if fraction:
        out += [tag("FLOAT"), tag(f"FLOAT_{len(fraction)}")]
    return out + ends


def _dash(name: str, text: str, groups: tuple) -> list[str]:
    return [{"–": "--", "—": "---"}.get(text) or _tight(text)]


_only_tag: Emit = lambda name, text, groups: [tag(name)]
_marked: Emit = lambda name, text, groups: [tag(name), groups[0]]
_shouted: Emit = lambda name, text, groups: [tag(name), _tight(text).upper()]
_as_tag: Emit = lambda name, text, groups: [tag(_bare(text).upper())]
_grade: Emit = lambda name, text, groups: [tag(f"GRADE_{groups[0].upper()}")]

#: What features other than the plain ones emit: (feature, matched text, its groups) -> tokens.
HANDLERS: dict[str, Emit] = {
    "CUSTOMTOKEN": lambda name, text, groups: [tag(groups[0].upper())],
    "REPLY": lambda name, text, groups: [tag("PUBLIC")] * bool(_tight(text)) + [tag(name)],
    "EMPHASIS_B": _marked,
    "EMPHASIS_U": _marked,
    "TIMEOFDAY": _shouted,
    "DATE": _only_tag,
    "EMOTIC_EAST_SAD": lambda name, text, groups: [tag(name), text],
    "EMOTIC_WEST_L": _face(0, ")]pdPD", "([cCsSlL", 2),
    "EMOTIC_WEST_R": _face(-1, "([", ")]dD", 2),
    "EMOTIC_WEST_L_MISC": _face(0, "$3", "@\\/", 7),
    "EMOTIC_WEST_R_MISC": _face(0, "$3", "@\\/", 7),
    "EMOTIC_HEART": lambda name, text, groups: [text, tag(name + ("_SAD" if groups[0] else "_HAPPY"))],
    "CONTRACTION": _contraction,
    "STARRATING": _stars,
    "STARRATING_FULL": lambda name, text, groups: ["<10/10>"],
    "STARRATING_X": lambda name, text, groups: _out_of_ten(float(groups[0])),
    "MPAARATING": _as_tag,
    "GRADE_POST": _grade,
    "GRADE_PRE": _grade,
    "THREED": _as_tag,
    "DECADE": lambda name, text, groups: [_bare(text).lower()],
    "NUMBER": _number,
    "HASHTAG": lambda name, text, groups: [tag(name), text, text[1:]],
    "MENTION": _only_tag,
    "ASCIIARROW_R": _only_tag,
    "ASCIIARROW_L": _only_tag,
    "MNDASH": _dash,
    "ELLIPSIS": lambda name, text, groups: ["..." if text == "…" else _tight(text)],
    "XOXO": _shouted,
    "XX": _shouted,
}


class Lexer:
    """The alternation of `features` (unknown names are left out) and what each emits."""

    def __init__(self, features: Iterable[str] = tuple(PATTERNS), patterns: dict[str, str] | None = None, handlers: dict[str, Emit] | None = None):
        patterns = PATTERNS | (patterns or {})
        self.handlers = HANDLERS | (handlers or {})
        self.features = tuple(f for f in features if f in patterns)
        self.patterns = {f: patterns[f] for f in self.features}
        self.needs = [tuple(map(frozenset, NEEDS.get(f, ()))) if self.patterns[f] == PATTERNS.get(f) else () for f in self.features]
        self.kept: dict[tuple, tuple] = {}

    def _alternation(self, text: str) -> tuple:
        """The pattern of the features that can match in text, and the groups within each; a feature that can't changes
        no other's matches."""
        chars = set(text)
        able = tuple(f for f, needs in zip(self.features, self.needs) if not any(n.isdisjoint(chars) for n in needs))
        if able not in self.kept:
            if len(self.kept) >= KEPT:
                self.kept = {}
            own = regex.compile("|".join(f"(?P<{f}>{self.patterns[f]})" for f in able) or "(?!)", regex.DOTALL)
            first = {f: own.groupindex[f] for f in able}
            ends = [*list(first.values())[1:], own.groups + 1]
            self.kept[able] = own, {f: range(a + 1, b) for (f, a), b in zip(first.items(), ends)}
        return self.kept[able]

    def matches(self, text: str) -> Iterator[tuple[str, str, int, int]]:
        """(token, feature, start, end), in order."""
        pattern, inner = self._alternation(text)
        for m in pattern.finditer(text):
            name = m.lastgroup
            emit = self.handlers.get(name)
            for token in emit(name, m[0], m.group(0, *inner[name])[1:]) if emit and inner[name] else emit(name, m[0], ()) if emit else (m[0],):
                yield token, name, m.start(), m.end()

    def tokens(self, text: str | None) -> list[str]:
        return [t for t, *_ in self.matches(text or "")]


@cache
def lexer(features: tuple[str, ...]) -> Lexer:
    return Lexer(features)


FEATURE_SETS = {"reviews": REVIEW_FEATURES, "twitter": TWITTER_FEATURES, "all": tuple(PATTERNS)}


def tokens(text: Column | str, features: str | Iterable[str] = "reviews") -> Column:
    """array<string> of a text column; features: a set's name or names of features in order. Null gives an empty array."""
    names = FEATURE_SETS[features] if isinstance(features, str) else tuple(features)

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = lexer(names)
        for b in batches:
            yield pd.Series([own.tokens(t) for t in b], dtype=object)

    return run(text)


def token_matches(text: Column | str, features: str | Iterable[str] = "reviews") -> Column:
    """Like tokens(), with each token's feature and place in the text."""
    names = FEATURE_SETS[features] if isinstance(features, str) else tuple(features)

    @F.pandas_udf("array<struct<token:string,feature:string,start:int,end:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = lexer(names)
        for b in batches:
            yield pd.Series([[{"token": t, "feature": f, "start": s, "end": e} for t, f, s, e in own.matches(x or "")] for x in b], dtype=object)

    return run(text)
