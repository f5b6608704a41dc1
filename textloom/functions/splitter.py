"""Sentence boundaries by an unsupervised model: words with flags, and the splitter that applies a model.

Model is a small record that goes to the workers; operators.sentences learns one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that end sentences, stand inside them, or split words; how words and contexts look.
SENTENCE_ENDS = (".", "?", "!")
INTERNAL = ",:;"
CLOSING = re.compile(r'["\')\]}]+?(?:\s+|(?=--)|$)', re.MULTILINE)
_NO_START = r"[^\(\"\`{\[:;&\#\*@\)}\]\-,]"
_NOT_IN_WORDS = r"(?:[?!)\";}\]\*:@\'\({\[])"
_MANY = r"(?:\-{2,}|\.{2,}|(?:\.\s){2,}\.)"
WORDS = re.compile(rf"({_MANY}|(?={_NO_START})\S+?(?=\s|$|{_NOT_IN_WORDS}|{_MANY}|,(?=$|\s|{_NOT_IN_WORDS}|{_MANY}))|\S)")
CONTEXT = re.compile(rf"\S*[{re.escape(''.join(SENTENCE_ENDS))}](?=(?P<after>{_NOT_IN_WORDS}|\s+(?P<next>\S+)))")
ELLIPSIS = re.compile(r"\.\.+$")
NUMERIC = re.compile(r"^-?[\.,]?\d[\d,\.-]*\.?$")
INITIAL = re.compile(r"[^\W\d]\.$")
ALPHA = re.compile(r"[^\W\d]+$")
LETTER = re.compile(r"[^\W\d]")
NUMBER = "##number##"

# Bits of a word's orthographic contexts.
BEGIN_UPPER, MIDDLE_UPPER, UNKNOWN_UPPER, BEGIN_LOWER, MIDDLE_LOWER, UNKNOWN_LOWER = (1 << i for i in range(1, 7))
UPPER = BEGIN_UPPER | MIDDLE_UPPER | UNKNOWN_UPPER
LOWER = BEGIN_LOWER | MIDDLE_LOWER | UNKNOWN_LOWER
BIT_NAMES = {BEGIN_UPPER: "BEG-UC", MIDDLE_UPPER: "MID-UC", UNKNOWN_UPPER: "UNK-UC", BEGIN_LOWER: "BEG-LC", MIDDLE_LOWER: "MID-LC", UNKNOWN_LOWER: "UNK-LC"}

# Why a decision was made.
DEFAULT = "default decision"
COLLOCATION = "known collocation (both words)"
ABBR_ORTHO = "abbreviation + orthographic heuristic"
ABBR_STARTER = "abbreviation + frequent sentence starter"
INITIAL_ORTHO = "initial + orthographic heuristic"
INITIAL_SPECIAL = "initial + special orthographic heuristic"


def word_type(tok: str) -> str:
    return NUMERIC.sub(NUMBER, tok.lower())


@dataclass(slots=True)
class Word:
    """A token and what is known of it; flags are None until decided."""

    tok: str
    parastart: bool | None = None
    linestart: bool | None = None
    sentbreak: bool | None = None
    abbr: bool | None = None
    ellipsis: bool | None = None
    type: str = field(default="", init=False)

    def __post_init__(self) -> None:
        self.type = word_type(self.tok)

    @property
    def period_final(self) -> bool:
        return self.tok.endswith(".")

    @property
    def bare(self) -> str:
        """The type without its final period."""
        return self.type[:-1] if len(self.type) > 1 and self.type.endswith(".") else self.type

    @property
    def key(self) -> str:
        """The type, without its period if that ends a sentence."""
        return self.bare if self.sentbreak else self.type

    @property
    def case(self) -> str:
        c = self.tok[0]
        return "lower" if c.islower() else "upper" if c.isupper() else "none"

    @property
    def is_initial(self) -> bool:
        return bool(INITIAL.match(self.tok))

    @property
    def is_number(self) -> bool:
        return self.type.startswith(NUMBER)

    def __str__(self) -> str:
        return self.tok + "<A>" * bool(self.abbr) + "<E>" * bool(self.ellipsis) + "<S>" * bool(self.sentbreak)


def lines_of_words(text: str) -> Iterator[tuple[bool, list[str]]]:
    """Each line that is not empty: whether it starts a paragraph, and its words."""
    blank = False
    for line in text.split("\n"):
        if not line.strip():
            blank = True
            continue
        yield blank, WORDS.findall(line)
        blank = False


def words(text: str) -> Iterator[Word]:
    """Words of a text, line by line; the first after an empty line starts a paragraph."""
    for paragraph, own in lines_of_words(text):
        for i, tok in enumerate(own):
            yield Word(tok, *((paragraph, True) if i == 0 else ()))


@dataclass(frozen=True)
class Model:
    abbreviations: frozenset[str] = frozenset()
    collocations: frozenset[tuple[str, str]] = frozenset()
    starters: frozenset[str] = frozenset()
    contexts: dict[str, int] = field(default_factory=dict)

    def adjusted(self, add_abbreviations: Iterable[str] = (), drop_starters: Iterable[str] = ()) -> Model:
        return Model(self.abbreviations | set(add_abbreviations), self.collocations, self.starters - set(drop_starters), self.contexts)

    def context_names(self, key: str) -> list[str]:
        return [n for b, n in BIT_NAMES.items() if self.contexts.get(key, 0) & b]

    def first_pass(self, w: Word) -> Word:
        """Flags that follow from a word alone."""
        if w.tok in SENTENCE_ENDS:
            w.sentbreak = True
        elif ELLIPSIS.match(w.tok):
            w.ellipsis = True
        elif w.period_final and not w.tok.endswith(".."):
            stem = w.tok[:-1].lower()
            w.abbr = stem in self.abbreviations or stem.rpartition("-")[2] in self.abbreviations or None
            w.sentbreak = None if w.abbr else True
        return w

    def starts_sentence(self, w: Word) -> bool | None:
        """What the cases that a word was seen in say; None: nothing."""
        if w.tok in (";", ":", ",", ".", "!", "?"):
            return False
        seen = self.contexts.get(w.key, 0)
        if w.case == "upper" and seen & LOWER and not seen & MIDDLE_UPPER:
            return True
        if w.case == "lower" and (seen & UPPER or not seen & BEGIN_LOWER):
            return False
        return None

    def second_pass(self, w: Word, after: Word | None) -> str | None:
        """Decide a word with a final period by what follows; the reason, if there is one."""
        if after is None or not w.period_final:
            return None

        def decide(ends: bool, why: str) -> str:
            w.sentbreak = ends
            if not ends:
                w.abbr = True
            return why

        if (w.bare, after.key) in self.collocations:
            return decide(False, COLLOCATION)
        starts = self.starts_sentence(after)
        if (w.abbr or w.ellipsis) and not w.is_initial:
            if starts:
                return decide(True, ABBR_ORTHO)
            if after.case == "upper" and after.key in self.starters:
                return decide(True, ABBR_STARTER)
        if w.is_initial or w.bare == NUMBER:
            if starts is False:
                return decide(False, INITIAL_ORTHO)
            if starts is None and w.is_initial and after.case == "upper" and not self.contexts.get(after.key, 0) & LOWER:
                return decide(False, INITIAL_SPECIAL)
        return None

    def annotate(self, tokens: Iterable[Word]) -> list[Word]:
        out = [self.first_pass(w) for w in tokens]
        for i, w in enumerate(out):
            self.second_pass(w, out[i + 1] if i + 1 < len(out) else None)
        return out

    def _breaks(self, context: str) -> bool:
        return any(w.sentbreak for w in self.annotate(words(context))[:-1])

    def spans(self, text: str, realign: bool = True) -> list[tuple[int, int]]:
        """Places of the sentences; realign: closing quotes and brackets belong to the sentence before them."""
        cuts, start = [], 0
        for m in CONTEXT.finditer(text):
            if self._breaks(m[0] + m["after"]):
                cuts.append((start, m.end()))
                start = m.start("next") if m["next"] else m.end()
        cuts.append((start, len(text)))
        if not realign:
            return cuts
        out, moved = [], 0
        for i, (a, b) in enumerate(cuts):
            a += moved
            moved = 0
            if i + 1 < len(cuts) and (m := CLOSING.match(text[slice(*cuts[i + 1])])):
                out.append((a, cuts[i + 1][0] + len(m[0].rstrip())))
                moved = m.end()
            elif text[a:b]:
                out.append((a, b))
        return out

    def sentences(self, text: str, realign: bool = True) -> list[str]:
        return [text[a:b] for a, b in self.spans(text, realign)]

    def sentences_of_tokens(self, tokens: Iterable[str]) -> list[list[str]]:
        out: list[list[str]] = [[]]
        for w in self.annotate(Word(t) for t in tokens):
            out[-1].append(w.tok)
            if w.sentbreak:
                out.append([])
        return out if out[-1] else out[:-1]

    def rebuilt(self, text: str) -> list[str]:
        """Sentences from all words' flags, with the text's own white space."""
        out, at, begun = [], 0, None
        for w in self.annotate(words(text)):
            m = re.compile(r"\s*(" + r"\s*".join(map(re.escape, w.tok)) + ")").match(text, at)
            begun = m.start(1) if begun is None else begun
            at = m.end()
            if w.sentbreak:
                out.append(text[begun:at])
                begun = None
        return out + ([text[begun:at]] if begun is not None else [])

    def decisions(self, text: str) -> list[dict]:
        """A record for each candidate, with what spoke for or against a break."""
        out = []
        for m in CONTEXT.finditer(text):
            context = m[0] + m["after"]
            toks = [self.first_pass(w) for w in words(context)]
            while toks and not toks[0].tok.endswith(SENTENCE_ENDS):
                toks.pop(0)
            if len(toks) < 2:
                continue
            one, two = toks[:2]
            row = {"period_index": m.end() - 1, "text": context, "type1": one.type, "type2": two.type, "type1_in_abbrs": bool(one.abbr), "type1_is_initial": one.is_initial, "type2_is_sent_starter": two.key in self.starters, "type2_ortho_heuristic": {True: "True", False: "False", None: "unknown"}[self.starts_sentence(two)], "type2_ortho_contexts": self.context_names(two.key), "collocation": (one.key, two.key) in self.collocations}
            reason = self.second_pass(one, two)
            out.append(row | {"reason": reason or DEFAULT, "break_decision": bool(one.sentbreak)})
        return out


SPANS = "array<struct<start:int,end:int,text:string>>"
DECISIONS = "array<struct<period_index:int,text:string,type1:string,type2:string,type1_in_abbrs:boolean,type1_is_initial:boolean,type2_is_sent_starter:boolean,type2_ortho_heuristic:string,type2_ortho_contexts:array<string>,collocation:boolean,reason:string,break_decision:boolean>>"


def _mapped(f, column: Column | str, kind: str) -> Column:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([f(t or "") for t in b], dtype=object)

    return run(column)


def sentence_spans(column: Column | str, model: Model, realign: bool = True) -> Column:
    return _mapped(lambda t: [{"start": a, "end": b, "text": t[a:b]} for a, b in model.spans(t, realign)], column, SPANS)


def split_sentences(column: Column | str, model: Model | None, realign: bool = True) -> Column:
    """array<string>; without a model a text is one sentence."""
    return _mapped(lambda t: model.sentences(t, realign) if model else [t], column, "array<string>")


def sentence_decisions(column: Column | str, model: Model) -> Column:
    return _mapped(model.decisions, column, DECISIONS)
