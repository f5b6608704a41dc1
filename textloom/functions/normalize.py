"""Normalising text: NFKC, dashes, look-alike characters, links, case, runs of one character.

Each step is a Column of its own, native where Spark has what it takes; clean_text() does all in their fixed order in
one Arrow pass: markup, NFKC, dashes, characters, links, lower case, runs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DASHES, INVERSE_MAP
from ..operators.text import as_column
from . import html, links


def char_range(target: int, source: int, n: int) -> dict[int, int]:
    """n code points from source on, to as many from target on."""
    return {source + i: target + i for i in range(n)}


def merged(*maps: dict) -> dict:
    """Later maps win."""
    out: dict = {}
    for m in maps:
        out.update(m)
    return out


# Ranges of code points that are dropped (first, last).
DROPPED = (
    (0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0x9F), (0xAD, 0xAD), (0x17B4, 0x17B5), (0x200B, 0x200F),
    (0x202A, 0x202D), (0x2060, 0x2064), (0x206A, 0x206F), (0xFEFF, 0xFEFF), (0xFFFF, 0xFFFF), (0xFE00, 0xFE0F),
)
# Small capitals and other letters that look Latin, with their ASCII letters.
SMALL_CAPITALS = "ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ", "ABCDEFGHIJKLMNOPRSTUVWYZ"
LETTER_LIKE = "ɡℂℍℕℙℚℝℤⅅⅆⅇⅈⅉℋℐℒℳ℘ℛℬℰℱℊℓℯℴ", "gCHNPQRZDdeijHILMPRBEFgleo"


@cache
def character_map() -> dict[int, int | None]:
    """Dropped characters, full-width, circled, small capital, letter-like and Fraktur letters, and the hard space."""
    fraktur = [*range(0x1D504, 0x1D538), *range(0x1D56C, 0x1D5A0), *map(ord, "ℭℌℑℜℨ")]
    plain = {c: ord(p) for c in fraktur if len(p := unicodedata.normalize("NFKC", chr(c))) == 1 and p.isascii()}
    return merged(
        {c: None for a, b in DROPPED for c in range(a, b + 1)},
        char_range(0x21, 0xFF01, 94),
        char_range(ord("A"), 0x24B6, 26),
        char_range(ord("a"), 0x24D0, 26),
        {ord(a): ord(b) for pair in (SMALL_CAPITALS, LETTER_LIKE) for a, b in zip(*pair)},
        {0xA0: 0x20},
        plain,
    )


def inverse(pairs: dict[str, str]) -> dict[int, int]:
    """{target: sources} as a map from each source."""
    return {ord(c): ord(target) for target, sources in pairs.items() for c in sources}


def translate_chars(column: Column | str, mapping: dict[int, int | None] | None = None) -> Column:
    """Native: one character for one, or none. A map that has no ASCII target for a character drops it."""
    mapping = merged(character_map(), inverse(INVERSE_MAP)) if mapping is None else mapping
    to = [c for c, t in mapping.items() if t is not None]
    gone = [c for c, t in mapping.items() if t is None and c]  # U+0000 would end the list
    return F.translate(as_column(column), "".join(map(chr, [*to, *gone])), "".join(chr(mapping[c]) for c in to))


def replace_map(column: Column | str, pairs: dict[str, str] | None = None) -> Column:
    """Native: plain strings to plain strings, ignoring case where they have any."""
    out = as_column(column)
    for a, b in (DASHES if pairs is None else pairs).items():
        cased = a.lower() != a.upper()
        out = F.regexp_replace(out, "(?iu)" + re.escape(a), b.replace("\\", "\\\\").replace("$", "\\$")) if cased else F.replace(out, F.lit(a), F.lit(b))
    return out


def replace_all(text: str, pairs: dict[str, str | dict[str, str]]) -> str:
    """Patterns in one alternation, ignoring case; a dictionary looks the match up in lower case, or leaves it."""
    if not pairs:
        return text
    own = list(pairs.values())

    def one(m: re.Match) -> str:
        to = own[m.lastindex - 1] if m.lastindex else ""
        return to.get(m[0].lower(), m[0]) if isinstance(to, dict) else to

    return re.sub("|".join(f"({p})" for p in pairs), one, text, flags=re.IGNORECASE)


def squeeze_pattern(most: int) -> str:
    if most < 1:
        raise ValueError(f"max repeats must be 1 or more, not {most}")
    return r"([^\d\*])" + r"\1" * most + "+"


def squeeze(text: str, most: int = 3) -> str:
    return re.sub(squeeze_pattern(most), lambda m: m[1] * most, text)


def squeeze_repeats(column: Column | str, most: int = 3) -> Column:
    """Native: runs of more than `most` of one character, digits and stars apart, are cut to that; 0 or less leaves all."""
    return as_column(column) if most <= 0 else F.regexp_replace(as_column(column), "(?s)(?U)" + squeeze_pattern(most), "$1" * most)


def squeeze_count(column: Column | str, most: int = 3) -> Column:
    """Native: how many runs squeeze_repeats() cuts."""
    return F.regexp_count(as_column(column), F.lit("(?s)(?U)" + squeeze_pattern(most)))


def unicode_form(column: Column | str, form: str = "NFKC") -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if t is None else unicodedata.normalize(form, t) for t in b], dtype=object)

    return run(column)


class Cleaner:
    """All steps for one text, in order."""

    def __init__(self, settings: dict):
        self.markup = html.renderer(settings.get("html_renderer", "default"))
        if settings.get("html_renderer") == "default" and not settings.get("unescape_html", True):
            self.markup = lambda t: html.clean(t, entities=False)
        self.form = settings.get("unicode_form") or None
        self.pairs = settings.get("replace_map") or {}
        self.chars = merged(character_map(), inverse(settings.get("inverse_map") or {}))
        self.most = settings.get("max_char_repeats", 3)
        self.links = links.default_links()

    def clean(self, text: str | None, lower: bool = True) -> str:
        text = self.markup(text or "")
        if self.form:
            text = unicodedata.normalize(self.form, text)
        text = replace_all(text, self.pairs).translate(self.chars)
        text = self.links.whiteout(text)
        if lower:
            text = text.lower()
        return squeeze(text, self.most) if self.most > 0 else text


def clean_text(column: Column | str, settings: dict, lower: bool = True) -> Column:
    """settings: a preset's tokenizer settings. Null is empty."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Cleaner(settings)
        for b in batches:
            yield pd.Series([own.clean(t, lower) for t in b], dtype=object)

    return run(column)
