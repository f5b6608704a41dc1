"""Links and e-mail addresses in running text.

Three shapes are found: links with a scheme (http, https, ftp; any top-level domain), links without (specific
top-level domains only), and e-mail addresses. The search overlaps, so that two links run together come apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from importlib import resources
from itertools import zip_longest

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("scheme", "userinfo", "host", "ip_addr", "port", "path", "query", "fragment", "authority", "path_component")
LINK = "struct<entity_type:string,string:string," + ",".join(f"{f}:string" for f in FIELDS) + ">"
PARSED = f"struct<fragments:array<string>,links:array<{LINK}>>"

# Top-level domains beside the countries' codes; those that links without a scheme may have, and more
# that addresses may have.
SPECIFIC = ("com", "org", "net", "gov", "info", "edu", "biz", "mil")
GENERIC = (
    "aero", "app", "asia", "blog", "cat", "club", "coop", "dev", "email", "guru", "int", "jobs", "link", "live",
    "media", "mobi", "museum", "name", "news", "online", "post", "pro", "shop", "site", "store", "tech", "tel",
    "today", "travel", "web", "work", "world", "wiki", "xxx", "xyz",
)
#: Codes in use that the list of countries lacks.
MORE_CODES = ("ac", "eu", "su", "tp", "uk")


@cache
def country_codes() -> tuple[str, ...]:
    """Two-letter codes of countries, from the time zone data's table (tzdata, which pandas requires)."""
    table = resources.files("tzdata").joinpath("zoneinfo/iso3166.tab").read_text(encoding="utf-8")
    codes = {line.split("\t")[0].lower() for line in table.splitlines() if line and line[0] != "#"}
    return tuple(sorted(codes | set(MORE_CODES)))


_WORD_PART = r"[a-z0-9][a-z0-9\-]*(?<!-)"
_GAP = r"[^\S\n]*"
_OTHER = "\u00a0-\ud7ff\uf900-\ufdcf\ufdf0-\uffef"
_QUERY = rf"(?:[a-z0-9\-._~!$&'()*+,;=:@/?{_OTHER}]|%[0-9a-f]{{2}})*"
_TAIL = rf"(?P<path_component>(?P<path>/[^'\"?\#\s<>]*)?(?:\?(?P<query>{_QUERY}))?(?:\#(?P<fragment>{_QUERY}))?)"


def _alternatives(names: tuple[str, ...]) -> str:
    return "|".join(sorted(names, key=len, reverse=True))


def pattern(which: tuple[str, ...] = ("email", "uri"), *, require_scheme: bool = False, valid_tlds: bool = False, specific_tlds: bool = True, email_require_scheme: bool = False, email_valid_tlds: bool = True) -> str:
    known = _alternatives((*SPECIFIC, *GENERIC, *country_codes()))
    anything, puny = r"[a-z]{2,}|xn--[a-z0-9]+", r"xn--[a-z0-9]+"

    def authority(tld: str) -> str:
        spaced = rf"www{_GAP}\.{_GAP}(?:{_WORD_PART}{_GAP}\.{_GAP})+(?:com|net|info|biz|co\.uk)"
        user = rf"(?:(?P<userinfo>(?:[a-z0-9\-._~!$&'()*+,;=:{_OTHER}]|%[0-9a-f]{{2}})*)@)?"
        return rf"(?P<authority>{user}(?:(?P<host>\b(?:{_WORD_PART}\.)+(?:{tld})\b|{spaced})|(?P<ip_addr>\b(?:[0-9]{{1,3}}\.){{3}}[0-9]{{1,3}}\b))(?::(?P<port>[0-9]*))?)"

    with_scheme = rf"(?P<scheme>https?://|ftp://){authority(known if valid_tlds else anything)}"
    without = authority(f"{_alternatives((*SPECIFIC, *country_codes()))}|{puny}" if specific_tlds else anything)
    shapes = {
        "uri": rf"(?P<uri>(?:{with_scheme if require_scheme else f'{with_scheme}|{without}'}){_TAIL})",
        "email": rf"(?P<email>(?P<scheme>mailto:|e-?mail:|message:|via:){'' if email_require_scheme else '?'}(?P<authority>\b(?P<userinfo>\w+(?:[\-+.']\w+)*)@(?P<host>(?:{_WORD_PART}\.)+(?:{known if email_valid_tlds else anything}))\b){_TAIL})",
    }
    return "|".join(shapes[w] for w in which)


# What is trimmed from a link's end.
_TRAILING = regex.compile(r"""[\p{Z}\p{InGeometric_Shapes}\p{InDingbats}\p{Pd}`!\[\]{};:'".,<>?«»“”‘’]+$""")


class Links:
    def __init__(self, which: tuple[str, ...] = ("email", "uri"), **options):
        self.regex = regex.compile(pattern(which, **options), regex.IGNORECASE)

    def _link(self, m: regex.Match) -> dict:
        groups = m.groupdict()
        kinds = [k for k in ("uri", "email") if groups.get(k)]
        if len(kinds) != 1:
            raise ValueError(f"an ambiguous match: {m[0]}")
        return {"entity_type": kinds[0], "string": m[0], **{f: groups.get(f) for f in FIELDS}}

    def parse(self, text: str, overlapped: bool = True, placeholder: str | None = None) -> tuple[list[str], list[dict]]:
        """(fragments, links). The text is cut at the links; empty pieces are left out, but for the last.

        placeholder: a format that puts a mark for each link (of its entity type) among the fragments.
        """
        links: list[dict] = []
        pieces: list[str] = []

        def add(link: dict) -> None:
            links.append(link)
            if placeholder:
                pieces.append(placeholder % link["entity_type"])

        cut = before = 0
        for m in self.regex.finditer(text, overlapped=overlapped):
            start, stop = m.span()
            own = _TRAILING.sub("", m[0])
            if own != m[0]:
                stop -= 1  # however much was trimmed
                m = self.regex.search(own)
            if m and own.endswith(")") and "(" not in own:
                stop -= 1
                m = self.regex.search(own[:-1])
            if not m:
                continue
            link = self._link(m)
            if cut < start:
                pieces.append(text[cut:start])
            cut = max(cut, stop)
            if not (links and overlapped) or start >= before:
                add(link)
            elif link["scheme"] and (times := links[-1]["string"].count(link["string"])):
                # This link is the end of the one before it.
                rest = links.pop()["string"].replace(link["string"], "")
                for inner in self.regex.finditer(rest):
                    add(self._link(inner))
                for _ in range(times):
                    add(link)
            before = cut
        pieces.append(text[cut:])
        return pieces, links

    def whiteout(self, text: str, mark: str = " __%s__ ") -> str:
        """The text with a mark for each link: fragments and marks by turns, fragments first."""
        pieces, links = self.parse(text)
        turns = zip_longest(pieces, (mark % x["entity_type"] for x in links))
        return "".join(part for pair in turns for part in pair if part is not None)


@cache
def default_links() -> Links:
    return Links()


def parse_links(column: Column | str, overlapped: bool = True, placeholder: str | None = None) -> Column:
    """struct of the fragments of a text and the links found."""

    @F.pandas_udf(PARSED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = default_links()
        for b in batches:
            yield pd.DataFrame([own.parse(t or "", overlapped, placeholder) for t in b], columns=["fragments", "links"])

    return run(column)


def find_links(column: Column | str) -> Column:
    return parse_links(column)["links"]


def first_link(column: Column | str) -> Column:
    return F.get(find_links(column), F.lit(0))


def whiteout_links(column: Column | str, mark: str = " __%s__ ") -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = default_links()
        for b in batches:
            yield pd.Series([None if t is None else own.whiteout(t, mark) for t in b], dtype=object)

    return run(column)
