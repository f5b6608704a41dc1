"""HTML: a tolerant event lexer, entity unescaping, and rendering to text.

One pattern tells the constructs apart; each text is lexed in one go. As the lexer is not closed by default, an
unterminated tail (a tag, an entity, a script) is lost; close=True gives it as data.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.entities import name2codepoint

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.text import native_replace

EVENTS = "array<struct<pos:int,event:string,name:string,attrs:array<struct<k:string,v:string>>,data:string>>"
RAW_TEXT = ("script", "style")

# Names, attributes and references, as the lexer accepts them.
_NAME = r"[a-zA-Z][^\t\n\r\f />\x00]*"
_ATTRIBUTE = r"""((?<=['"\s/])[^\s/>][^\s/=>]*)(\s*=+\s*('[^']*'|"[^"]*"|(?!['"])[^>\s]*))?(?:\s|/(?!>))*"""
_ENTITY = r"&(#?[xX]?(?:[0-9a-fA-F]+|\w{1,8}));"

#: An attribute as above, without its groups.
_ANY_ATTRIBUTE = r"""(?:(?<=['"\s/])[^\s/>][^\s/=>]*)(?:\s*=+\s*(?:'[^']*'|"[^"]*"|(?!['"])[^>\s]*))?(?:\s|/(?!>))*"""

_CONSTRUCT = regex.compile(
    r"(?P<start><" + _NAME + r"(?:[\s/]*(?:" + _ANY_ATTRIBUTE + r")*)?\s*)"
    r"|(?P<end></(?:\s*[a-zA-Z]|\Z))"
    r"|(?P<comment><!--)"
    r"|(?P<pi><\?)"
    r"|(?P<section><!\[)"
    r"|(?P<decl><!(?i:doctype))"
    r"|(?P<bogus><!)"
    r"|&\#(?P<charref>[0-9]+|[xX][0-9a-fA-F]+)(?=[^0-9a-fA-F]);?"
    r"|(?P<badref>&\#)"
    r"|&(?P<entityref>[a-zA-Z][-.a-zA-Z0-9]*)(?=[^a-zA-Z0-9]);?"
    r"|(?P<openref>&[a-zA-Z])"
    r"|(?P<lone>[<&])"
)
_NEXT = regex.compile("[&<]")
_TAG_NAME = regex.compile(f"({_NAME})(?:\\s|/(?!>))*")
_ATTRIBUTES = regex.compile(_ATTRIBUTE)
_END_TAG = regex.compile(r"</\s*([a-zA-Z][-.a-zA-Z0-9:_]*)\s*>")
_COMMENT_END = regex.compile(r"--\s*>")
_SECTION_NAME = regex.compile(r"[a-zA-Z][-_.a-zA-Z0-9]*")
_ENTITIES = regex.compile(_ENTITY)
_FULL_COMMENT = regex.compile(r"(?s)<!--(.*?)-->[\n]?")


class HTMLError(ValueError):
    """Markup that the lexer gives up on, with its line and column."""

    def __init__(self, message: str, text: str, at: int):
        line = text.count("\n", 0, at) + 1
        super().__init__(f"{message}, at line {line}, column {at - (text.rfind(chr(10), 0, at) + 1) + 1}")


def unescape(text: str) -> str:
    """Numeric references and HTML 4 names (and apos) that end in a semicolon; others stay."""

    def one(m: regex.Match) -> str:
        body = m[1]
        if body.startswith("#"):
            try:
                return chr(int(body[2:], 16) if body[1:2] in ("x", "X") else int(body[1:]))
            except (ValueError, OverflowError):
                return m[0]
        return "'" if body == "apos" else chr(name2codepoint[body]) if body in name2codepoint else m[0]

    return _ENTITIES.sub(one, text)


Event = tuple[str, str | None, list[tuple[str, str | None]], str | None]


class _Reader:
    """A position in a text; each method reads one construct and returns where it ends, or -1 if it does not."""

    def __init__(self, text: str):
        self.text = text
        self.raw: str | None = None  # the element whose text is being read as it is
        self.events: list[Event] = []

    def data(self, text: str) -> None:
        if text:
            self.events.append(("data", None, [], text))

    def until(self, mark: str, at: int, event: str, start: int) -> int:
        end = self.text.find(mark, at)
        if end >= 0:
            self.events.append((event, None, [], self.text[start:end]))
            return end + len(mark)
        return -1

    def start(self, at: int, end: int) -> int:
        text, following = self.text, self.text[end : end + 1]
        if following == ">":
            end += 1
        elif text.startswith("/>", end):
            end += 2
        elif following in ("", "/", "=") or following.isascii() and following.isalpha():
            return -1
        name = _TAG_NAME.match(text, at + 1)
        attrs, k = [], name.end()
        while k < end and (m := _ATTRIBUTES.match(text, k)):
            value = m[3] if m[2] else None
            if value and value[0] in "'\"" and value[0] == value[-1]:
                value = value[1:-1]
            attrs.append((m[1].lower(), unescape(value) if value else value))
            k = m.end()
        close = text[k:end].strip()
        tag = name[1].lower()
        if close not in (">", "/>"):
            self.data(text[at:end])
        elif close == "/>":
            self.events.append(("startendtag", tag, attrs, None))
        else:
            self.events.append(("starttag", tag, attrs, None))
            if tag in RAW_TEXT:
                self.raw = tag
        return end

    def end(self, at: int) -> int:
        stop = self.text.find(">", at + 1) + 1
        if not stop:
            return -1
        whole = _END_TAG.match(self.text, at)
        if whole and self.raw in (None, whole[1].lower()):
            self.events.append(("endtag", whole[1].lower(), [], None))
            self.raw = None
            return stop
        if self.raw:
            self.data(self.text[at:stop])
            return stop
        if name := _TAG_NAME.match(self.text, at + 2):
            self.events.append(("endtag", name[1].lower(), [], None))
            return self.text.find(">", name.end()) + 1
        return self.until(">", at + 2, "comment", at + 2)

    def comment(self, at: int) -> int:
        m = _COMMENT_END.search(self.text, at + 4)
        if not m:
            return -1
        self.events.append(("comment", None, [], self.text[at + 4 : m.start()]))
        return m.end()

    def section(self, at: int) -> int:
        name = _SECTION_NAME.match(self.text, at + 3)
        if not name:
            raise HTMLError("a section without a name", self.text, at)
        word = name[0].lower()
        if word not in ("temp", "cdata", "ignore", "include", "rcdata", "if", "else", "endif"):
            raise HTMLError("an unknown section", self.text, at)
        end = regex.compile(r"\]\s*>" if word in ("if", "else", "endif") else r"\]\s*\]\s*>").search(self.text, at + 3)
        if not end:
            return -1
        self.events.append(("unknown decl", None, [], self.text[at + 3 : end.start()]))
        return end.end()


def events(text: str, close: bool = False) -> list[Event]:
    """(event, name, attributes, data) of each construct, in order; pieces of data that touch are one."""
    r, at, n = _Reader(text), 0, len(text)
    while at < n:
        if r.raw:
            m = regex.compile(rf"(?i)</\s*{r.raw}\s*>").search(text, at)
            if not m:
                break
        else:
            m = _NEXT.search(text, at)
        here = m.start() if m else n
        r.data(text[at:here])
        at = here
        if at == n:
            break
        m = _CONSTRUCT.match(text, at)
        kind = m.lastgroup
        if kind == "lone":
            if at + 1 == n and not close:
                break
            r.data(text[at])
            at += 1
            continue
        if kind in ("charref", "entityref"):
            r.events.append((kind, None, [], m[kind]))
            at = m.end()
            continue
        if kind == "badref":
            if ";" in text[at:]:
                r.data("&#")
                at += 2
            elif close:
                r.data(text[at:])
                at = n
            if close:
                continue
            break
        if kind == "openref":
            if close:
                r.data(text[at:])
            break
        if kind == "start":
            end = r.start(at, m.end())
        elif kind == "end":
            end = r.end(at)
        elif kind == "comment":
            end = r.comment(at)
        elif kind == "section":
            end = r.section(at)
        elif kind == "pi":
            end = r.until(">", at + 2, "pi", at + 2)
        elif kind == "decl":
            end = r.until(">", at + 9, "decl", at + 2)
        else:
            end = r.until(">", at + 2, "comment", at + 2)
        if end < 0:
            if not close:
                break
            gt, lt = text.find(">", at + 1), text.find("<", at + 1)
            end = gt + 1 if gt >= 0 else lt if lt >= 0 else at + 1 if at + 1 < n and text[at + 1] in "<&" else n
            r.data(text[at:end])
        at = end
    out: list[Event] = []
    for e in r.events:
        if e[0] == "data" and out and out[-1][0] == "data":
            out[-1] = ("data", None, [], out[-1][3] + e[3])
        else:
            out.append(e)
    return out


def render(text: str) -> str:
    """The text of markup: br and p start a line, p ends one; other tags leave nothing."""
    out: list[str] = []
    lines = 0
    for event, name, _, data in events(text):
        if event == "data":
            out += ["\n" * lines, data]
            lines = 0
        elif event == "entityref":
            out.append("&" + data)
        elif name in ("br", "p") and (event == "starttag" or event == "startendtag" and name == "br" or event == "endtag" and name == "p"):
            lines += 1
    return "".join([*out, "\n" * lines])


def clean(text: str | None, *, comments: bool = True, strip: bool = True, entities: bool = True) -> str | None:
    """Markup to text. Comments keep their body; entities are unescaped before the tags go, so that escaped tags go too.

    Markup that can't be lexed stays as it is then.
    """
    if comments and text:
        text = _FULL_COMMENT.sub(r"\1", text).replace("<!--", "")
    if text and strip:
        if entities:
            text = unescape(text)
        try:
            text = render(text).strip()
        except HTMLError:
            pass
    return text


def soup(text: str | None) -> str | None:
    """Each piece of text stripped and joined, with a line end for each br and p."""
    if text is None:
        return None
    out = []
    for event, name, _, data in events(text, close=True):
        if event in ("data", "comment"):
            out.append(unescape(data).strip())
        elif event == "charref":
            out.append(unescape(f"&#{data};").strip())
        elif event == "entityref":
            out.append(unescape(f"&{data};").strip())
        elif event in ("starttag", "startendtag") and name in ("br", "p"):
            out.append("\n")
    return "".join(out).strip()


RENDERERS = {None: lambda t: t, "default": clean, "soup": soup}


def renderer(name: str | None):
    if name not in RENDERERS:
        raise ValueError(f"no such html renderer: {name}")
    return RENDERERS[name]


def _mapped(f, column: Column | str, kind: str = "string") -> Column:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if t is None else f(t) for t in b], dtype=object)

    return run(column)


def strip_html(column: Column | str, how: str | None = "default") -> Column:
    """Markup to text; how: default, soup or None (as it is)."""
    own = renderer(how)
    return F.col(column) if how is None and isinstance(column, str) else column if how is None else _mapped(own, column)


def unescape_entities(column: Column | str) -> Column:
    return _mapped(unescape, column)


def strip_comments(column: Column | str) -> Column:
    """Native: comment marks go, with a line end behind them, bodies stay."""
    full = native_replace(column, r"(?s)<!--(.*?)-->[\n]?", "$1")
    return F.replace(full, F.lit("<!--"), F.lit(""))


def html_events(column: Column | str, close: bool = True) -> Column:
    """array of (pos, event, name, attrs, data); explode it for a table of events."""

    def one(t: str) -> list[dict]:
        return [{"pos": i, "event": e, "name": n, "attrs": [{"k": k, "v": v} for k, v in a], "data": d} for i, (e, n, a, d) in enumerate(events(t, close))]

    return _mapped(one, column, EVENTS)
