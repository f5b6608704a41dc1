import pytest

from textloom.functions import html as H
from textloom.functions import links as L
from textloom.functions import normalize as N


def shown(text):
    return [(e, n, a) if e in ("starttag", "startendtag") else (e, n if e == "endtag" else d) for e, n, a, d in H.events(text, close=True)]


TAG = '<em title="note" lang=de hidden>'


def test_a_whole_tag_and_its_attributes():
    assert shown(TAG) == [("starttag", "em", [("title", "note"), ("lang", "de"), ("hidden", None)])]
    assert shown(TAG.replace(">", "/>")) == [("startendtag", "em", [("title", "note"), ("lang", "de"), ("hidden", None)])]
    assert shown("<EM></Em >") == [("starttag", "em", []), ("endtag", "em")]


@pytest.mark.parametrize("end", range(2, len(TAG)))
def test_markup_that_breaks_off_is_text(end):
    assert shown("wind " + TAG[:end]) == [("data", "wind " + TAG[:end])]


@pytest.mark.parametrize("quote", ['"', "'"])
@pytest.mark.parametrize("raw, value", [("plain", "plain"), ("5 > 4", "5 > 4"), ("&lt;&#65;&#x42;", "<AB"), ("&nosuch;", "&nosuch;"), ("", "")])
def test_quoted_values(quote, raw, value):
    assert shown(f"<td bgcolor={quote}{raw}{quote}>cell") == [("starttag", "td", [("bgcolor", value)]), ("data", "cell")]


def test_values_that_run_together():
    assert shown('<td rowspan="2"colspan=3>') == [("starttag", "td", [("rowspan", "2"), ("colspan", "3")])]
    assert shown("<td / rowspan / colspan />") == [("startendtag", "td", [("rowspan", None), ("colspan", None)])]


@pytest.mark.parametrize("inside", ["", " ", "river", " river and lake ", "<b>", "-", "a - b"])
def test_comments(inside):
    assert shown(f"<!--{inside}-->ok") == [("comment", inside), ("data", "ok")]


@pytest.mark.parametrize("text, event", [("<!DOCTYPE svg>", ("decl", "DOCTYPE svg")), ("<?php echo 1 ?>", ("pi", "php echo 1 ?")), ("<!ufo>", ("comment", "ufo")), ("<![if mso]>", ("unknown decl", "if mso")), ("&euro;", ("entityref", "euro")), ("&#8364;", ("charref", "8364")), ("&#xAC;", ("charref", "xAC"))])
def test_other_constructs(text, event):
    assert shown(text) == [event]
    assert shown(f"left {text} right") == [("data", "left "), event, ("data", " right")]


@pytest.mark.parametrize("sign", ["&", "<", "< ", "&;", "&#", "&#;"])
def test_signs_that_begin_nothing_are_text(sign):
    assert shown(f"gulls {sign} terns") == [("data", f"gulls {sign} terns")]


@pytest.mark.parametrize("tag", ["script", "style"])
def test_text_of_scripts_is_kept_whole(tag):
    inside = "if (a < b && c) { d = '<i>&amp;</i>' } <!-- e -->"
    assert shown(f"<{tag}>{inside}</{tag}>f") == [("starttag", tag, []), ("data", inside), ("endtag", tag), ("data", "f")]


def test_clean():
    lines = ["Harbour", "Ferries leave at 9 < 10", "Tickets are sold on board"]
    assert H.clean("<br>".join(lines).replace("<br>", "<p>", 1)) == "\n".join(lines)
    assert H.clean("<div>" + lines[0] + "</div><!-- tide --> " + lines[2]) == lines[0] + " tide  " + lines[2]
    assert H.clean("&quot;sail&quot; &gt; &lt;row&gt;").count("<") == 0
    assert H.clean("") == "" and H.clean(None) is None and H.clean("mast <sp") == "mast"
    assert H.soup("<ul><li> oar </li><li> sail</li></ul>") == "oarsail"
    with pytest.raises(ValueError):
        H.renderer("none such")


def test_unescape():
    for code, char in ((38, "&"), (60, "<"), (233, "é"), (8364, "€")):
        assert H.unescape(f"&#{code}; &#x{code:x}; &#x{code:X};") == f"{char} {char} {char}"
    for name in ("lt", "gt", "amp", "quot"):
        assert H.unescape(f"&{name};") != f"&{name};" and H.unescape(f"&{name}") == f"&{name}"
    assert H.unescape("&ferry; &#ferry;") == "&ferry; &#ferry;"


PARTS = {"scheme": "https://", "userinfo": "kim:pw", "host": "files.example.net", "port": "8443", "path": "/maps/north", "query": "zoom=3&lang=de", "fragment": "legend"}


def test_parts_of_a_link():
    p = PARTS
    link = f"{p['scheme']}{p['userinfo']}@{p['host']}:{p['port']}{p['path']}?{p['query']}#{p['fragment']}"
    (found,) = L.Links().parse(f"map at {link} today")[1]
    assert {k: found[k] for k in PARTS} == PARTS and found["string"] == link and found["entity_type"] == "uri"


@pytest.mark.parametrize("before, after", [("", ""), ("Tide table: ", ""), ("", " and more"), ("(", ")"), ('<a href="', '">x</a>'), ("end. ", "\n")])
def test_text_around_a_link_is_kept(before, after):
    pieces, found = L.Links().parse(before + "http://example.com/tides" + after)
    assert [x["string"] for x in found] == ["http://example.com/tides"] and "".join(pieces) == before + after


def test_links_that_touch_come_apart():
    links = [f"http://h{i}.example.com/p{i}" for i in range(3)]
    assert [x["string"].rstrip("/") for x in L.Links().parse("".join(x + "/" for x in links))[1]] == links


def test_what_is_a_link():
    own = L.Links()
    kinds = {"http://192.0.2.9:81/a": "uri", "192.0.2.9:81/a": "uri", "ftp://example.org/a": "uri", "mailto:kim@example.org": "email", "kim.lee@example.org": "email", "stop.Then": None, "v2.0": None, "and/or": None}
    for text, kind in kinds.items():
        assert [x["entity_type"] for x in own.parse(f"so {text} it is")[1]] == ([kind] if kind else []), text
    assert own.parse("so 192.0.2.9:81/a it is")[1][0]["ip_addr"] == "192.0.2.9" and own.parse("")[1] == []
    assert own.whiteout("so kim@example.org or http://example.org/x") == "so  __email__  or  __uri__ "


def test_normalize():
    assert N.squeeze("So many $100000 bills.......") == "So many $100000 bills..."
    assert N.squeeze(N.squeeze("aaaaabbbb\n\n\n\n\n")) == N.squeeze("aaaaabbbb\n\n\n\n\n") == "aaabbb\n\n\n"
    with pytest.raises(ValueError):
        N.squeeze_pattern(0)
    assert N.replace_all("A b c", {"a": "x", "[bc]": {"b": "y"}}) == "x y c"
    assert "\u202e".translate(N.character_map()) == "\u202e" and "𝔄ᴀⒶ\u200b".translate(N.character_map()) == "AAA"


def test_native_columns_agree(spark):
    from pyspark.sql import functions as F

    texts = ["ＷＷＷ.Ｂay87\u200b.ＣＯＭ “x” 𝔄𝕬 \ufe0f×", "aaaa 11111 ****** éééé", "a – b — c", "<!-- x -->\ny <!-- z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    chars = N.merged(N.character_map(), N.inverse(N.INVERSE_MAP))
    got = rows.select(N.translate_chars("t"), N.squeeze_repeats("t"), N.replace_map("t"), H.strip_comments("t")).collect()
    for t, r in zip(texts, got):
        assert list(r) == [t.translate(chars), N.squeeze(t), t.replace("–", "--").replace("—", "---"), H.clean(t, strip=False)]
    assert [r[0] for r in rows.select(F.lit(1)).collect()] == [1] * 4
