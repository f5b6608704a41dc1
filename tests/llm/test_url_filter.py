import random

import pytest

from textloom.llm import url_filter as U
from textloom.llm.queries import URL_RULES


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = rest
        for c in "/?#":
            raw = raw.split(c)[0]
        path = rest[len(raw) :].split("?")[0].split("#")[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


URLS = [
    None, "", "no scheme", "http://", "://", "https://Example.COM/en/7x", "http://com/en/", "http://xcom/en/", "http://a.b.example.net/de/8#x", "http://a.net/de/9?q=/en/", "ftp://u@x.org:80/es/", "http://x.org/es/1",
    "http://example.com?x", "http://example.com#y", "http://com/en", "http://a.com://b.com/en/", "HTTP://ÜBER.com/en/ÄB", "http://example.com/en/7", "http://x\n.com/en/\ny",
]


@pytest.mark.parametrize("most", [U.MAX_BITS, 1])
def test_urls_against_plain_rules(spark, monkeypatch, most):
    """With a cascade for each list, and with many shards that are judged two at a time."""
    monkeypatch.setattr(U, "MAX_BITS", most)
    monkeypatch.setattr(U, "SHARDS", 2)
    r = random.Random(1)
    urls = URLS + ["http://" + ".".join(r.choice(["a", "example", "com", "net", "org", ""]) for _ in range(r.randint(1, 4))) + r.choice(["/en/", "/de/8", "/es/", "/en/7", "/", ""]) + r.choice(["", "9", "?q"]) for _ in range(300)] + ["http://x." + "y." * 3000 + "com/en/"]
    rows = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, rule string, keys string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge_urls(spark, rows, URL_RULES).collect()}
    assert got == {i: plain(u, URL_RULES) for i, u in enumerate(urls)}


def test_many_rules_in_shards(spark, monkeypatch):
    monkeypatch.setattr(U, "MAX_BITS", 2000)
    rules = [(("block", "allow")[i % 2], f"h{i}.org", f"/p{i % 7}/") for i in range(400)]
    urls = [f"http://{'a.' * (i % 3)}h{i % 500}.org/p{i % 11}/x" for i in range(2000)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge_urls(spark, rows, rules).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_cascade_is_exact_over_its_universe(spark):
    listed = [f"k{i}" for i in range(0, 3000, 7)]
    rows = spark.createDataFrame([(f"k{i}",) for i in range(3000)] + [(None,), ("k7",)], "key string")
    cascade = U.build_cascade(spark.createDataFrame([(k,) for k in listed], "key string"), rows)
    assert len(cascade.levels) > 1
    got = {r["key"] for r in rows.where(cascade.holds(rows["key"])).collect()}
    assert got == set(listed)


@pytest.mark.parametrize("rules", [[], [("block", "com", "")], [("allow", "com", ""), ("block", "com", "")]])
def test_few_rules_and_empty_tables(spark, rules):
    rows = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x")], "page_id bigint, url string")
    got = [r["verdict"] for r in U.judge_urls(spark, rows, rules).collect()]
    assert got == ["block" if rules else "allow"] * 2
    assert U.judge_urls(spark, rows.limit(0), rules).collect() == []
