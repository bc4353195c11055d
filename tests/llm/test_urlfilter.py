import re

import pytest
from fixtures import edge_pages

from trigrove.llm import urlfilter

URLS = [
    "https://example.org/es/1", "http://www.EXAMPLE.org/es/", "http://example.org/en/12", "http://notexample.org/es/1", "http://example.org.evil.com/fr/", "https://a.b.com/de/x", "https://com/de/x", "ftp://x.net/?a=/es/#y", "https://cheap-pills.example.net/en",
    "https://casinos.example.net/", "http://casino.example.com/fr/1", "no scheme/fr/", "https://", "://h/p", "a://b://c/fr/", "https://x.com/fr", "https://x.com/FR/", "https://x.com\n/fr/1", "https://ü.com/fr/", "https://spam-farm.com?q", None, "",
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [(len(h + p), h + p, a) for h, p, a in (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best and best[2]


def test_base_rules_and_the_joined_index(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = sorted(urlfilter.judge(pages).collect())
    for r in got:
        host, path, rule, action = plain(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[r.page_id]
        if action:
            assert r.verdict == action
    by = {URLS[r.page_id]: r for r in got}
    assert by["https://cheap-pills.example.net/en"].verdict == "block" and by["https://cheap-pills.example.net/en"].pattern == "cheap-pills"
    assert by["https://casinos.example.net/"].verdict == "allow"
    assert by["http://casino.example.com/fr/1"].verdict == "allow" and by["http://casino.example.com/fr/1"].pattern == "casino"
    monkeypatch.setattr(urlfilter, "INDEX_RULES", 0)
    assert sorted(urlfilter.judge(pages).collect()) == got


def test_only_candidates_of_the_rarest_token_are_run(spark):
    p = spark.createDataFrame([("a b",), ("a",), ("a c",)], "target string")
    filed = dict((r.name, t) for t, r in urlfilter._filed(p, [urlfilter.word_rule("a", "b"), urlfilter.word_rule("c", "a"), urlfilter.Rule("any", "block", ".", ())]))
    assert filed == {"a-b": "b", "c-a": "c", "any": None}


def test_rules_of_a_block_list(spark, monkeypatch):
    rules = urlfilter.load("""
! a comment
||ads.example.com^
/banner/*/big^
|http://exact.org/path|
@@||good.ads.example.com/fine
/track[0-9]+\\.gif$/
||ü.org/x
""".replace("\\\\", "\\"))
    tokens = {r.name: r.tokens for r in rules}
    assert tokens["||ads.example.com^"] == ("ads", "example", "com") and tokens["/banner/*/big^"] == ("banner", "big")
    assert tokens["|http://exact.org/path|"] == ("exact", "org", "path") and tokens["/track[0-9]+\\.gif$/".replace("\\\\", "\\")] == ()
    assert tokens["||ü.org/x"] == ("ü", "org")  # the last may go on
    want = {
        "http://ads.example.com": "block", "http://x.ADS.example.com/a": "block", "http://bads.example.com/": "allow", "http://ads.example.com.evil/": "allow", "http://ads.example.comü/": "allow",
        "http://h/Banner/1/2/BIG?x": "block", "http://h/banner/big": "allow", "http://h/banner/1/bigger": "allow", "https://exact.org/path": "block", "https://exact.org/path/": "allow", "https://a.exact.org/path": "allow",
        "http://good.ads.example.com/fine/1": "allow", "http://good.ads.example.com/other": "block", "http://h/track12.gif": "block", "http://h/track.gif": "allow", "http://a.ü.org/xyz": "block",
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    for most in (2000, 0):
        monkeypatch.setattr(urlfilter, "INDEX_RULES", most)
        got = {r.page_id: r.verdict for r in urlfilter.judge(pages, (), rules).collect()}
        assert {u: got[i] for i, u in enumerate(want)} == want
    for bad in ("||x.com^$script", "||", "**"):
        with pytest.raises(ValueError):
            urlfilter.pattern_rule(bad)


def test_words_are_whole_whatever_letters_are_next_to_them(spark):
    urls = ["http://casino.de/", "http://ücasino.de/", "http://casinoü.de/", "http://my-casino-win.de", "http://x.de/casino"]
    got = urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [r.pattern for r in got] == ["casino", None, None, "casino-win", None]


def test_edges(spark):
    by = {r.page_id: r for r in urlfilter.judge(edge_pages(spark)).collect()}
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("", "", None, "allow") == (by[4].host, by[4].path, by[4].rule, by[4].verdict)
    assert (by[3].host, by[3].path, by[3].rule, by[3].verdict) == ("example.org", "/en/12", "example.org/en/1", "block") and by[None].rule == "com/fr/"
    assert urlfilter.judge(edge_pages(spark)).count() == 7
    assert urlfilter.judge(edge_pages(spark, empty=True)).count() == 0
