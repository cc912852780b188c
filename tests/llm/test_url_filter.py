import random

from lineal.llm import queries
from lineal.llm.url_filter import UrlTrie, filter_urls


def fits(rule, host, path):
    h, slash, p = rule.partition("/")
    return (host == h or host.endswith("." + h)) and path.startswith(slash + p)


def test_trie_against_all_rules():
    rng = random.Random(2)
    hosts = ["a", "a.b", "b.a.b", "c.a.b", "b"]
    paths = ["", "/", "/x", "/x/", "/x/y", "/x/yz/", "/xy/z"]
    rules = [("allow" if rng.random() < 0.5 else "block", h + p) for h in hosts[:4] for p in paths]
    seen = {}
    for v, r in rules:
        seen.setdefault(r, v)
    trie = UrlTrie([(v, r) for r, v in seen.items()])
    for host in [*hosts, "q.a.b", "xa.b", "", ".a"]:
        for path in [*paths, "/x/y/z", "/x/yz/q", "/w"]:
            best = max((r for r in seen if fits(r, host, path)), key=lambda r: (len(r), r.partition("/")[0].count(".")), default=None)
            assert trie.match(host, path) == (best, seen.get(best)), (host, path)


def test_odd_urls(frame):
    urls = [None, "", "nothing", "http://", "HTTP://EXAMPLE.ORG/es/", "http://Example.ORG?x", "http://example.org/en/1#y", "http://a.example.org/en/2", "ftp://x.com/de/a?b", "http://x.com/fr/", "http://é.net/", "a://b://c/d", "http://" + "x." * 5000 + "org/" + "y" * 50_000]
    df = filter_urls(frame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, rule string"), queries.RULES)
    r = {x.page_id: (x.host[:20], x.path[:8], x.rule, x.verdict) for x in df.collect()}
    assert r[0] == r[1] == r[2] == ("", "", None, "allow")
    assert r[4] == ("example.org", "/es/", "example.org/es/", "block")
    assert r[5] == ("example.org", "", None, "allow")
    assert r[6] == ("example.org", "/en/1", "example.org/en/1", "block")
    assert r[7] == ("a.example.org", "/en/2", "org/", "allow")
    assert r[8][2:] == ("com/de/", "block") and r[9][2:] == ("com/fr/", "allow") and r[10] == ("é.net", "/", None, "allow")
    assert r[11] == ("b:", "//c/d", None, "allow") and r[12][2:] == ("org/", "allow")


def test_many_rules_of_one_host_repeats_and_names(frame):
    """The longest rule wins by characters, even over one of a deeper host; beginnings of segments are looked up, not scanned."""
    rules = [("allow", "x.org/"), ("block", "org/aaaaaaaaaa"), ("allow", "q.org/p"), ("block", "q.org/p"), ("block", "q.net")] + [("block", f"x.org/p{i}") for i in range(2000)]
    trie = UrlTrie(rules)
    assert trie.match("x.org", "/aaaaaaaaaab") == ("org/aaaaaaaaaa", "block") and trie.match("x.org", "/b") == ("x.org/", "allow")
    assert trie.match("x.org", "/p1999x/y") == ("x.org/p1999", "block") and trie.match("q.org", "/pp") == ("q.org/p", "allow") and trie.match("a.q.net", "") == ("q.net", "block")
    rows = [(1, "http://x.org/p7", "a", 2), (1, "http://x.org/p7", "a", 2), (None, "http://x.org/", "b", 3)]
    out = filter_urls(frame(rows, "page_id long, url string, _judged string, _JUDGED_ int"), rules)
    assert out.columns == ["page_id", "url", "_judged", "_JUDGED_", "host", "path", "rule", "verdict"]
    assert sorted((r.rule, r._judged) for r in out.collect()) == [("x.org/", "b"), ("x.org/p7", "a"), ("x.org/p7", "a")]


def test_empty_table(frame):
    assert filter_urls(frame([], "page_id long, url string"), queries.RULES).count() == 0
