"""The trie against trying every rule."""

import random

from cellgrid.llm import url_filter as u

URLS = ["http://WWW.Example.com/en/a?x", "https://example.com/en/", "http://example.com", "http://a.b.net/es/x#f", "http://net/fr/", "net/fr/", None, "", "x://", "http://com/", "ftp://m.example.com/en", "http://example.com/EN/x", "http://www.example.com/en/#", "://a.com/b", "http://xcom/"]


def plain(rules, host, path):
    fit = [r for r in rules if (not r.host or host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.text), len(r.host), r.verdict == "block"), default=None)


def test_trie():
    rng = random.Random(1)
    hosts = ["com", "a.com", "b.a.com", "net", "a.net", "m"]
    paths = ["", "/", "/e", "/en", "/en/", "/en/x", "/en//", "//"]
    for _ in range(200):
        rules = [u.Rule(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(8)]
        trie = u.Trie(rules)
        for _ in range(40):
            host, path = rng.choice([*hosts, "c.b.a.com", "xcom", ""]), rng.choice([*paths, "/en/xy", "/english", "/en//z"])
            got, want = trie.match(host, path), plain(rules, host, path)
            assert (got and (got.text, got.host, got.verdict)) == (want and (want.text, want.host, want.verdict))


def test_query_rules(spark):
    from cellgrid.llm.queries import URL_RULES

    rules = u.parse_rules(URL_RULES)
    df = spark.createDataFrame([(i, x, "h") for i, x in enumerate(URLS)], "page_id long, url string, host string")
    for limit in (1, 1000):
        rows = u.url_filter(df, URL_RULES, max_trie_chars=limit, default="allow").collect()
        assert len(rows) == len(URLS)
        for r in rows:
            want = plain(rules, r["host"], r["path"])
            assert (r["rule"], r["verdict"]) == ((want.text, want.verdict) if want else (None, "allow"))
    by = {r["url"]: (r["host"], r["path"]) for r in rows}
    assert by["http://WWW.Example.com/en/a?x"] == ("www.example.com", "/en/a")
    assert by["net/fr/"] == by[None] == by["x://"] == ("", "")


def test_empty(spark):
    assert u.url_filter(spark.createDataFrame([], "url string"), []).count() == 0


def test_many_rules_under_one_host():
    import random

    from cellgrid.llm.url_filter import Trie, parse_rules

    rng = random.Random(4)
    rules = parse_rules([(rng.choice(["allow", "block"]), f"h.com/{'/'.join(rng.choice('abc') * rng.randrange(4) for _ in range(rng.randrange(1, 4)))}") for _ in range(200)])
    tree = Trie(rules)
    for _ in range(2000):
        path = "/" + "".join(rng.choice("abc/") for _ in range(rng.randrange(12)))
        fit = [r for r in rules if path.startswith(r.path)]
        want = max(((len(r.path), r.verdict == "block", r.path, r.verdict) for r in fit), default=None)
        got = tree.match("x.h.com", path)
        assert (got is None) == (want is None) and (got is None or (got.path, got.verdict) == want[2:])
