import re

import pytest

from docloom.functions import config, robots, urls

#: (given, canonical, whether the query is kept), one rule at a time.
CASES = [
    ("HTTP://Plum.Orchard/Trees", "http://plum.orchard/Trees", False),  # scheme and host in lower case, path as it is
    ("https://plum.orchard", "https://plum.orchard/", False),  # an empty path
    ("https://plum.orchard:443/t", "https://plum.orchard/t", False),  # the scheme's own port
    ("http://plum.orchard:443/t", "http://plum.orchard:443/t", False),
    ("https://plum.orchard/t/u/../v/./w", "https://plum.orchard/t/v/w", False),
    ("https://plum.orchard/../../t", "https://plum.orchard/t", False),
    ("https://plum.orchard//t////u//", "https://plum.orchard/t/u/", False),
    ("https://plum.orchard/t#bark", "https://plum.orchard/t", False),
    ("https://plum.orchard/t?kind=old", "https://plum.orchard/t", False),
    ("https://plum.orchard/t?z=3&utm_medium=post&y=2&gclid=9", "https://plum.orchard/t?y=2&z=3", True),
    ("https://plum.orchard/t?fbclid=1", "https://plum.orchard/t", True),
    ("https://plum.orchard./t", "https://plum.orchard/t", False),
    ("https://plum.orchard/%74rees", "https://plum.orchard/trees", False),  # an escape that isn't needed
    ("https://plum.orchard/t%2fu", "https://plum.orchard/t%2fu", False),  # an encoded slash stays as written
    ("https://plum.orchard/old trees", "https://plum.orchard/old%20trees", False),
    ("http://[2001:db8::7]:80/t", "http://[2001:db8::7]/t", False),
]


@pytest.mark.parametrize(("given", "want", "keep"), CASES)
def test_normalize(given, want, keep):
    assert urls.normalize(given, keep) == want
    assert urls.normalize(want, keep) == want


@pytest.mark.parametrize("bad", ["news:plum", "file:///t", "ws://plum.orchard/", "https://gardener@plum.orchard/", "trees/old", "//plum.orchard/t", "", "   ", None, "https://[2001:db8/", "https:///t"])
def test_rejected(bad):
    assert urls.normalize(bad) is None


@pytest.mark.parametrize(
    ("href", "want"),
    [("pear", "https://plum.orchard/t/pear"), ("../seeds/#new", "https://plum.orchard/seeds/"), ("/seeds", "https://plum.orchard/seeds"), ("//pear.orchard/s", "https://pear.orchard/s"), ("http://pear.orchard", "http://pear.orchard/"), ("?cut=1", "https://plum.orchard/t/apple"), ("  ", None), ("#roots", None), ("sms:12", None), (None, None)],
)
def test_resolve(href, want):
    assert urls.resolve("https://plum.orchard/t/apple", href) == want


def test_endings():
    assert [urls.likely_non_html(f"https://plum.orchard/{p}") for p in ("seeds.ZIP", "map.svg", "t.7z/", "tree.htm", "", "2.0/leaf", "t.zip?x=a")] == [True, True, False, False, False, False, True]


def test_url_columns_agree_with_python(spark):
    plain = [c for c in CASES if not re.search(r"%|\[|\.\.|/\./| ", c[0])]
    df = spark.createDataFrame([(g,) for g, _, _ in plain] + [("news:plum",), (None,)], "url string")
    got = [r["n"] for r in df.select(urls.simple_normalize("url").alias("n")).collect()]
    assert got == [urls.normalize(g) for g, _, _ in plain] + [None, None]
    full = [r["n"] for r in df.select(urls.normalize_col("url", True).alias("n")).collect()]
    assert full == [urls.normalize(g, True) for g, _, _ in plain] + [None, None]


ROBOTS = """Sitemap: https://plum.orchard/map
user-agent : Beetle   # a guest
User-Agent: beetle-long
Disallow: /bark
Allow: /bark/thin

User-agent: *
Crawl-delay: 1.5
Disallow: /shed/
Disallow: /*/roots$
Allow: /shed/open
no colon here
Disallow:

User-agent: beetle
Disallow: /
"""


def test_robots_groups():
    short, long, other = (robots.parse(ROBOTS, t) for t in ("Beetle/2", "my-beetle-long-reader", "Wasp"))
    assert short.rules == long.rules == [(False, "/bark"), (True, "/bark/thin")]  # the first group of an agent holds
    assert not short.allowed("/bark/old") and short.allowed("/bark/thin/1") and short.allowed("/shed/")
    assert other.crawl_delay == 1.5 and len(other.rules) == 3
    assert [other.allowed(p) for p in ("/", "/shed/x", "/shed/open/x", "/t/roots", "/t/roots/2", "/roots", "/robots.txt")] == [True, False, True, False, True, True, True]
    assert robots.parse("User-agent: beetle\nDisallow: /", "wasp").allowed("/t") and robots.parse(None, "wasp").rules == []
    assert robots.parse("Disallow: /\nUser-agent: *\nCrawl-delay: soon", "wasp") == robots.Rules()
    tie = robots.parse("User-agent: *\nDisallow: /t\nAllow: /t", "wasp")
    assert tie.allowed("/t")
    assert [robots.for_response(s, "User-agent: *\nDisallow: /", "wasp").allowed("/t") for s in (200, 301, 410, 503, None)] == [False, True, True, False, False]


def test_robots_join_agrees_with_python(spark):
    paths = ["/", "/shed/", "/shed/open", "/t/roots", "/t/roots?x=1", "/u", "/robots.txt", "", "?q=1"]
    answers = spark.createDataFrame([("https://a.b", 200, ROBOTS), ("https://down.b", None, None), ("https://free.b", 404, "x")], "origin string, status int, body string")
    rows = [(f"https://{h}{p}",) for h in ("a.b", "down.b", "free.b", "unknown.b") for p in paths]
    got = {r["url"]: r["allowed"] for r in robots.decide(spark.createDataFrame(rows, "url string"), robots.rule_rows(answers, "Wasp")).collect()}
    own = robots.parse(ROBOTS, "Wasp")
    for p in paths:
        full = p if p.startswith("/") else "/" + p
        assert got[f"https://a.b{p}"] == own.allowed(full), p
        assert got[f"https://down.b{p}"] == (full == "/robots.txt")
        assert got[f"https://free.b{p}"] and got[f"https://unknown.b{p}"]


def source(**kw):
    c = config.Config(sources=[config.Source(**{"id": "s", **kw})])
    assert config.validate(c) == []
    return c.sources[0]


def test_boundary(spark):
    a = source(start_urls=["https://plum.orchard/t/"], allowed_prefixes=["HTTPS://Plum.Orchard:443/t/"], exclude_patterns=["/t/shed", r"\.gz$"])
    b = source(start_urls=["http://hive:9000/in"], allowed_hosts=["hive:9000", "comb"], include_patterns=["//[^/]+/(in|wax)"])
    good = [(a, "https://plum.orchard/t/"), (a, "https://PLUM.orchard:443/t/u?v"), (b, "http://hive:9000/in/2"), (b, "https://comb:443/wax"), (b, "http://comb/in")]
    bad = [(a, u) for u in ("https://plum.orchard/t", "http://plum.orchard/t/", "https://plum.orchard:8443/t/", "https://plum.orchard.evil/t/", "https://evil/https://plum.orchard/t/", "https://x@plum.orchard/t/", "https://plum.orchard/t/shed/1", "https://plum.orchard/t/a.gz", "gopher://plum.orchard/t/")]
    bad += [(b, u) for u in ("http://hive:9000/out", "http://hive/in", "http://comb.evil/in", "http://sub.comb/in")]
    assert all(s.allows(u)[0] for s, u in good) and not any(s.allows(u)[0] for s, u in bad)
    for s in (a, b):
        mine = [u for x, u in good + bad if x is s]
        rows = spark.createDataFrame([(u,) for u in mine], "url string")
        assert {r["url"]: r["why"] == "" for r in rows.select("url", config.boundary("url", s).alias("why")).collect()} == {u: s.allows(u)[0] for u in mine}


YAML = "sources:\n- id: docs\n  name: Docs\n  start_urls: [https://example.com/docs/]\n  allowed_prefixes: [https://example.com/docs/]\n"


def test_config_defaults():
    c = config.parse_config(YAML)
    assert (c.settings.concurrency, c.settings.delay_seconds, c.settings.request_timeout_seconds, c.sources[0].max_pages, c.respects_robots(c.sources[0]), c.request_budget()) == (4, 0.25, 20, 100, True, 100)


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("", "empty"), ("sources: []", "no sources defined"), (YAML + "  typo: 1\n", "typo"), (YAML.replace("  allowed_prefixes: [https://example.com/docs/]\n", ""), "at least one of allowed_prefixes or allowed_hosts"),
        (YAML.replace("id: docs", "id: Docs!"), "must be 1-63 characters"), (YAML + YAML.split("\n", 1)[1], "duplicate id"), (YAML.replace("start_urls: [https://example.com/docs/]", "start_urls: [https://example.com/blog/]"), "outside this source's boundaries"),
        (YAML.replace("start_urls: [https", "start_urls: [ftp"), "must start with http:// or https://"), (YAML.replace("start_urls: [https://", "start_urls: [https://u:p@"), "must not contain credentials"),
        (YAML + "  allowed_hosts: [https://x/]\n", "bare host name"), (YAML + "  allowed_hosts: ['*.x']\n", "wildcards are not supported"), (YAML + "  max_pages: 999999\n", "max_pages must be between"), (YAML + "  include_patterns: ['(']\n", "not a valid regular expression"),
        (YAML + "settings:\n  concurrency: 100\n", "concurrency must be between"), (YAML.replace("start_urls: [https://example.com/docs/]", "start_urls: []"), "start_urls must contain at least one URL"),
    ],
)
def test_config_errors(text, error):
    with pytest.raises(config.ConfigError, match=re.escape(error)):
        config.parse_config(text)


def test_plan(tmp_path, capsys):
    from docloom import cli

    (tmp_path / "c.yaml").write_text(YAML)
    assert cli.main(["validate", str(tmp_path / "c.yaml"), "--source", "docs"]) == 0 and "100 requests at most" in capsys.readouterr().out
    assert cli.main(["validate", str(tmp_path / "c.yaml"), "--source", "docs,moth"]) == 1 and "unknown source: moth" in capsys.readouterr().err
