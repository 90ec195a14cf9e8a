"""Filters in list syntax, against a matcher that walks the characters."""

import random
from functools import lru_cache

import pytest

from medialake.llm import url_filter


def fits(line, address):
    """Whether one filter's pattern fits, by trying each place; no regular expressions."""
    body, cased = line.removeprefix("@@"), line.endswith("$match-case")
    body = body.removesuffix("$match-case")
    lower = (lambda x: x) if cased else (lambda x: "".join(c.lower() if c.isascii() else c for c in x))
    if body[:2] == "||":
        host = address.split("/")[0]
        starts, body = [0] + [i + 1 for i, c in enumerate(host) if c == "."], body[2:]
    elif body[:1] == "|":
        starts, body = [0], body[1:]
    else:
        starts = range(len(address) + 1)
    ends = body.endswith("|")
    body, address = lower(body.removesuffix("|")), lower(address)
    plain = lambda c: c.isascii() and (c.isalnum() or c in "_-.%")

    @lru_cache(None)
    def walk(p, a):
        if p == len(body):
            return a == len(address) or not ends
        if body[p] == "*":
            return any(walk(p + 1, x) for x in range(a, len(address) + 1))
        if body[p] == "^":
            return a == len(address) and walk(p + 1, a) or a < len(address) and not plain(address[a]) and walk(p + 1, a + 1)
        return a < len(address) and address[a] == body[p] and walk(p + 1, a + 1)

    return any(walk(0, s) for s in starts)


@pytest.mark.parametrize("few", [100_000, 0], ids=["broadcast", "shuffled"])
def test_filters_as_a_plain_matcher_has_them(spark, few):
    rng = random.Random(4)
    word = lambda: rng.choice(["ads", "Ads", "ad", "x9", "pop", "été", "a_b", "c%2d"])
    lines = set()
    while len(lines) < 500:
        parts = [word()]
        for _ in range(rng.randrange(2, 4)):
            parts += [rng.choice(["/", ".", "-", "^", "*", "/*/", "^*"]), word()]
        lines.add(rng.choice(["", "||", "|", "@@", "@@||"]) + "".join(parts) + rng.choice(["", "^", "|", "*", ".(x)", "$match-case"]))
    lines = sorted(lines)
    urls = [f"http://{'.'.join(word().lower() for _ in range(rng.randrange(1, 4)))}{rng.choice(['', ':80'])}{''.join(rng.choice(['/', '-', '.']) + word() for _ in range(rng.randrange(0, 5)))}{rng.choice(['', '?ads', '#ads', '/'])}" for _ in range(500)] + [None, "", "ads"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    noise = [None, "", "   ", "! ads", "[Lists 1.0]"]
    rules = url_filter.filter_rules(spark.createDataFrame([(x, "y") for x in noise + lines], "filter string, token string"))
    assert rules.count() == len(lines)
    got = url_filter.judge_urls(pages, rules, broadcast_rules=few).collect()
    assert len(got) == len(urls)
    seen = set()
    for r in got:
        hit = {line[:2] == "@@" for line in lines if fits(line, r.host + r.path)}
        want = "allow" if True in hit or not hit else "block"
        assert (r.verdict, r.pattern is not None, r.rule) == (want, bool(hit), None), urls[r.page_id]
        seen.add((want, bool(hit)))
    assert seen == {("allow", True), ("allow", False), ("block", True)}


def test_filed_under_the_rarest_token(spark):
    pages = spark.createDataFrame([("a.net", f"/common/{i}") for i in range(50)] + [("b.net", "/common/rare/deep"), ("c.net", "/rare/deep")], "host string, path string")
    lines = ["/common/rare/deep^", "||a.net/common^", "/never/common/x^", "@@||rare*/deep^", "/^[0-9]+/"]
    rules = url_filter.filter_rules(spark.createDataFrame([(x,) for x in lines], "filter string"))
    tokens = {r.regex: r.tokens for r in rules.collect()}
    assert list(tokens.values()) == [["common", "rare", "deep"], ["a", "net", "common"], ["never", "common", "x"], ["deep"], []]
    index = {r.best.regex: r.filed for r in url_filter.filed(rules.selectExpr("struct(regex) AS best", "tokens"), pages, True).collect()}
    assert [index.get(x) for x in tokens] == ["deep", "a", "never", "deep", None]  # a tie of deep and rare goes by name


def test_schemes_and_expressions(spark):
    pages = spark.createDataFrame([(1, "https://ads.x/"), (2, "http://y/ads.x"), (3, "http://y/Track123"), (4, "http://y/z")], "page_id long, url string")
    rules = url_filter.filter_rules(spark.createDataFrame([("|http://ads.",), ("/track[0-9]+$/",), ("@@/track999/$match-case",)], "filter string"))
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(pages, rules).collect()} == {1: "block", 2: "allow", 3: "block", 4: "allow"}


def test_what_is_not_known_is_an_error(spark):
    for line in ["||a.net^$third-party", "a.net##.banner", "/x?y="]:
        lines = spark.createDataFrame([(line,), ("||b.net^",)], "filter string")
        with pytest.raises(Exception, match="no filter that is known here"):
            url_filter.filter_rules(lines).collect()
        assert url_filter.filter_rules(lines, strict=False).count() == 1
    free = url_filter.filter_rules(spark.createDataFrame([("*a",), ("*b",)], "filter string"))
    with pytest.raises(ValueError, match="hold no token"):
        url_filter.judge_urls(spark.createDataFrame([(1, "http://a/")], "page_id long, url string"), free, most_free=1)
    assert url_filter.judge_urls(spark.createDataFrame([(1, "http://a/")], "page_id long, url string"), free.where("false")).first().verdict == "allow"


def test_registered_filters_as_their_sql(spark, tmp_path):
    """Cases of each filter, near misses and exceptions, which the given pages don't have."""
    import duckdb

    from medialake.llm import queries

    urls = ["http://spam-farm.a.org/x", "http://x/out/redirect/1", "http://x/cgi-bin/1/click", "http://x/cgi-bin/1/clicks", "http://x/a/popup-page.html", "http://x/a/popup-page.htmlx", "http://x/session-id-0123456789abcdef0"]
    urls += ["http://spam-research.b/papers/casino.", "http://casino.b/help/report-spam?x", "http://a.free-x-download.b/", "http://casino.b/help/report-spams", "https://HELP.net/de", "http://parked-domain.org", "http://x/ad-server/y/Banner", None]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op3_url_filter(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL['op3_url_filter']})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(r[4] == "block" for r in want) == 10
