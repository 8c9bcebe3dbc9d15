import random
import re

from blotter.llm import url_filter as u

SCHEMA = "page_id long, url string, host string, rule int, n int"
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
BLOCKED = ["cheap-pills", "spam-farm", "ads", "adserver", "casino", "viagra", "porn"]


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, *max(fit)[1:]
    target = host + path
    bad = any(re.search(r"(^|[^A-Za-z0-9])" + w + r"([^A-Za-z0-9]|\Z)", target) for w in BLOCKED)
    bad = bad or re.search(r"(?s)(^|[^A-Za-z0-9])track([^A-Za-z0-9]|\Z).*([^A-Za-z0-9]|^)click([^A-Za-z0-9]|\Z)", target)
    return host, path, None, "block" if bad else "allow"


def test_against_brute_force(spark):
    rnd = random.Random(1)
    hosts = ["org", "example.org", "a.example.org", "notexample.org", "EXAMPLE.org", "x.com", "com", "a.net", "cheap-pills.net", "my.spam-farm.net",
             "badads.net", "ads.net", "ÉX.com", "user@b.example.org", "h.org:80", ""]
    paths = ["", "/", "/es/", "/ES/", "/es", "/en/1", "/en/12", "/en/2", "/fr/x", "/de/", "/ads/", "/ads", "/badads/1", "/track/1/click", "/track/clicks",
             "/adserver", "/é\n/x", "/a//b", "/*.$^|()[]{}"]
    urls = [f"{rnd.choice(['http', 'https', ''])}://{rnd.choice(hosts)}{rnd.choice(paths)}{rnd.choice(['', '?q=/es/', '#f', '?a#b', '/'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "http:/x.org/", "http://a://b.org/es/", "http://org/" + "y" * 100000, urls[0], urls[0]]
    rows = [(i if i % 50 else None, x, "h", 1, 2) for i, x in enumerate(urls)]
    got = u.url_filter(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(r[0], *plain(r[1])) for r in rows], key=repr)


def test_tokens_stand_whole_in_every_match():
    assert u.tokens("||example.org/en/1") == ["en", "example", "org"]
    assert u.tokens("ads") == [] and u.tokens("^ads") == [] and u.tokens("|ads^") == ["ads"] and u.tokens("*ads^x*y^") == []


def test_shuffled_index_and_rules_without_tokens(spark):
    rows = [(1, "http://a.net/xadsx", "h", 1, 2), (2, "http://a.net/b", "h", 1, 2)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = u.url_filter(d, rules=[u.Rule("ads", "block"), u.Rule("||a.net/b", "block", 1, "a.net/b")], broadcast_rules=0).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in got} == {1: (None, "block"), 2: ("a.net/b", "block")}


def test_empty_tables(spark):
    assert u.url_filter(spark.createDataFrame([], SCHEMA)).collect() == []
    d = spark.createDataFrame([(1, "http://a.org/", "h", 1, 2)], SCHEMA)
    assert [r.verdict for r in u.url_filter(d, rules=[]).collect()] == ["allow"]
