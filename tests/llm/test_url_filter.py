import itertools
import random

from starcellar.llm.url_filter import judge_urls, rule_frame

RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr", "block"), ("a.org", "/", "allow"),
    ("a.org", "/fr", "block"), ("com", "", "block"), ("x.com", "/p/q", "allow"), ("x.com", "/p/q", "allow"), (None, "/", "block"),
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = "".join(itertools.takewhile(lambda c: c not in "/?#", rest))
    path = "".join(itertools.takewhile(lambda c: c not in "?#", rest[len(host):]))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def judged(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h is not None
            and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_against_each_rule(spark):
    draw = random.Random(3)
    hosts = ["net", "EXAMPLE.net", "a.org", "b.a.ORG", "org", "xorg", "x.com", "y.x.com", "..net", "", "a.net:80", "É.org"]
    paths = ["", "/", "/en/", "/en/1", "/fr", "/french", "/p/q", "/p/qr/s", "/P/q", "?q=/en/", "#/fr", "/a?b#c://d", "/" * 300]
    urls = [f"{s}{draw.choice(hosts)}{draw.choice(paths)}" for s in ("http://", "x://", "//", "a:///", "http://y://") for _ in range(40)]
    urls += [None, "", "://", "no scheme", urls[0], urls[0], "http://" + "a." * 2000 + "net/" + "p/" * 2000]
    rows = [(i if i % 9 else None, u, "h", "r") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    got = judge_urls(pages, rule_frame(spark, RULES)).collect()
    want = [(i, *judged(u, RULES)) for i, u, _, _ in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    none = rule_frame(spark, [])
    assert list(map(tuple, judge_urls(pages, none, default="block").collect())) == [(1, "a.net", "/x", None, "block")]
    assert judge_urls(pages.limit(0), rule_frame(spark, RULES)).collect() == []


def test_rules_that_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr("starcellar.llm.url_filter.SENT_RULES", 2)
    pages = spark.createDataFrame([(i, f"http://h{i}.net/en/") for i in range(50)], "page_id long, url string")
    assert {r.verdict for r in judge_urls(pages, rule_frame(spark, RULES)).collect()} == {"block"}
