import itertools
import re

import pytest

from tallyforge.llm import url_rules
from tests.llm.conftest import SF

URLS = [
    "http://a.net/x", "https://WWW.Example.NET/en/1?x=1", "https://example.net/EN/1", "http://net/", "http://a.net", "http://xnet/", "http://b.example.com/de/5#t", "http://example.com/dex",
    "http://x.org/fr/", "http://org.fr/org/fr/", "no scheme", "", None, "http://", "ftp://a.org:80/fr/x?://", "x://y?q=a://b.net/", "a://b.net/c://d", "http://café.org/fr/é",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = path = ""
    if rest is not None:
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = max(((len(h + p), h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, None))
    return host, path, best[1], best[2]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, u, "h") for i, u in enumerate(URLS)] + [(0, URLS[0], "h"), (None, "http://a.net/x", "h")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_odd_rows(pages):
    out = url_rules.url_filter(pages).collect()
    assert len(out) == len(URLS) + 2
    for r in out:
        host, path, rule, verdict = brute(URLS[r.page_id or 0])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert all(r.verdict == "allow" for r in out if not r.host)


def test_empty_table(spark):
    assert url_rules.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_whole_table(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    out = url_rules.op9_url_rules(spark, SF).collect()
    assert sorted(r.page_id for r in out) == sorted(pages)
    for r in out:
        host, path, rule, verdict = brute(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


def test_rules_and_verdicts_equal_brute_force(spark):
    urls = [(f"http://{a}.{b}.xyz/{c}/{i}", "block" if a == "spam" and c != "ok" else "allow") for i, (a, b, c) in enumerate(itertools.product(("spam", "news", "shop"), ("one", "two"), ("ok", "win", "buy")))]
    labels = spark.createDataFrame(urls, "url string, verdict string")
    probe = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(urls)] + [(90, "http://spam.three.xyz/win/9"), (91, "http://fresh.site/")], "page_id long, url string")
    host, path = url_rules.split_url(labels["url"])
    seen = [(set(r[0]), r[1]) for r in labels.select(url_rules.tokens(labels["url"], host, path), "verdict").collect()]
    support, confidence = 0.05, 0.9
    rules = {}
    for n in range(1, 8):
        for some in itertools.combinations(sorted(set().union(*(t for t, _ in seen))), n):
            having = [v for t, v in seen if set(some) <= t]
            for verdict in ("allow", "block"):
                if having and having.count(verdict) / len(seen) >= support and having.count(verdict) / len(having) >= confidence:
                    rules[some, verdict] = (having.count(verdict) / len(having), having.count(verdict) / len(seen))
    kept = {k: v for k, v in rules.items() if not any(set(s) < set(k[0]) and w == k[1] and c[0] >= v[0] for (s, w), c in rules.items())}
    mined = url_rules.mine_rules(labels.select(url_rules.tokens(labels["url"], host, path).alias("tokens"), "verdict"), support, confidence).collect()
    assert {(tuple(r.antecedent), r.verdict) for r in mined} == set(kept)
    out = {r.page_id: r for r in url_rules.url_filter(probe, rules=[], labels=labels, min_support=support, min_confidence=confidence).collect()}
    ph, pp = url_rules.split_url(probe["url"])
    for r in probe.select("page_id", url_rules.tokens(probe["url"], ph, pp).alias("t")).collect():
        fits = [(c, s, len(a), v) for (a, v), (c, s) in kept.items() if set(a) <= set(r.t)]
        assert out[r.page_id].verdict == (max(fits)[3] if fits else "allow")
    assert out[90].verdict == "block" and out[91].verdict == "allow"


def test_no_python_on_the_path(pages, plans):
    assert plans(url_rules.url_filter(pages), 4)


def test_long_urls_and_clashing_columns(spark):
    long = "http://very.long.xyz/" + "part/" * 40_000 + "?" + "&".join(f"k{i}=v" for i in range(2000))
    rows = [(1, long, 7, "h", "p", ["t"], "block", 0.5), (2, "http://a.net/x", 8, None, None, [], "allow", 0.1), (2, None, 8, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, row int, host string, path string, tokens array<string>, verdict string, confidence double")
    out = {(r.page_id, r.host): r for r in url_rules.url_filter(pages).collect()}
    assert len(out) == 3 and out[1, "very.long.xyz"].path == "/" + "part/" * 40_000 and out[1, "very.long.xyz"].verdict in ("allow", "block")
    assert out[2, "a.net"].verdict == "block" and out[2, ""].verdict == "allow"


def test_labels_without_a_verdict_are_ignored(spark):
    labels = spark.createDataFrame([("http://a.b/c", "block"), ("http://a.b/d", None)], "url string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.b/z"), (2, "ftp://q.r/")], "page_id long, url string")
    out = {r.page_id: r.verdict for r in url_rules.url_filter(pages, rules=[], labels=labels, min_support=0.5).collect()}
    assert out == {1: "block", 2: "allow"}
