import re

import pytest
from llm_helpers import clashing

from planframe.llm import urlfilter
from planframe.llm.queries import URL_RULES

PAGES = "page_id long, url string, html string"
URLS = [
    "http://a.org/x",
    "https://Example.ORG/es/1?q",
    "https://b.example.org/en/123#t",
    "https://b.example.org/en/2",
    "https://notexample.com/fr/",
    "http://x.y.com/de/9",
    "http://com/de/",
    "http://a.net/fr/",
    "http://a.org?x=/",
    "http://a.org",
    "no scheme",
    None,
    "",
    "://h/p",
    "x://A.B#/://c/",
    "http://u://z.org/en/",
    "http://ÄB.com/fr/ü",
    "http://a.com\n/fr/",
]


def split(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if c.isascii() else c for c in m[1]) if m else ""
    return (host, m[2]) if m else ("", "")


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_and_parts(spark):
    pages = clashing(spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)], PAGES))
    outcomes = spark.createDataFrame([(7, 1), (7, 0), (None, 1), (3, None)], "page_id long, bad int")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, outcomes, URL_RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = split(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        name, verdict = rule(host, path)
        assert got[i]["rule"] == name and got[i]["verdict"] in ((verdict,) if verdict else ("allow", "block"))


def test_reputation_shrinks(spark):
    rows = [("bad.example.com", 1)] * 60 + [("good.example.com", 0)] * 300 + [("lone.example.com", 1)] + [("fine.other.net", 0)] * 200 + [("new.other.net", None), ("a.other.net", 0)]
    got = {r["host"]: r for r in urlfilter.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.example.com"]["low"] > 0.5 > got["good.example.com"]["rate"]
    assert got["good.example.com"]["rate"] < got["lone.example.com"]["rate"] < 1 and got["lone.example.com"]["low"] < 0.5
    assert got["new.other.net"]["n"] == 0 and got["new.other.net"]["rate"] < got["lone.example.com"]["rate"]


def test_verdict_by_reputation(spark):
    pages = spark.createDataFrame([(i, f"http://{'spam' if i % 2 else 'fine'}.net/p{i}", "") for i in range(80)], PAGES)
    outcomes = spark.createDataFrame([(i, i % 2) for i in range(0, 80, 1) if i % 4 < 2], "page_id long, bad int")
    got = urlfilter.judge(pages, outcomes).collect()
    assert all(r["verdict"] == ("block" if r["page_id"] % 2 else "allow") and r["rule"] is None for r in got)


@pytest.mark.parametrize("host,domain,suffix", [("a.b.co.uk", "b.co.uk", "co.uk"), ("www.x.example.org", "example.org", "org"), ("localhost", "localhost", "localhost"), ("", "", ""), ("co.uk", "co.uk", "co.uk")])
def test_domains(spark, host, domain, suffix):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(host,)], "h string").select(urlfilter.domain_of(F.col("h")), urlfilter.suffix_of(F.col("h"))).first()
    assert tuple(r) == (domain, suffix)


def test_repeats_and_empty_tables(spark):
    outcomes = spark.createDataFrame([], "page_id long, bad int")
    pages = spark.createDataFrame([(1, "http://a.net/", "")] * 3, PAGES)
    assert [r["verdict"] for r in urlfilter.judge(pages, outcomes).collect()] == ["allow"] * 3
    assert urlfilter.judge(pages.limit(0), outcomes, URL_RULES).count() == 0
