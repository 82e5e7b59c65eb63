import random

import pytest
from pyspark.sql import functions as F

from tabwise.llm import url_filters as uf


def _split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), path


def _verdict(host, path, rules):
    fits = [(len(h + p), len(h), v == "block", v, h + p) for h, p, v in rules
            if h and p is not None and v and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (best[4], best[3]) if best else (None, "allow")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.net", "/en", "block"), ("a.b.example.net", "", "block"), ("org", "/x", "allow"),
         ("b.org", "/", "block"), ("", "/", "block"), (None, "/", "block"), ("de", None, "block"), ("UK", "/", "block"), ("é.fr", "/ä/", "block")]
URLS = [None, "", "no scheme", "http://", "http:///p", "http://net", "http://net/", "HTTP://NET/", "https://www.example.net/en/1?q=/x#y", "https://example.net/english",
        "https://badexample.net/en/", "ftp://a.b.example.net?x=/en/", "http://x.a.b.example.net", "http://b.org/x", "http://a.b.org/x/y", "http://borg/x", "s://u:p@host.net:80/a",
        "http://a.uk/z", "http://x.é.fr/ä/1", "http://x.net/a\nb?c", "http://one://two.net/", "http://." + "a." * 400 + "net/" + "p/" * 3000, "http://.net/", "http://net./"]


def test_operator_equals_definition(spark):
    r = random.Random(1)
    urls = URLS + ["http://" + ".".join(r.choice(["a", "b", "example", "net", "org", "uk"]) for _ in range(r.randrange(1, 5))) + r.choice(["", "/", "/en", "/en/", "/x/y", "?a", "#b/"])
                   for _ in range(300)]
    rows = [(i if i % 9 else None, u, "h", "r") for i, u in enumerate(urls)] + [(5, "http://net/", "h", "r")] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, host string, digest string").repartition(3)
    got = uf.filter_urls(df, uf.rules_frame(spark, RULES)).collect()
    rules = [(h and h.lower(), p, v) for h, p, v in RULES]
    want = [(i, u, "r", *_split(u), *_verdict(*_split(u), rules)) for i, u, _, _ in rows]
    assert sorted(((x.page_id, x.url, x.digest, x.host, x.path, x.rule, x.verdict) for x in got), key=str) == sorted(want, key=str)
    assert uf.filter_urls(df.filter(F.lit(False)), uf.rules_frame(spark, RULES)).count() == 0
    nothing = uf.filter_urls(df, uf.rules_frame(spark, []), default="block").select("rule", "verdict").distinct().collect()
    assert [tuple(x) for x in nothing] == [(None, "block")]


def test_long_rules_are_an_error(spark):
    df = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    for rule in (("a." * 200 + "b", "/", "block"), ("a", "/" * 5000, "block")):
        with pytest.raises(ValueError):
            uf.filter_urls(df, uf.rules_frame(spark, [rule]))


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    plan = uf.filter_urls(df, uf.rules_frame(spark, RULES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
