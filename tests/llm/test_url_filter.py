"""URL filters: parsing and rules by cases, the models against plain dictionaries."""

import hashlib
import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from streamloom.llm import queries
from streamloom.llm import url_filter as uf

DATA = "/root/testdata/sf0.001"
CASES = [
    (None, "", "", None), ("", "", "", None), ("no scheme.net/", "", "", None), ("http://", "", "", None), ("http://A.ExAmple.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/"),
    ("http://example.net/EN/x", "example.net", "/EN/x", "net/"), ("http://net/", "net", "/", "net/"), ("http://a.net", "a.net", "", None), ("http://anet/", "anet", "/", None), ("http://a.net?/", "a.net", "", None),
    ("x://example.com/de/", "example.com", "/de/", "example.com/de/"), ("x://sub.example.com/de", "sub.example.com", "/de", None), ("x://badexample.com/de/1", "badexample.com", "/de/1", None), ("x://w.org/fr/\nq", "w.org", "/fr/\nq", "org/fr/"),
    ("a://b://c.net/d", "b:", "//c.net/d", None), ("http://ÄÖ.net/ü#", "ÄÖ.net", "/ü", "net/"), ("http://h#f/net/", "h", "", None),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(CASES)], "page_id long, url string")
    got = {r.page_id: r for r in uf.judge(df, keep=["page_id"]).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(CASES))] == [c[1:] for c in CASES]
    assert all(r.verdict == ("allow" if r.rule in ("example.net/en/", "org/fr/") else "block") for r in got.values() if r.rule)


def sym(text):
    return "".join("0" if c in "0123456789" else c.lower() if re.match("[A-Za-z]", c) else c if c in "./-_" else "~" for c in text)


def plain(urls):
    """Verdicts and scores of (host + path, rule)."""
    allow = {r for how, r in uf.RULES if how == "allow"}
    out = lambda t: hashlib.md5(t.encode()).hexdigest()[0] in "012"
    counts = {c: [{} for _ in range(4)] for c in (True, False)}
    for t, rule in urls:
        if rule and not out(t):
            s = "~~~" + sym(t)
            for i in range(3, len(s)):
                for k in range(4):
                    of = counts[rule in allow][k].setdefault(s[i - k : i], {})
                    of[s[i]] = of.get(s[i], 0) + 1

    def p(c, h, s):
        value = 1 / 32
        for k in range(len(h) + 1):
            of = counts[c][k].get(h[len(h) - k :], {})
            value = (of.get(s, 0) + len(of) * value) / (sum(of.values()) + len(of)) if of else value
        return value

    if not all(counts[c][0] for c in counts):
        return [("block" if rule and rule not in allow else "allow", 0.0) for _, rule in urls]

    def score(t):
        s = "~~~" + sym(t)
        found = [math.log(p(True, s[i - 3 : i], s[i])) - math.log(p(False, s[i - 3 : i], s[i])) for i in range(3, len(s))]
        return round(sum(found) / len(found), 9) if found else 0.0

    scores = [score(t) for t, _ in urls]
    calib = [(math.floor(s * 100), rule in allow) for s, (t, rule) in zip(scores, urls, strict=True) if rule and out(t)]
    n = {c: sum(a == c for _, a in calib) for c in (True, False)}
    # Every value on the way, not only those next to a row.
    span = range(min(b for b, _ in calib) + 1, max(b for b, _ in calib) + 2) if all(n.values()) else []
    edges = [(-(sum(b < e and not a for b, a in calib) / n[False] - sum(b < e and a for b, a in calib) / n[True]), abs(e), e) for e in span]
    least = min(edges)[2] / 100 if edges else 0.0
    return [(("allow" if rule in allow else "block") if rule else "block" if s < least else "allow", s) for s, (_, rule) in zip(scores, urls, strict=True)]


def check(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(uf.judge(df, keep=["page_id"]).collect(), key=lambda r: r.page_id)
    want = plain([(r.host + r.path, r.rule) for r in got])
    assert [r.verdict for r in got] == [v for v, _ in want]
    assert np.allclose([r.score for r in got], [s for _, s in want], atol=1e-8)
    return got


def test_models_and_threshold_against_dictionaries(spark):
    rng = np.random.default_rng(4)
    good, bad = ["news", "wiki", "Ünder", "blog"], ["casino", "pills", "win", "bets"]
    urls = [f"http://{rng.choice(good if ok else bad)}-{rng.integers(0, 99)}.{rng.choice(['example.org/fr' if ok else 'shop.net/x', 'site.com/q'])}/{rng.choice(good if ok else bad)}{rng.integers(0, 999)}" for ok in rng.integers(0, 2, 400)]
    got = check(spark, urls + [None, "", "http://?x", urls[3], urls[3], "http://a.com/" + "y" * 100_000])
    free = [r for r in got if not r.rule and re.search("|".join(good + bad), r.host)]
    right = [(r.verdict == "allow") == bool(re.search("|".join(good), r.host)) for r in free]
    assert len(free) > 150 and sum(right) / len(right) > 0.9


def test_one_class_or_none(spark):
    check(spark, ["http://a.net/x", "http://b.com/"])
    check(spark, ["http://b.com/", None])
    assert uf.judge(spark.createDataFrame([], "url string")).count() == 0


def test_names_that_clash(spark):
    df = spark.createDataFrame([("http://a.org/fr/", "h", "t", 1)], "url string, host string, text string, page_id int")
    assert [tuple(r)[:4] for r in uf.judge(df, keep=["page_id", "text"]).collect()] == [(1, "t", "a.org", "/fr/")]
    with pytest.raises(ValueError):
        uf.judge(df, keep=["host"])
    with pytest.raises(ValueError):
        uf.rule_of(F.lit(""), F.lit(""), [("allow", f"h{i}/") for i in range(uf.MOST_RULES + 1)])


def test_query_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    got = queries.op13_url_filter(spark, DATA)
    found = db.execute(uf.oracle())
    assert [c[0] for c in found.description] == got.columns
    rows = lambda x: sorted((tuple(round(c, 6) if isinstance(c, float) else c for c in r) for r in x), key=repr)
    assert rows(got.collect()) == rows(found.fetchall())
