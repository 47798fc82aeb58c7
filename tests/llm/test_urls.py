import math

import pytest
from pyspark.sql import functions as F

from clickloom.llm import urls
from clickloom.llm.queries import URL_RULES


def test_hosts_and_paths(spark):
    cases = [
        ("HTTP://WWW.Example.COM/A/b?x=/y#z", "www.example.com", "/A/b"),
        ("https://a.b#c/d", "a.b", ""),
        ("ftp://a?x://b/c", "a", ""),
        ("x://y://z/p", "y:", "//z/p"),
        ("no scheme/at all", "", ""),
        ("://h/p", "h", "/p"),
        ("a\nb://h\n/p\n", "h\n", "/p\n"),
        ("", "", ""),
        (None, "", ""),
    ]
    frame = spark.createDataFrame([(c[0],) for c in cases], "url string")
    rows = urls.parsed(frame, "url").collect()
    assert [(r.url, r.host, r.path) for r in rows] == cases


def test_registered_domains(spark):
    cases = [
        ("www.shop.example.com", "example.com", "com"),
        ("example.com:8080", "example.com", "com"),
        ("a.b.co.uk", "b.co.uk", "co.uk"),
        ("localhost", "localhost", "localhost"),
        ("10.1.2.3:80", "10.1.2.3", ""),
        ("", "", ""),
    ]
    frame = spark.createDataFrame([(c[0],) for c in cases], "host string")
    assert [tuple(r) for r in frame.select("host", *urls.registered(F.col("host"))).collect()] == cases


@pytest.mark.parametrize(
    "url, rule, verdict",
    [
        ("http://a.com/x", "com/", "allow"),
        ("http://com/", "com/", "allow"),
        ("http://a.com", None, "allow"),
        ("http://x.example.com/en/1", "example.com/en/", "block"),
        ("http://x.www.example.com/en/1", "www.example.com/en/", "allow"),
        ("http://badexample.com/en/1", "com/", "allow"),
        ("http://a.net/es/", "net/es/", "block"),
        ("http://a.net/es", None, "allow"),
        ("http://dotcom/en/", None, "allow"),
    ],
)
def test_longest_rule_wins(spark, url, rule, verdict):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    none = spark.createDataFrame([], "key long, bad boolean")
    row = urls.judge(pages, none, URL_RULES).first()
    assert (row.rule, row.verdict) == (rule, verdict)


def test_bad_hosts_are_blocked_and_shrunk_by_their_domains(spark):
    pages, outcomes = [], []

    def add(host, good, bad, unlabelled=1):
        for i in range(good + bad + unlabelled):
            key = len(pages)
            pages.append((key, f"http://{host}/p{i}"))
            if i < good + bad:
                outcomes.append((key, i >= good))

    for i in range(30):
        add(f"h{i}.fine.org", 40, 1)
        add(f"h{i}.spam.biz", 2, 40)
    add("new.fine.org", 0, 1)
    add("new.spam.biz", 0, 1)
    add("other.spam.biz", 0, 0, 5)
    frame = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame(outcomes, "key long, bad boolean")
    rows = urls.judge(frame, labels, []).select("host", "verdict", "bad_bound").distinct().collect()
    by = {r.host: r for r in rows}
    assert all(r.verdict == ("block" if "spam" in h else "allow") for h, r in by.items())
    assert by["new.fine.org"].bad_bound < 0.5 < by["other.spam.biz"].bad_bound
    assert by["new.spam.biz"].bad_bound > by["new.fine.org"].bad_bound


def test_odd_rows_extra_columns_and_empty_tables(spark):
    pages = spark.createDataFrame(
        [(1, None, "c"), (1, "http://a.b/c", "c"), (None, "http://a.b/c", "c"), (2, "", "c")],
        "page_id long, url string, host string",
    )
    outcomes = spark.createDataFrame(
        [(1, True), (1, False), (None, True), (2, None)], "key long, bad boolean"
    )
    rows = urls.judge(pages, outcomes, URL_RULES).collect()
    assert len(rows) == 4 and all(math.isfinite(r.bad_bound) for r in rows)
    assert sorted(r.host for r in rows) == ["", "", "a.b", "a.b"]
    assert urls.judge(pages.limit(0), outcomes, URL_RULES).count() == 0
    assert urls.judge(pages, outcomes.limit(0), []).count() == 4
