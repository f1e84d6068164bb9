from datetime import date

from stratagrid.llm.url_lists import evaluate, host, intervals, keys

import pytest
from pyspark.sql import functions as F

LOG = [
    ("bad", "host:evil.com", "add", date(2024, 1, 10)), ("bad", "host:evil.com", "remove", date(2024, 2, 1)), ("bad", "host:evil.com", "add", date(2024, 3, 1)),
    ("bad", "host:evil.com", "add", date(2024, 3, 5)), ("bad", "host:evil.com", "add", date(2024, 3, 5)), ("bad", "path:ok.org/x", "remove", date(2024, 1, 1)),
    ("bad", "path:ok.org/x", "add", date(2024, 1, 5)), ("adult", "url:http://ok.org/x/y?q=1", "add", date(2024, 1, 1)),
    ("bad", "host:tie.net", "add", date(2024, 1, 1)), ("bad", "host:tie.net", "remove", date(2024, 1, 1)), (None, "host:evil.com", "add", date(2023, 1, 1)), ("bad", None, "add", None),
]


def active(log, entry_keys, day):
    """Brute force: replay the log up to the day."""
    on = {}
    for name, entry, action, when in sorted((x for x in log if None not in x), key=lambda x: (x[3], x[2])):
        if when <= day:
            on[name, entry] = action == "add"
    return {k for k, v in on.items() if v and k[1] in entry_keys}


@pytest.fixture
def log(spark):
    return spark.createDataFrame(LOG, "list string, entry string, action string, day date")


def test_evaluate(spark, log):
    urls = ["http://evil.com/", "https://user@Sub.EVIL.com:80/a", "http://notevil.com", "http://ok.org/x", "http://ok.org/x/y?q=1", "http://ok.org/xy", "http://tie.net", "not a url", None, "", "http://"]
    days = [date(2024, 1, 1), date(2024, 1, 10), date(2024, 1, 31), date(2024, 2, 1), date(2024, 3, 1), date(2025, 1, 1), None]
    rows = [(i * 10 + j, u, d, "x") for i, u in enumerate(urls) for j, d in enumerate(days)] + [(None, "http://evil.com/", days[1], "x")] * 2
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched date, list string")
    of = {r["url"]: set(r["k"] or []) for r in captures.select("url", keys(F.col("url")).alias("k")).distinct().collect()}
    got = sorted(((r["page_id"], r["n_active"], r["lists"], r["blocked"]) for r in evaluate(captures, log).collect()), key=str)
    want = []
    for p, u, d, _ in rows:
        found = active(LOG, of[u], d) if d else set()
        want.append((p, len(found), ",".join(sorted({n for n, _ in found})), bool(found)))
    assert got == sorted(want, key=str) and any(w[1] for w in want)


def test_long_paths(spark):
    """Entries of any number of segments match, and captures that go deeper than any entry."""
    day = date(2024, 1, 1)
    deep = "/".join("abcdefghij")
    log = spark.createDataFrame([("bad", f"path:ok.org/{deep}", "add", day), ("adult", "path:ok.org/a/b", "add", day)], "list string, entry string, action string, day date")
    urls = [f"http://ok.org/{deep}", f"http://ok.org/{deep}/k/l?q", f"http://ok.org/{deep[:-2]}", "http://ok.org/a", "http://ok.org/", "http://no.org/" + "x/" * 300]
    captures = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "page_id long, url string, fetched date")
    assert [r["lists"] for r in evaluate(captures, log).orderBy("page_id").collect()] == ["adult,bad", "adult,bad", "adult", "", "", ""]
    hosts = log.withColumn("entry", F.lit("host:ok.org"))
    assert [r["blocked"] for r in evaluate(captures, hosts).orderBy("page_id").collect()] == [True] * 5 + [False]


def test_intervals(log):
    got = {(r["entry"], str(r["from_day"]), str(r["to_day"])) for r in intervals(log).collect()}
    assert got == {("host:evil.com", "2024-01-10", "2024-02-01"), ("host:evil.com", "2024-03-01", "None"), ("path:ok.org/x", "2024-01-05", "None"), ("url:http://ok.org/x/y?q=1", "2024-01-01", "None")}


def test_empty(spark, log):
    none = spark.createDataFrame([], "page_id long, url string, fetched date")
    assert evaluate(none, log).count() == 0
    one = spark.createDataFrame([(1, "http://evil.com", date(2024, 1, 10))], none.schema)
    assert [r["blocked"] for r in evaluate(one, log.limit(0)).collect()] == [False]


def test_address_hosts(spark):
    urls = {"http://[2001:db8::1]:8080/a/b": "[2001:db8::1]", "http://u:p@[::FFFF:1.2.3.4]/": "[::ffff:1.2.3.4]", "http://[::1]": "[::1]", "http://a.B.com:80/": "a.b.com"}
    docs = spark.createDataFrame([(u,) for u in urls], "url string").select("url", host(F.col("url")).alias("host"), keys(F.col("url")).alias("keys"))
    got = {r.url: r for r in docs.collect()}
    assert {u: r.host for u, r in got.items()} == urls
    assert got["http://u:p@[::FFFF:1.2.3.4]/"]["keys"][0] == "host:[::ffff:1.2.3.4]" and not any(k.startswith("host:") for k in got["http://u:p@[::FFFF:1.2.3.4]/"]["keys"][1:])
    assert "path:[2001:db8::1]/a" in got["http://[2001:db8::1]:8080/a/b"]["keys"]
