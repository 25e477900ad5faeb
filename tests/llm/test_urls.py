import datetime as dt

from pyspark.sql import functions as F

from wardline.llm import urls

D = dt.date
ENTRIES = [
    ("bad.example", D(2024, 1, 10), True), ("bad.example", D(2024, 2, 10), False), ("bad.example", D(2024, 3, 10), True), ("bad.example", D(2024, 3, 10), True), ("sub.bad.example", D(2024, 2, 1), True),
    ("tie.example", D(2024, 1, 1), True), ("tie.example", D(2024, 1, 1), False), ("again.example", D(2024, 1, 1), True), ("again.example", D(2024, 1, 5), True), ("never.example", D(2024, 1, 1), False),
    (None, D(2024, 1, 1), True), ("null.example", None, True), ("null.example", D(2024, 1, 1), None), ("LOUD.example", D(2024, 1, 1), True),
]
URLS = [
    "http://bad.example/a", "https://user:pw@x.sub.BAD.example.:80/p?q#f", "http://notbad.example/", "http://tie.example", "http://again.example", "http://null.example", "http://loud.example/x", "relative/path", None, "ftp://never.example", "http://localhost/",
]


def brute(url, day):
    import re

    m = re.match(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", (url or "").lower())
    if not m or day is None:
        return None
    labels = m[1].rstrip(".").split(".")
    for i in range(max(1, len(labels) - 1)):
        name, state = ".".join(labels[i:]), False
        events = {}
        for d, at, on in ENTRIES:
            if d is not None and at is not None and on is not None and d.lower() == name:
                events[at] = events.get(at, False) or on
        for at in sorted(events):
            if at <= day:
                state = events[at]
        if state:
            return name
    return None


def test_every_capture_against_brute_force(spark):
    days = [D(2024, 1, 1), D(2024, 1, 10), D(2024, 2, 9), D(2024, 2, 10), D(2024, 3, 11), None]
    rows = [(k, u, d, 1) for k, (u, d) in enumerate([(u, d) for u in URLS for d in days] * 2)]
    frame = spark.createDataFrame(rows, "page_id int, url string, fetched_at date, domain int").repartition(3)
    entries = spark.createDataFrame(ENTRIES, "domain string, at date, listed boolean")
    got = {r.page_id: r for r in urls.filter_urls(frame, entries).collect()}
    assert len(got) == len(rows)
    for k, u, d, _ in rows:
        assert got[k].entry == brute(u, d), (u, d)
        assert got[k].blocked == (got[k].entry is not None)


def test_empty_tables_and_clash(spark):
    entries = spark.createDataFrame(ENTRIES, "domain string, at date, listed boolean")
    frame = spark.createDataFrame([(1, "http://bad.example", D(2024, 1, 11))], "page_id int, url string, fetched_at date")
    assert urls.filter_urls(frame.where("false"), entries).collect() == []
    assert not urls.filter_urls(frame, entries.where("false")).first().blocked
    clash = urls.filter_urls(frame.select("*", F.lit(1).alias("entry"), F.lit(2).alias("host"), F.lit(3).alias("at")), entries).first()
    assert clash.entry == "bad.example" and (clash["host"], clash["at"]) == (2, 3)


def test_hosts(spark):
    cases = {
        "http://[2001:db8::1]:80/x": "[2001:db8::1]", "http://u:p@q@evil.example/": "evil.example", "  http://bad.example/": "bad.example", "HTTP://Bad.Example../": "bad.example", "http://10.1.2.3/": "10.1.2.3",
        "http:///path": None, "mailto:a@b.co": None, "": None,
    }
    got = spark.createDataFrame(list(cases.items()), "url string, want string").select("want", urls.host_of(F.col("url")).alias("host"), "url").collect()
    assert all(r.host == r.want for r in got), got
    assert spark.range(1).select(urls.suffixes(F.lit("10.1.2.3"))).first()[0] == ["10.1.2.3"]


def test_an_often_changed_domain_is_judged_at_every_moment(spark):
    """A domain that is listed and delisted 400 times, and captures at 2000 moments, as time stamps and as numbers."""
    start = dt.datetime(2024, 1, 1)
    changes = [("x.example.", start + dt.timedelta(hours=7 * i), i % 2 == 0) for i in range(400)]
    moments = [(i, "http://a.x.example/", start + dt.timedelta(hours=i, minutes=-30)) for i in range(2000)]
    entries, frame = spark.createDataFrame(changes, "domain string, at timestamp, listed boolean"), spark.createDataFrame(moments, "page_id int, url string, fetched_at timestamp")
    numbers = lambda f, c: f.withColumn(c, F.col(c).cast("long"))
    for got in (urls.filter_urls(frame, entries), urls.filter_urls(numbers(frame, "fetched_at"), numbers(entries, "at"))):
        for r in got.collect():
            before = [on for _, at, on in changes if at <= moments[r.page_id][2]]
            assert r.blocked == (bool(before) and before[-1]), r
