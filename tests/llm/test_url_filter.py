import datetime as dt

from partloom.llm import url_filter


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_as_of(spark):
    entries = spark.createDataFrame(
        [("bad.com", day(10), "block"), ("bad.com", day(100), "clear"), ("www.bad.com/ok", day(0), "allow"), ("a.good.org", day(5), "block"), ("a.good.org", day(5), "allow"), ("late.net", day(400), "block"),
         (None, day(1), "block"), ("x.com", None, "block"), ("x.com", day(1), "odd")],
        "scope string, since timestamp, action string",
    )
    urls = [
        ("http://www.bad.com/x", day(9), None, False), ("http://www.bad.com/x", day(10), "bad.com", True), ("http://www.bad.com/ok/y?z", day(50), "www.bad.com/ok", False), ("http://www.bad.com/x", day(100), None, False),
        ("https://u@B.A.GOOD.org.:80/", day(6), "a.good.org", True), ("https://good.org/", day(6), None, False), ("late.net", day(500), None, False), ("http://late.net", day(500), "late.net", True), (None, day(1), None, False), ("http://bad.com", None, None, False),
    ]
    caps = spark.createDataFrame([(i, u, t, "z") for i, (u, t, _, _) in enumerate(urls + urls[1:2])], "page_id long, url string, fetched timestamp, scope string")
    out = url_filter.judge(caps, entries)
    got = {r.page_id: (r.rule_scope, r.blocked) for r in out.collect()}
    assert got == {i: (s, b) for i, (_, _, s, b) in enumerate(urls + urls[1:2])} and out.columns[:4] == caps.columns
    assert url_filter.judge(caps.limit(0), entries).count() == 0
    assert not any(r.blocked for r in url_filter.judge(caps, entries.limit(0)).collect())
