from datetime import datetime

from seglume.llm import urls

T = lambda d: datetime(2024, 1, d)
PAGES = "page_id long, url string, fetched_at timestamp, host string, key string"


def test_captures_are_judged_by_entries_active_at_fetch_time(spark):
    entries = spark.createDataFrame(
        [("Bad.example", "add", T(5)), ("bad.example", "add", T(6)), ("bad.example", "remove", T(10)), ("bad.example", "add", T(20)), ("sub.bad.example", "add", T(8)), ("sub.bad.example", "remove", T(12)),
         ("same.example", "add", T(3)), ("same.example", "remove", T(3)), (None, "add", T(1)), ("x.y", None, T(1)), ("x.y", "add", None)],
        "key string, action string, at timestamp",
    )
    rows = [
        (1, "http://bad.example/x", T(4), False, None), (2, "http://bad.example/x", T(5), True, "bad.example"), (3, "https://www.BAD.example:80/", T(9), True, "bad.example"),
        (4, "http://bad.example", T(10), False, None), (5, "http://u:p@bad.example.", T(21), True, "bad.example"), (6, "http://sub.bad.example/a", T(9), True, "sub.bad.example"),
        (7, "http://sub.bad.example/a", T(11), True, "sub.bad.example"), (8, "http://sub.bad.example/a", T(13), False, None), (9, "http://notbad.example", T(9), False, None),
        (10, "http://same.example", T(4), False, None), (11, None, T(9), False, None), (12, "not a url", T(9), False, None), (13, "http://bad.example", None, False, None),
        (None, "http://bad.example/" + "x" * 100_000, T(9), True, "bad.example"), (2, "http://bad.example/x", T(5), True, "bad.example"), (14, "http://x.y/", T(9), False, None),
    ]
    got = urls.judge(spark.createDataFrame([(i, u, t, "h", "k") for i, u, t, _, _ in rows], PAGES), entries).collect()
    assert sorted(map(str, ((r.page_id, r.blocked, r.rule) for r in got))) == sorted(map(str, ((i, b, k) for i, _, _, b, k in rows)))
    assert {r.page_id: r.host for r in got}[5] == "bad.example" and {r.page_id: r.host for r in got}[12] is None


def test_empty(spark):
    none, log = spark.createDataFrame([], PAGES), spark.createDataFrame([], "key string, action string, at timestamp")
    assert urls.judge(none, log).count() == 0
    assert [r.blocked for r in urls.judge(spark.createDataFrame([(1, "http://a.b", T(1), "", "")], PAGES), log).collect()] == [False]
