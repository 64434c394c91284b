from datetime import date

from folioflow.llm import urlfilter as u


def test_intervals_and_specificity(spark):
    entries = [("Bad.example", "a", "block", "2024-01-01"), ("bad.example", "a", "remove", "2024-03-01"), ("bad.example", "b", "block", "2024-06-01"), ("bad.example/ok", "c", "allow", "2024-01-15"), ("bad.example/ok/no", "d", "block", "2024-01-15"), ("twice.example", "x", "allow", "2024-01-01"), ("twice.example", "y", "block", "2024-01-01"), (None, "n", "block", "2024-01-01"), ("late.example", "n", "block", None)]
    e = spark.createDataFrame(entries, "target string, category string, action string, listed_on string")
    cases = [
        ("http://bad.example/x", date(2024, 1, 1), "drop", "a"),
        ("http://bad.example/x", date(2023, 12, 31), "keep", None),
        ("http://bad.example/x", date(2024, 3, 1), "keep", None),
        ("https://u:p@WWW.bad.example.:8080?q", date(2024, 7, 1), "drop", "b"),
        ("http://notbad.example/", date(2024, 7, 1), "keep", None),
        ("http://a.b.bad.example/ok/1", date(2024, 2, 1), "keep", "c"),
        ("http://bad.example//ok/no/2#f", date(2024, 2, 1), "drop", "d"),
        ("http://bad.example/ok/no/2", date(2024, 1, 10), "drop", "a"),
        ("http://twice.example", date(2024, 2, 1), "drop", "y"),
        ("http://late.example", date(2024, 2, 1), "keep", None),
        (None, date(2024, 2, 1), "keep", None),
        ("", date(2024, 2, 1), "keep", None),
        ("http://bad.example", None, "keep", None),
        ("http://bad.example/" + "s/" * 5000, date(2024, 2, 1), "drop", "a"),
    ]
    rows = [(i, url, d) for i, (url, d, _, _) in enumerate(cases)] * 2
    caps = spark.createDataFrame(rows, "id int, url string, fetched_on date").selectExpr("*", "'z' AS target", "1 AS depth")
    got = u.verdicts(caps, e).collect()
    assert len(got) == len(rows)
    assert all((r.verdict, r.category) == cases[r.id][2:] for r in got), [(r.id, r.verdict, r.category) for r in got]
    assert u.verdicts(caps, e.limit(0)).where("verdict = 'keep'").count() == len(rows)
    assert u.verdicts(caps.limit(0), e).count() == 0


def test_columns_of_any_names(spark):
    from pyspark.sql import functions as F

    entries = spark.createDataFrame([("a.org", "spam", "block", "2024-01-01")], "target string, category string, action string, listed_on string")
    rows = spark.createDataFrame([("http://a.org/x", 1), (None, 2)], "url string, u int").selectExpr("*", "u AS f", "u AS action", "u AS c0", "u AS key", "u AS host", "to_date('2024-02-02') AS fetched_on")
    got = u.verdicts(rows, entries)
    assert got.columns == ["url", "u", "f", "action", "c0", "key", "fetched_on", "host", "verdict", "category", "target"]
    assert sorted((r.u, r.f, r.action, r.c0, r.key, r.host, r.verdict) for r in got.collect()) == [(1, 1, 1, 1, 1, "a.org", "drop"), (2, 2, 2, 2, 2, None, "keep")]
    assert u.verdicts(rows, entries.limit(0)).where(F.col("verdict") == "drop").count() == 0
