from datetime import date, timedelta

from helpers import CLASHES
from oracle import compare
from pyspark.sql import functions as F

from heddle.llm.queries import ORACLES, QUERIES
from heddle.llm.url_lists import domains_of, host_of, judge, validity

D = lambda n: date(2024, 1, 1) + timedelta(days=n)
ENTRIES = [("bad.example", D(10), "block"), ("bad.example", D(20), "remove"), ("bad.example", D(30), "block"), ("ok.bad.example", D(12), "allow"), ("bad.example", D(20), "block"), (None, D(1), "block"), ("x.example", None, "block"), ("y.example", D(1), None)]


def entries(spark):
    return spark.createDataFrame(ENTRIES, "key string, day date, action string")


def test_validity(spark):
    got = {(r.key, r.action, r.since, r.until) for r in validity(entries(spark)).collect()}
    assert got == {("bad.example", "block", D(10), D(20)), ("bad.example", "block", D(30), None), ("ok.bad.example", "allow", D(12), None)}


def test_as_of(spark):
    asked = [(1, "https://www.bad.example/x", D(9)), (2, "https://www.bad.example/x", D(10)), (3, "http://BAD.example:80/", D(19)), (4, "https://bad.example", D(20)), (5, "https://bad.example", D(400)), (6, "https://a.ok.bad.example/", D(15)), (7, "https://notbad.example/", D(15)), (8, None, D(15)), (9, "nonsense", D(15)), (10, "https://bad.example/", None), (10, "https://bad.example/", D(15)), (None, "https://bad.example/", D(15))]
    df = spark.createDataFrame(asked, "id long, url string, day date").withColumns({c: F.lit("clash") for c in CLASHES if c != "id"})
    got = [(r.id, r.blocked, r.rule, r.active_rules) for r in judge(df, entries(spark)).collect()]
    block, none = (True, "bad.example", 1), (False, None, 0)
    expected = [(1, *none), (2, *block), (3, *block), (4, *none), (5, *block), (6, False, "ok.bad.example", 2), (7, *none), (8, *none), (9, *none), (10, *none), (10, *block), (None, *block)]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, url string, day date")
    assert judge(none, entries(spark)).count() == 0
    some = spark.createDataFrame([(1, "https://bad.example/", D(15))], "id long, url string, day date")
    assert [(r.blocked, r.active_rules) for r in judge(some, entries(spark).limit(0)).collect()] == [(False, 0)]


def test_hosts(column):
    assert column(host_of, "HTTPS://u:p@A.Example.:8080/x?y") == "a.example"
    assert column(host_of, "") is None
    assert column(domains_of, "a.b.example") == ["a.b.example", "b.example"]
    assert column(domains_of, "localhost") == ["localhost"]


def test_whole_table(spark, small):
    df = QUERIES["op9_temporal_url_lists"](spark, small)
    got, expected = compare(df, ORACLES["op9_temporal_url_lists"], small)
    assert got == expected
    assert df.where("blocked").count() > 0 and df.where("not blocked and rule is not null").count() >= 0
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
