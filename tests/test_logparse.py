from pyspark.sql import functions as F

from quarry.functions.classify import organisation, suffix_class
from quarry.functions.logparse import LOG_COLUMNS, parse_log
from quarry.plans import weblog

GOOD = 'h1.cs.tamu.edu - - [01/Jul/1995:00:00:01 -0400] "GET /history/apollo/ HTTP/1.0" 200 6245'


def _parse(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    return [r.asDict() for r in parse_log(df).collect()]


def test_good_line(spark):
    (r,) = _parse(spark, [GOOD])
    assert r == {"host": "h1.cs.tamu.edu", "timestamp": "01/Jul/1995:00:00:01 -0400",
                 "request": "GET /history/apollo/ HTTP/1.0", "reply_code": 200, "reply_bytes": 6245,
                 "day": 1, "hour": 0}


def test_malformed_lines_give_nulls_not_errors(spark):
    rows = _parse(spark, ["", "garbage", GOOD.replace("6245", "-"),
                          'x - - [bad] "GET /a HTTP/1.0" 404 -'])
    empty, garbage, dash, badts = rows
    assert empty["host"] == "" and empty["reply_code"] is None and empty["day"] is None
    assert garbage["reply_code"] is None and garbage["reply_bytes"] is None
    assert dash["reply_bytes"] is None and dash["reply_code"] == 200
    assert badts["timestamp"] == "bad" and badts["day"] is None and badts["hour"] is None


def test_inner_quote_request_is_greedy(spark):
    line = 'h - - [01/Jul/1995:00:00:01 -0400] "GET /a"b" HTTP/1.0" 200 1'
    (r,) = _parse(spark, [line])
    assert r["request"] == ' HTTP/1.0'  # text between the last two quotes


def test_typed_timestamp_optional(spark):
    df = spark.createDataFrame([(GOOD,), ("garbage",)], "value string")
    ts = [r.ts for r in parse_log(df, with_ts=True).collect()]
    assert ts[0] is not None and ts[1] is None
    assert list(parse_log(df).columns) == LOG_COLUMNS


def test_host_classes_and_organisations(spark):
    hosts = ["a.edu.foo.edu", ".edu", "FOO.EDU", "x.ox.ac.uk", "y.monash.edu.au", "z.com", "p.q.edu"]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    df = df.withColumn("cls", suffix_class(F.col("host"))).withColumn("org", organisation(F.col("host"), F.col("cls")))
    got = {r.host: (r.cls, r.org) for r in df.collect()}
    assert got["a.edu.foo.edu"] == ("US", "a")       # leftmost match
    assert got[".edu"] == ("US", "")                 # empty organisation
    assert got["FOO.EDU"] == (None, None)            # case-sensitive
    assert got["x.ox.ac.uk"] == ("UK", "ox")
    assert got["y.monash.edu.au"] == ("AUS", "monash")
    assert got["z.com"] == (None, None)
    assert got["p.q.edu"] == ("US", "q")


def test_weblog_analysis_end_to_end(spark):
    lines = ([f'h{i}.alpha.edu - - [0{1 + i % 3}/Jul/1995:1{i % 3}:00:00 -0400] "GET / HTTP/1.0" 200 1' for i in range(6)]
             + ['h.beta.edu - - [02/Jul/1995:10:00:00 -0400] "GET / HTTP/1.0" 200 1'] * 2
             + ['h.gamma.ac.uk - - [40/Jul/1995:10:00:00 -0400] "GET / HTTP/1.0" 200 1', "garbage", 'x.com - - [01/Jul/1995:00:00:00 -0400] "GET /" 200 1'])
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    with weblog.WeblogAnalysis(df, top_n=1) as wa:
        res = {k: v.collect() for k, v in wa.results("gamma", "UK").items()}
    assert {r.country_code: r["count"] for r in res["class_counts"]} == {"US": 8, "UK": 1, "AUS": 0}
    assert {r.country_code: r.n_institutions for r in res["org_distinct"]} == {"US": 2, "UK": 1, "AUS": 0}
    assert [(r.institution, r["count"]) for r in res["org_top"] if r.country_code == "US"] == [("alpha", 6)]
    share = {(r.country_code, r.institution): r["count"] for r in res["org_share"]}
    assert share[("US", "alpha")] == 6 and share[("US", "Others")] == 2 and share[("UK", "Others")] == 0
    grid = res["busiest_grid"]
    assert len(grid) == 2 * 31 * 24
    us = sum(r["count"] for r in grid if r.country_code == "US")
    uk = sum(r["count"] for r in grid if r.country_code == "UK")
    assert us == 6 and uk == 0                       # day 40 is outside the grid
    (rank,) = res["org_rank"]
    assert rank.position == 1 and rank.rank == 1
