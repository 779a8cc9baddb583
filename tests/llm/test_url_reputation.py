import duckdb
import pandas as pd
import pytest

from lumaspark.llm import queries, url_reputation
from pyspark.sql import functions as F

URLS = [
    "http://Example.COM/en/1?x#y", "https://www.example.com/en/a", "https://a.www.example.com/en/", "https://m.b.net/es/3", "ftp://b.net/fr", "ftp://b.net/fr/x",
    "nothing", None, "://", "http://x.org", "http://x.org?a=/b", "http://x.org#/c", "http://shop.co.uk/p", "http://example.com", "http://notexample.com/en/", "a://b://c/d", "http://10.0.0.1:80/a", "http://10.0.0.1/b", "http://[::1]:8080/", "http://u:p@k.co.uk:8/",
]


def test_equals_duckdb(spark, tmp_path):
    pages = [(i, u) for i, u in enumerate(URLS)] + [(100 + i, f"http://h{i % 9}.d{i % 3}.org/p{i}") for i in range(200)] + [(400 + i, f"http://bad.org/{i}") for i in range(80)] + [(400, "http://bad.org/0"), (None, "http://z.org/")] + [(600 + i, f"http://10.0.0.{i % 3}:{i}/") for i in range(40)]
    marks = [(100 + i, int(i % 7 > 0), 0) for i in range(200)] + [(400 + i, 0, 0) for i in range(80)] + [(600 + i, i % 2, 0) for i in range(40)] + [(0, 1, 0), (0, 0, 0), (None, 0, 0), (1, None, 1)]
    spark.createDataFrame(pages, "page_id long, url string").selectExpr("*", "'h' as host", "'v' as verdict").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op9_url_filters(spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(queries.OP9_SQL).df()
    key = lambda d: sorted(tuple("-" if pd.isna(x) else str(x) for x in r) for r in d[["page_id", "host", "path", "rule", "verdict"]].astype({"page_id": "Int64"}).itertuples(index=False))
    assert key(got) == key(want)
    assert (got[got.host == "bad.org"].verdict == "block").all() and (got[got.host == "z.org"].verdict == "allow").all()


def test_hosts_and_rules(spark):
    rows = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r.page_id: r for r in url_reputation.filter_urls(rows, spark.createDataFrame([], "page_id long, bad int"), queries.URL_RULES).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("example.com", "/en/1", "example.com/en/", "block")
    assert got[1].rule == got[2].rule == "www.example.com/en/" and got[1].verdict == "allow"
    assert got[3].rule == "net/es/" and got[4].rule is None and got[5].verdict == "block"
    assert [(got[i].host, got[i].path) for i in (6, 7, 8)] == [("", "")] * 3
    assert got[9].path == got[10].path == got[11].path == "" and got[10].host == "x.org"
    assert got[13].rule is None and got[14].rule == "com/" and (got[15].host, got[15].path) == ("b:", "//c/d")


def test_domains(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("x.y.org",), ("org",), ("co.uk",), ("10.0.0.1:80",), ("[::1]:8",), ("u@a.b.org:443",)], "host string")
    got = [tuple(r) for r in hosts.select(url_reputation.suffix_of(F.col("host")), url_reputation.domain_of(F.col("host"))).collect()]
    assert got == [("co.uk", "b.co.uk"), ("org", "y.org"), ("org", "org"), ("co.uk", "co.uk"), ("10.0.0.1", "10.0.0.1"), ("[::1]", "[::1]"), ("org", "b.org")]


def test_shrinkage_and_empty_tables(spark):
    rows = [("a.one.org", 1)] + [("b.one.org", 1)] * 50 + [("c.two.org", 0)] * 50 + [("d.two.org", None), ("", 1), (None, 1)]
    got = {r.host: r for r in url_reputation.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert set(got) == {"a.one.org", "b.one.org", "c.two.org"}
    assert got["c.two.org"].mean < 0.5 < got["a.one.org"].mean and got["a.one.org"].bound < got["b.one.org"].bound
    assert url_reputation.filter_urls(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad int")).count() == 0


@pytest.mark.parametrize("table", ["pages"])
def test_plan_is_native(spark, table):
    plan = queries.op9_url_filters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
