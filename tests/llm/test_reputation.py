"""Reputation of hosts: the SQL, the shrinkage, and odd URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from objectlake.llm import reputation as R
from tests.llm.helpers import rows


def pages(spark, urls):
    return spark.createDataFrame([(n, u) for n, u in enumerate(urls)], "page_id long, url string").select("*", F.lit("x").alias("host"), F.lit("x").alias("document"), F.lit("x").alias("n"))


def labels(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, quality int")


def test_against_sql(same_as_sql):
    same_as_sql("op7_url_reputation")


def _hosts(spark):
    urls, own = [], []
    for host, n, bad in (("good.site.com", 40, 0), ("bad.spam.com", 40, 38), ("new.spam.com", 1, 1), ("new.site.com", 1, 1), ("other.net", 30, 3)):
        for i in range(n):
            own.append((len(urls), int(i >= bad)))
            urls.append(f"https://{host}/en/{len(urls)}/x.html")
    return pages(spark, urls), labels(spark, own)


def test_filter_and_shrinkage(spark):
    found = {r.host: r for r in R.reputation(*_hosts(spark)).collect()}
    assert not found["bad.spam.com"].keep
    assert all(found[h].keep for h in ("good.site.com", "other.net", "new.site.com"))
    # one bad page each: the host of the worse domain is trusted less, and neither as little as its own outcome says
    assert found["new.site.com"].bad_rate < found["new.spam.com"].bad_rate < 1
    assert found["good.site.com"].bound <= found["good.site.com"].bad_rate


def test_without_labels(spark):
    p, l = _hosts(spark)
    got = R.reputation(p, l.limit(0)).collect()
    assert len(got) == p.count()
    assert {(r.bad_rate, r.bound, r.keep, r.labelled) for r in got} == {(None, None, True, 0)}


def test_odd_urls(spark):
    p, l = _hosts(spark)
    urls = [None, "", "not a url", "https://", "http://[::1]/en/1/", "https://user:pw@GOOD.Site.com.:8080/en/999999999999999999999/", "ftp://10.0.0.1/x", "http://localhost", "https://a.b.co.uk/en/1/x"]
    odd = pages(spark, urls).withColumn("page_id", F.col("page_id") + 10_000)
    got = {r.page_id - 10_000: r for r in R.reputation(p.unionByName(odd), l).where("page_id >= 10000").collect()}
    assert len(got) == len(urls)
    for n in range(4):
        assert (got[n].host, got[n].bad_rate, got[n].keep) == (None, None, True)
    assert got[5].host == "good.site.com"
    assert got[6].host == "10.0.0.1"
    assert got[7].keep


def test_repeated_and_null_ids(spark):
    p, l = _hosts(spark)
    twice = p.unionByName(p).unionByName(p.limit(1).selectExpr("cast(null as long) as page_id", "url", "host", "document", "n"))
    assert R.reputation(twice, l).count() == twice.count()


def test_least_of_several_labels(spark):
    p, l = _hosts(spark)
    more = l.unionByName(l.selectExpr("doc_id", "1 as quality")).unionByName(l.selectExpr("doc_id", "cast(null as int) as quality"))
    assert rows(R.reputation(p, more)) == rows(R.reputation(p, l))


def test_empty(spark):
    p, l = _hosts(spark)
    assert R.reputation(p.limit(0), l).count() == 0


def test_suffixes(spark):
    """The cases that the list's own site gives for its rules."""
    want = {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "com": ("com", "com"), "x.example.com": ("com", "example.com"),
        "a.b.c.ck": ("c.ck", "b.c.ck"), "www.ck": ("ck", "www.ck"), "a.www.ck": ("ck", "www.ck"), "ck": ("ck", "ck"),
        "b.city.kobe.jp": ("kobe.jp", "city.kobe.jp"), "a.b.c.kobe.jp": ("c.kobe.jp", "b.c.kobe.jp"), "me.github.io": ("github.io", "me.github.io"),
        "host.unlisted": ("unlisted", "host.unlisted"), "localhost": ("localhost", "localhost"), "10.0.0.1": ("10.0.0.1", "10.0.0.1"), "a.b.com.sg": ("com.sg", "b.com.sg"),
        "shop.xn--55qx5d.cn": ("xn--55qx5d.cn", "shop.xn--55qx5d.cn"),
    }
    got = R.registered(spark.createDataFrame([(h, 1) for h in want], "host string, n int"))
    assert {r.host: (r.suffix, r.domain) for r in got.collect()} == want
    own = R.registered(spark.createDataFrame([("a.b.c",)], "host string"), ["b.c"]).first()
    assert (own.suffix, own.domain) == ("b.c", "a.b.c")


def test_empty_pages(spark):
    p, l = _hosts(spark)
    assert R.reputation(p.limit(0), l).count() == 0
