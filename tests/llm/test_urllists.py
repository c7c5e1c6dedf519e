from clipgrove.llm import urllists


def run(spark, captures, entries, **kw):
    c = spark.createDataFrame(captures, "page_id long, url string, at long").selectExpr("*", "'x' as list", "1 as m", "'p' as pattern")
    e = spark.createDataFrame(entries, "list string, pattern string, at long, active boolean").selectExpr("*", "1L as page_id")
    return {(r.page_id, r.at): (r.blocked, r.list, r.pattern, r.valid_from) for r in urllists.evaluate(c, e, **kw).collect()}


def test_state_at_fetch_time(spark):
    entries = [("l", "ads.example.com", 100, True), ("l", "ads.example.com", 200, False), ("l", "ads.example.com", 5000, True),
               ("m", "example.com", 150, True), ("m", "example.com", 160, False), ("m", "shop.example.com/sale/", 0, True)]
    url = "http://u:p@ADS.example.com:8080/a/b?q"
    caps = [(i, url, t) for i, t in enumerate((99, 100, 155, 199, 200, 4999, 5000, 9000))]
    caps += [(20, "https://shop.example.com/sale/x", 10), (21, "https://shop.example.com/sales", 10), (22, "https://badexample.com/", 155)]
    got = run(spark, caps, entries, bucket=64)
    hit = (True, "l", "ads.example.com")
    assert [got[c[0], c[2]][0] for c in caps] == [False, True, True, True, False, False, True, True, True, False, False]
    assert got[2, 155][:3] == hit and got[7, 9000] == (*hit, 5000)
    assert got[20, 10] == (True, "m", "shop.example.com/sale/", 0)


def test_ties_nulls_and_empty_tables(spark):
    caps = [(1, None, 5), (2, "http://a.b/", None), (3, "no url", 5), (4, "http://a.b/", 5), (4, "http://a.b/", 5), (None, "http://a.b/", 5), (5, "", 5)]
    entries = [("z", "a.b", 5, True), ("y", "a.b", 5, True), ("y", "a.b", 5, False), ("y", None, 1, True), (None, "a.b", 1, True), ("y", "a.b", None, True)]
    got = run(spark, caps, entries)
    assert got[4, 5] == (True, "y", "a.b", 5) and got[None, 5][0]
    assert not any(got[k][0] for k in ((1, 5), (2, None), (3, 5), (5, 5))) and len(got) == 6
    assert not run(spark, caps, entries[:0])[4, 5][0] and run(spark, caps[:0], entries) == {}


def test_many_entries_of_one_pattern(spark):
    flips = [("l", "hot.org", t * 10, t % 2 == 0) for t in range(500)]
    caps = [(i, "http://hot.org/", i * 7) for i in range(700)]
    got = run(spark, caps, flips, bucket=100)
    assert all(got[i, t][0] == (t // 10 % 2 == 0) for i, _, t in caps)


def test_every_capture_has_its_row(spark):
    rows = [(1, "http://bad.org/a", 5), (1, "http://good.org/", 5), (1, "http://bad.org/a", 5), (None, "http://bad.org/", None), (None, "http://good.org/", None),
            (None, "http://good.org/", 5), (None, "http://bad.org/", 5), (2, None, None), (2, None, None)]
    entries = spark.createDataFrame([("l", "bad.org", 1, True), ("m", "bad.org", 2, True)], "list string, pattern string, at long, active boolean")
    got = urllists.evaluate(spark.createDataFrame(rows, "page_id long, url string, at long"), entries).collect()
    want = [(i, t, u == "http://bad.org/a" or i is None and t == 5 and "bad" in u) for i, u, t in rows]
    assert sorted(map(str, want)) == sorted(str((r.page_id, r["at"], r.blocked)) for r in got)


def test_paths_keep_their_case(spark):
    entries = [("l", "Site.ORG/Secret/", 0, True), ("l", "site.org/Page", 0, True)]
    urls = ["http://site.org/Secret/x", "http://SITE.org/secret/x", "http://site.org/Page", "http://site.org/page", "http://site.org/Page/", "http://site.org/Secret/", "http://site.org/Secret"]
    got = run(spark, [(i, u, 5) for i, u in enumerate(urls)], entries)
    assert [got[i, 5][0] for i in range(len(urls))] == [True, False, True, False, False, True, False]


def test_long_urls(spark):
    import time

    deep = "http://a.b/" + "/".join("x" * 5 for _ in range(3)) + "/" * 200_000 + "y" * 800_000
    wide = "http://" + "h." * 100_000 + "bad.org/x"
    entries = [("l", "a.b/xxxxx/xxxxx/", 0, True), ("l", "bad.org", 0, True), ("l", "a.b//", 0, True)]
    start = time.time()
    got = run(spark, [(1, deep, 5), (2, wide, 5), (3, "http://a.b//z", 5), (4, "http://a.b/", 5)], entries)
    assert [got[i, 5][0] for i in (1, 2, 3, 4)] == [True, True, True, False] and time.time() - start < 60
