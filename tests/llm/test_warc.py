from pyspark.sql import functions as F

from ledgermill.llm import warc


def caps(spark, rows):
    return spark.createDataFrame(rows, "capture_id long, url string, captured long, status int, headers map<string,string>, canonical string")


def test_canonical_url(spark):
    cases = {
        "HTTP://www.Example.com:80/a/b/?b=2&utm_source=x&a=1#frag": "example.com/a/b?a=1&b=2",
        "https://example.com/": "example.com",
        "example.com/A?ref=1": "example.com/A",
        "https://example.com/x?": "example.com/x",
        "": "",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r["u"]: r["c"] for r in df.select("u", warc.canonical_url(F.col("u")).alias("c")).collect()} == cases


def test_as_of_across_blocks_equals_plain_scan(spark):
    import random

    rng = random.Random(1)
    rows = []
    for k in range(800):
        url = rng.choice(["http://a.com/x", "https://www.a.com/x/", "http://b.com/"] + ["http://hot.com/"] * 5)
        rows.append((k, url, rng.randrange(400), rng.choice([200, 304, 304, 404]), {"ETag": f'"{rng.randrange(2)}"', "Date": str(k), "X-Own": str(k)}, None))
    plain, last = {}, {}
    for k, url, t, status, h, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        c = url.split("://")[1].removeprefix("www.").rstrip("/")
        low = {x.lower(): y for x, y in h.items()}
        if status == 200:
            plain[k], last[c] = ("response", None, low), (k, low)
        elif status != 304:
            plain[k] = ("other", None, low)
        elif c not in last:
            plain[k] = ("orphan", None, low)
        elif last[c][1]["etag"] == low["etag"]:
            plain[k] = ("resolved", last[c][0], {**last[c][1], "date": low["date"]})
        else:
            plain[k] = ("mismatch", None, low)
    for block in (7, 10_000):
        got = {r["capture_id"]: (r["resolution"], r["source_id"], r["headers"]) for r in warc.resolve_revisits(caps(spark, rows), block).collect()}
        assert got == plain


def test_edge_cases(spark):
    rows = [
        (1, None, 5, 304, {"ETag": "x"}, None),
        (2, None, 1, 200, {"ETag": "x"}, None),
        (3, "http://a/", None, 200, None, "q"),
        (4, "http://a/", 1, 304, None, "q"),
        (4, "http://a/", 1, 304, None, "q"),
        (5, "http://a/", 2, None, {"A": "1", "a": "2"}, "q"),
        (6, "http://b/", 2, 200, {"ETag": 'W/"1"', "Last-Modified": "t"}, "q"),
        (7, "http://b/", 3, 304, {"etag": '"1"', "X": "no", "expires": "soon"}, "q"),
        (8, "http://b/", 3, 304, {"last-modified": "u"}, "q"),
    ]
    got = sorted((r["capture_id"], r["resolution"], r["source_id"]) for r in warc.resolve_revisits(caps(spark, rows)).collect())
    assert got == [(1, "orphan", None), (2, "response", None), (3, "response", None), (4, "resolved", 3), (4, "resolved", 3), (5, "other", None), (6, "response", None), (7, "resolved", 6), (8, "mismatch", None)]
    merged = warc.resolve_revisits(caps(spark, rows)).where("capture_id = 7").first()["headers"]
    assert merged == {"etag": '"1"', "last-modified": "t", "expires": "soon"}
    assert warc.resolve_revisits(caps(spark, rows).limit(0)).count() == 0
