import datetime as dt
import random

import duckdb
from pyspark.sql import functions as F

from matricula.llm import warc


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_matches_its_sql(spark, sf):
    got = warc.resolved_text(warc.resolve_revisits(warc.records_of_pages(spark.read.parquet(f"{sf}/pages.parquet"))))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    rel = con.sql(f"select {', '.join(got.columns)} from ({warc.ORACLE_SQL})")
    assert _rows(got) == sorted(rel.fetchall(), key=str)


def test_canonical_url(spark):
    cases = {
        "HTTP://Www.Ex.com:80/a/?b=2&a=1&utm_source=x#f": "www.ex.com/a?a=1&b=2", "https://ex.com:443": "ex.com", "https://ex.com:8080/": "ex.com:8080",
        " https://ex.com/A//?ref=q ": "ex.com/A", "no url": None, "": None, None: None, "https://ex.com?x#y?z": "ex.com?x",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string").select("u", warc.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == cases


def test_hot_url_against_brute_force(spark):
    rnd = random.Random(9)
    t0 = dt.datetime(2024, 1, 1)
    records = []
    for i in range(600):
        url = "https://hot.ex/a" if i % 3 else f"https://ex.com/{rnd.randint(0, 20)}"
        kind = rnd.choice(["response", "revisit", "revisit"])
        tag = rnd.choice(['"a"', 'W/"a"', '"b"', None])
        head = {"ETag": tag, "Last-Modified": rnd.choice(["d1", None]), "Content-Length": "9", "date": str(i)}
        at = t0 + dt.timedelta(seconds=rnd.randint(0, 150))
        records.append((f"r{i:04}", kind, url, at, rnd.choice([200, 200, 500]) if kind == "response" else 304, rnd.choice(["p", "q", None]), {k: v for k, v in head.items() if v}))
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(records, warc.RECORD)).collect()}
    assert len(got) == sum(r[1] == "revisit" for r in records)
    for r in records:
        if r[1] != "revisit":
            continue
        earlier = [b for b in records if b[1] == "response" and b[4] == 200 and b[2] == r[2] and b[3] < r[3]]
        base = max(earlier, key=lambda b: (b[3], b[0]), default=None)
        assert got[r[0]].base_id == (base and base[0])
        if base is None:
            assert got[r[0]].verdict == "no_base"
            continue
        strip = lambda x: x and x.removeprefix("W/")
        pairs = [(strip(r[6].get("ETag")), strip(base[6].get("ETag"))), (r[6].get("Last-Modified"), base[6].get("Last-Modified")), (r[5], base[5])]
        want = next(("resolved" if a == b else "mismatch" for a, b in pairs if a and b), "no_validator")
        assert got[r[0]].verdict == want
        if want == "resolved":
            merged = {k.lower(): v for k, v in base[6].items()} | {k.lower(): v for k, v in r[6].items() if k != "Content-Length"}
            assert got[r[0]].headers == merged


def test_edge_rows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [
        ("a", "revisit", None, t, 304, None, None), ("b", "revisit", "https://e.x", None, 304, None, None), ("c", "response", "https://e.x", t, 200, "p", {"ETAG": "1", "etag": "2"}),
        ("d", "revisit", "https://e.x/", t + dt.timedelta(1), 304, "p", None), ("d", "revisit", "https://e.x/", t + dt.timedelta(1), 304, "p", None), (None, None, None, None, None, None, None), ("e", "revisit", "https://e.x", t, 304, "p", None),
    ]
    df = spark.createDataFrame(rows, warc.RECORD).withColumn("block", F.lit(1)).withColumn("url", F.lit("x"))
    got = sorted((r.record_id, r.verdict, r.base_id) for r in warc.resolve_revisits(df).collect())
    assert [x[:2] for x in got] == [("a", "no_key"), ("b", "no_key"), ("d", "resolved"), ("d", "resolved"), ("e", "no_base")]
    assert warc.resolve_revisits(df.limit(0)).count() == 0
