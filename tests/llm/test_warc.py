import hashlib
import random
import zlib

from pyspark.sql import functions as F

from sigloom.llm import warc as W


def brute(rows):
    last = {}
    for i, html in rows:
        if i is not None and len((html or "").encode()) >= 1000:
            last[html] = max(i, last.get(html, i))
    out = []
    for i, html in rows:
        body = (html or "").encode()
        again = i is not None and html in last and i < last[html]
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last[html] if again else None))
    return sorted(out, key=repr)


def pages_of(spark, sf):
    page = "<p>" + "é" * 600 + "\r\n\r\nWARC/1.0\r\n\r\n</p>"
    rows = [
        (1001, "http://a.example.com/x", page), (1002, "http://a.example.com/x", page), (1003, None, page), (None, "http://b/", page),
        (1002, "http://a.example.com/x", page), (1004, "http://c\r\nWARC-Type: x", "short"), (1005, "no scheme", "short"),
        (1006, "http://d/", None), (1007, "http://d/", ""), (1008, "", "z" * 1000), (1009, "http://d/", "z" * 1000),
    ]
    own = spark.createDataFrame(rows, "page_id long, url string, html string")
    return own.union(spark.read.parquet(f"{sf}/pages.parquet").select(own.columns)).withColumn("value", F.lit("v"))


def test_round_trip_and_order(spark, sf):
    pages = pages_of(spark, sf)
    index = W.archive_and_index(pages).collect()
    want = brute([(r.page_id, r.html) for r in pages.collect()])
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in index]
    assert sorted(got, key=repr) == want
    index.sort(key=lambda r: (r.part, r.position))
    keys = [(r.url_key, r.captured, r.page_id or 0) for r in index]
    assert keys == sorted(keys)


def test_many_archives_and_their_bytes(spark, sf, tmp_path):
    pages = pages_of(spark, sf)
    W.write_archives(pages, str(tmp_path / "w"), archive_bytes=60_000)
    files = sorted((tmp_path / "w").glob("*.gz"))
    assert len(files) > 3
    for r in W.capture_histories(str(tmp_path / "w"), spark).collect():
        data = W.inflate((tmp_path / "w" / r.archive).read_bytes())
        record = data[r.record_offset : r.record_offset + r.record_bytes]
        assert record.startswith(b"WARC/1.0\r\n") and record.endswith(b"\r\n\r\n")
        if r.record_type == "response":
            assert hashlib.sha1(record[:-4].split(b"\r\n\r\n", 2)[2]).hexdigest() == r.payload_digest


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(W.LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)


def test_members_and_keys():
    pack = lambda b: (lambda c: c.compress(b) + c.flush())(zlib.compressobj(wbits=31))
    assert W.inflate(pack(b"one") + pack(b"two")) == b"onetwo"
    assert W.url_key("http://Www.Example.com/a/B?c") == "com,example,www)/a/B?c"
    assert W.url_key(None) == ""


def test_no_rows(spark):
    assert W.archive_and_index(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
