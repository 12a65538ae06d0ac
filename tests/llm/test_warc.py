import gzip
import hashlib

from pyspark.sql import functions as F

from tallyspark.llm import warc as W

PAGES = "page_id long, url string, html string, key string, KEPT int"


def pages():
    big, tricky = "<p>" + "x" * 200, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9
    rows = [(i, f"http://h{i % 3}.Example.com/P/{i}?q=é", f"<html>{i}</html>" * 20) for i in range(400)]
    rows += [(1000 + i, f"https://user@www.same.org:8080/{i}", big) for i in range(300)]
    rows += [(2000, None, None), (2001, "", ""), (2002, "not a url\r\nX: y", "short"), (2003, "http://a.b/", "short")]
    rows += [(2004, "http://t.x/1", tricky), (2005, "http://t.x/1", tricky), (None, "http://n.o/", big), (None, None, None)]
    rows += [(2006, "http://l.o/ng", "z" * 3_000_000), (5, "http://h2.example.com/P/5?q=é", "other"), rows[7], rows[7]]
    return [(*r, "clash", 1) for r in rows]


def expected(rows):
    first = {}
    for i, _, html, *_ in rows:
        if html and len(html.encode()) >= 100 and i is not None:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        kept = first.get(html)
        refers = kept if kept is not None and kept != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def test_archives_round_trip_through_the_index(spark):
    rows = pages()
    df = spark.createDataFrame(rows, PAGES).repartition(4)
    manifest = W.write_archives(df)
    keys = df.select(W.entry_key(F.col("url"), F.col("page_id")).alias("key"))
    got = W.read_captures(manifest, keys).cache()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()], key=str) == expected(rows)
    kept = {r.page_id: r for r in got.collect()}
    for r in got.where("record_type = 'revisit'").collect():
        assert kept[r.refers_to].payload_digest == r.payload_digest and kept[r.refers_to].record_type == "response"
    payload = next(r.payload for r in got.collect() if r.page_id == 2004)
    assert payload.decode() == next(x[2] for x in rows if x[0] == 2004)


def test_files_are_sorted_blocks_and_gzip_members(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK_LINES", 16)
    manifest = W.write_archives(spark.createDataFrame(pages(), PAGES).repartition(3))
    shards = sorted(tuple(r) for r in manifest.collect())
    for (_, last, *_), (first, *_) in zip(shards, shards[1:], strict=False):
        assert last.encode() <= first.encode()
    for shard in shards:
        reader = W.Reader([shard])
        reader._load_shard(0)
        assert reader.block_firsts == sorted(reader.block_firsts)
        files, path = W._open(shard[2])
        data = gzip.decompress(files.open_input_file(f"{path}.warc.gz").read())
        assert data.startswith(b"WARC/1.1\r\n") and len(reader.places) == -(-shard[5] // 16)


def test_lookup_of_absent_and_repeated_keys(spark):
    df = spark.createDataFrame([(1, "http://a.b/x", "p", "", 0)] * 600 + [(2, "http://a.b/y", "q", "", 0)], PAGES)
    manifest = W.write_archives(df)
    reader = W.Reader([tuple(r) for r in manifest.collect()])
    assert len(list(reader.find("b,a)/x 1"))) == 600 and len(list(reader.find("b,a)/y 2"))) == 1
    for key in ("", "b,a)/x", "b,a)/x 2", "zzz"):
        assert list(reader.find(key)) == []


def test_url_keys(spark):
    urls = ["http://www.Example.COM/A/b?C=d#frag", "https://u:p@x.org:81", "mailto:x y", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(W.url_key(F.col("u"))).collect()]
    assert got == ["com,example,www)/a/b?c=d", "org,x:81)/", "mailto:x%20y", "-"]


def test_empty_table(spark):
    df = spark.createDataFrame([], PAGES)
    manifest = W.write_archives(df)
    assert manifest.count() == 0
    assert W.read_captures(manifest, spark.createDataFrame([("x",)], "key string")).count() == 0


def test_reading_is_spread_by_the_stored_records(spark, monkeypatch):
    monkeypatch.setattr(W, "READ_RECORDS", 50)
    df = spark.createDataFrame(pages(), PAGES).repartition(3)
    manifest = W.write_archives(df)
    keys = df.select(W.entry_key(F.col("url"), F.col("page_id")).alias("key"))
    tasks = W.read_captures(manifest, keys).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 5 and sum(r["count"] for r in tasks) == len(pages())
