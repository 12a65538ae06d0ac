"""JSONL ingest: decode rules, first-wins order, line numbers, incremental runs."""

import json
import os

from pyspark.sql import functions as F

from tallyspark.plans.ingest import UsageStore, compact, current_manifest, delete_records, ingest, read_quarantine, read_usage
from tallyspark.sources.logs import number_lines, scan_lines


def usage_line(mid, ts="2024-01-01T00:00:00Z", **usage):
    return json.dumps({"type": "assistant", "sessionId": "s", "cwd": "", "requestId": "", "timestamp": ts,
                       "message": {"id": mid, "model": "m-1", "usage": usage}})


def write(path, lines, end="\n"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write("\n".join(lines) + end)


def build_tree(root):
    write(f"{root}/-a-b/z.jsonl", [
        usage_line("dup", input_tokens=1),                                        # 1
        "",                                                                       # 2 blank, counted
        json.dumps({"type": "user", "message": {"id": "x", "usage": {}}}),        # 3 not usage
        json.dumps({"type": "assistant"}),                                        # 4 no message
        json.dumps({"type": "assistant", "message": {"id": "n", "usage": None}}), # 5 usage null
        usage_line("u0"),                                                         # 6 usage {} -> zeros
        usage_line(""),                                                           # 7 empty id
        "not json",                                                               # 8
        usage_line("t1", input_tokens="x"),                                       # 9 text for int
        usage_line("t2", input_tokens=1.5),                                       # 10 float for int
        usage_line("badts", ts="yesterday"),                                      # 11
        json.dumps({"type": "assistant", "message": {"id": "nots", "usage": {"output_tokens": 3}}}),  # 12
        usage_line("off", ts="2024-01-01T01:30:00.1234567+02:00", output_tokens=2),  # 13
        '{"type":"assistant","message":{"id":"late","usa',                        # 14 half-written
    ], end="")
    # Same id in a sibling folder that sorts first as a string but later by component.
    write(f"{root}/-a-b-c/a.jsonl", [usage_line("dup", input_tokens=2)])
    write(f"{root}/sp ace+/f.jsonl", [usage_line("sp1")])
    write(f"{root}/top.jsonl", [usage_line("top1")])


def rows_by_id(spark, store):
    return {r.message_id: r for r in read_usage(spark, store).collect()}


def test_ingest_rules_and_increments(spark, tmp_dir):
    root, store = f"{tmp_dir}/logs", UsageStore(f"{tmp_dir}/store")
    build_tree(root)
    r1 = ingest(spark, root, store)
    assert r1.files_read == 4
    got = rows_by_id(spark, store)
    assert set(got) == {"dup", "u0", "nots", "off", "sp1", "top1"}
    assert got["dup"].input_tokens == 1 and got["dup"].project_slug == "-a-b"  # component order, first wins
    assert got["u0"].source_line == 6 and got["u0"].input_tokens == 0
    assert got["u0"].cwd is None and got["u0"].request_id is None and got["u0"].session_id == "s"
    assert str(got["nots"].ts) == "0001-01-01 00:00:00"  # missing timestamp -> year 1
    assert str(got["off"].ts) == "2023-12-31 23:30:00.123456"  # UTC, microseconds
    assert str(got["off"].usage_date) == "2023-12-31"
    assert got["sp1"].project_slug == "sp ace+" and got["top1"].project_slug == "top.jsonl"
    reasons = {r.reason: r.n for r in spark.read.parquet(store.quarantine).groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert reasons == {"malformed_json": 4, "bad_timestamp": 1}

    # Completing the half-written line (and appending one more) is picked up.
    with open(f"{root}/-a-b/z.jsonl", "a") as fh:
        fh.write('ge":{"output_tokens":9}}}\n' + usage_line("new2") + "\n")
    r2 = ingest(spark, root, store)
    assert r2.files_read == 1
    got = rows_by_id(spark, store)
    assert got["late"].output_tokens == 9 and got["late"].source_line == 14 and "new2" in got

    # Shrinking / rewriting a file re-reads it; stored rows are kept, new ids added.
    write(f"{root}/-a-b-c/a.jsonl", [usage_line("shrunk")])
    r3 = ingest(spark, root, store)
    got = rows_by_id(spark, store)
    assert r3.files_read == 1 and "shrunk" in got and got["dup"].input_tokens == 1

    # Nothing changed: nothing read, nothing added.
    assert ingest(spark, root, store).files_read == 0
    assert read_usage(spark, store).count() == len(got)

    # Deletes are tombstones; compaction rewrites only touched days; re-reads do not resurrect.
    delete_records(spark, store, spark.createDataFrame([("sp1",)], "message_id string"))
    assert "sp1" not in rows_by_id(spark, store)
    assert compact(spark, store) == 1
    assert spark.read.parquet(store.usage).filter("message_id = 'sp1'").count() == 0
    os.utime(f"{root}/sp ace+/f.jsonl", (1, 1))
    assert ingest(spark, root, store).files_read == 1
    assert "sp1" not in rows_by_id(spark, store)


def test_line_numbers_across_blocks(spark, tmp_dir):
    path = f"{tmp_dir}/big/x.jsonl"
    write(path, [json.dumps({"n": i}) if i % 7 else "" for i in range(1, 3001)])
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = scan_lines(spark, f"{tmp_dir}/big")
        assert lines.rdd.getNumPartitions() > 5
        rows = number_lines(lines).select("value", "source_line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)
    assert len(rows) == 3000
    for r in rows:
        if r.value:
            assert json.loads(r.value)["n"] == r.source_line
    assert sorted(r.source_line for r in rows) == list(range(1, 3001))


def test_odd_file_names_do_not_stop_a_run(spark, tmp_dir):
    root, store = f"{tmp_dir}/logs", UsageStore(f"{tmp_dir}/store")
    names = ["a[1].jsonl", "{x}.jsonl", "50%.jsonl", "a%20b.jsonl", "p+q r.jsonl", "ü#?.jsonl"]
    for i, name in enumerate(names):
        write(f"{root}/-p [{i}]%2F/{name}", [usage_line(f"m{i}")])
    r = ingest(spark, root, store)
    assert (r.files_read, r.rows_added, r.files_incomplete) == (len(names), len(names), 0)
    got = rows_by_id(spark, store)
    assert {x.source_file.rsplit("/", 1)[1] for x in got.values()} == set(names)
    assert got["m2"].project_slug == "-p [2]%2F"
    assert ingest(spark, root, store).files_read == 0


def test_a_file_that_fails_is_tried_again(spark, tmp_dir):
    root, store = f"{tmp_dir}/logs", UsageStore(f"{tmp_dir}/store")
    bad = f"{root}/-p/bad.jsonl"
    write(bad, [usage_line(f"b{i}") for i in range(400)])
    write(f"{root}/-p/good.jsonl", [usage_line("g")])
    data = open(bad, "rb").read()
    # A checksum beside the file that does not fit it makes the read fail.
    with open(f"{root}/-p/.bad.jsonl.crc", "wb") as fh:
        fh.write(b"crc\x00\x00\x00\x02\x00" + b"\x01\x02\x03\x04" * (len(data) // 512 + 1))
    r1 = ingest(spark, root, store)
    assert r1.files_read == 1 and set(rows_by_id(spark, store)) == {"g"}
    os.remove(f"{root}/-p/.bad.jsonl.crc")
    r2 = ingest(spark, root, store)
    assert r2.files_read == 1 and r2.rows_added == 400
    assert ingest(spark, root, store).files_read == 0


def test_quarantine_has_one_row_a_bad_line(spark, tmp_dir):
    root, store = f"{tmp_dir}/logs", UsageStore(f"{tmp_dir}/store")
    path = f"{root}/-p/x.jsonl"
    write(path, [usage_line("a"), "not json", '{"type":"assist'], end="")
    ingest(spark, root, store)
    assert read_quarantine(spark, store).count() == 2
    with open(path, "a") as fh:
        fh.write('ant"}\n' + usage_line("b") + "\n")
    ingest(spark, root, store)
    rows = read_quarantine(spark, store).collect()
    assert [(r.source_line, r.line) for r in rows] == [(2, "not json")]
    m = current_manifest(spark, store).collect()
    assert len(m) == 1 and m[0].last_line == 4 and m[0].byte_offset == os.path.getsize(path)


def test_empty_files_do_no_harm(spark, tmp_dir):
    root, store = f"{tmp_dir}/logs", UsageStore(f"{tmp_dir}/store")
    write(f"{root}/-p/empty.jsonl", [], end="")
    write(f"{root}/-p/x.jsonl", [usage_line("a")])
    assert ingest(spark, root, store).files_read == 1
    assert ingest(spark, root, store).files_read == 0


def test_compaction_removes_emptied_days(spark, tmp_dir):
    root, store = f"{tmp_dir}/logs", UsageStore(f"{tmp_dir}/store")
    write(f"{root}/-p/x.jsonl", [usage_line("a", ts="2024-01-01T00:00:00Z"), usage_line("b", ts="2024-01-02T00:00:00Z"),
                                 usage_line("c", ts="2024-01-02T00:00:00Z")])
    ingest(spark, root, store)
    delete_records(spark, store, spark.createDataFrame([("a",), ("b",)], "message_id string"))
    assert compact(spark, store) == 2 and compact(spark, store) == 0
    assert [r.message_id for r in spark.read.parquet(store.usage).collect()] == ["c"]


def test_one_scan_and_few_files(spark, tmp_dir):
    root, store = f"{tmp_dir}/logs", UsageStore(f"{tmp_dir}/store")
    for i in range(30):
        write(f"{root}/-p/{i}.jsonl", [usage_line(f"{i}-{d}", ts=f"2024-01-{d:02d}T00:00:00Z") for d in range(1, 6)])
    ingest(spark, root, store)
    days = [d for d in os.listdir(store.usage) if d.startswith("usage_date=")]
    assert len(days) == 5
    assert all(len([f for f in os.listdir(f"{store.usage}/{d}") if f.endswith(".parquet")]) <= 2 for d in days)
