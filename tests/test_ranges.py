"""Reading logs from saved offsets: blocks, ranges, growth, truncation, the tail stream."""

import datetime as dt
import io
import json
import os
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyspark.plans import ingest as I
from tallyspark.sources import ranges as R
from tallyspark.sources.fixtures import copy_logs
from tallyspark.sources.logs import block_totals, file_totals, scan_lines
from tallyspark.sources.tables import short_splits
from tallyspark.streaming import live as L


def line(i, pad=0):
    return json.dumps({"type": "assistant", "sessionId": "s" * pad, "timestamp": "2024-01-01T00:00:00Z",
                       "message": {"id": f"m{i}", "model": "m-1", "usage": {"output_tokens": i}}})


def put(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as fh:
        fh.write(text)


class Counting(io.BytesIO):
    """A file that counts the bytes read from it."""

    def __init__(self, data):
        super().__init__(data)
        self.n = 0

    def read(self, size=-1):
        data = super().read(size)
        self.n += len(data)
        return data


def test_blocks_hold_each_line_once():
    r = random.Random(7)
    for _ in range(300):
        lines = ["x" * r.choice([0, 0, 1, 3, 9, 40]) for _ in range(r.randint(0, 12))]
        text = "\n".join(lines) + ("\n" if lines and r.random() < 0.6 else "")
        data = b"skip\n" + text.encode()
        start, to, block = 5, len(data), r.randint(1, 30)
        got = [x for lo in range(start, to, block) for x in R.block_lines(io.BytesIO(data), start, lo, min(lo + block, to), to)]
        want = text.encode().split(b"\n")
        assert got == (want[:-1] if not want[-1] else want)
        assert R.last_line_end(io.BytesIO(data), to) == 5 + text.rfind("\n") + 1


def test_a_gigabyte_that_grows_by_a_kilobyte_costs_a_kilobyte(monkeypatch):
    class Sparse(Counting):
        """As if a gigabyte of lines stood before the data."""

        def seek(self, at, *a):
            return super().seek(at - (1 << 30))

    new = "".join(line(i) + "\n" for i in range(8)).encode()
    f = Sparse(new)
    start, to = 1 << 30, (1 << 30) + len(new)
    assert len(R.block_lines(f, start, start, to, to)) == 8
    assert f.n <= len(new) + 2 * R.STEP


def test_growth_is_read_from_the_offset(spark, tmp_dir):
    root, store = f"{tmp_dir}/logs", I.UsageStore(f"{tmp_dir}/store")
    path = f"{root}/-p/a.jsonl"
    put(path, "".join(line(i, 50) + "\n" for i in range(2000)) + "not json\n" + line(2000)[:30])
    first = I.ingest(spark, root, store)
    size = os.path.getsize(path)
    assert first.bytes_read == size and I.read_quarantine(spark, store).count() == 2
    put(path, line(2000)[30:] + "\n\n" + line(2001) + "\nalso not json\n", "a")
    put(f"{root}/-q/new.jsonl", line(5000) + "\n")
    second = I.ingest(spark, root, store)
    assert second.files_read == 2 and second.bytes_read < os.path.getsize(path) - size + 500
    rows = {r.message_id: r.source_line for r in I.read_usage(spark, store).collect()}
    assert len(rows) == 2003 and rows["m1999"] == 2000 and rows["m2000"] == 2002 and rows["m2001"] == 2004 and rows["m5000"] == 1
    bad = sorted((r.source_line, r.line) for r in I.read_quarantine(spark, store).collect())
    assert bad == [(2001, "not json"), (2005, "also not json")]
    m = {r.source_file.rsplit("/", 1)[1]: r for r in I.current_manifest(spark, store).collect()}
    assert m["a.jsonl"].last_line == 2005 and m["a.jsonl"].byte_offset == os.path.getsize(path) == m["a.jsonl"].resume_offset
    # The same rows as from a full read.
    whole = I.UsageStore(f"{tmp_dir}/whole")
    I.ingest(spark, root, whole)
    assert {r.message_id: r.source_line for r in I.read_usage(spark, whole).collect()} == rows


def test_a_replaced_file_is_read_whole(spark, tmp_dir):
    root, store = f"{tmp_dir}/logs", I.UsageStore(f"{tmp_dir}/store")
    path = f"{root}/-p/a.jsonl"
    put(path, "bad\n" + line(1) + "\n")
    I.ingest(spark, root, store)
    put(path, line(7) + "\n" + line(8) + "\n" + line(9) + "\nworse\n")  # longer, but another file
    r = I.ingest(spark, root, store)
    assert r.bytes_read == os.path.getsize(path)
    rows = {x.message_id: x.source_line for x in I.read_usage(spark, store).collect()}
    assert rows == {"m1": 2, "m7": 1, "m8": 2, "m9": 3}
    assert [(x.source_line, x.line) for x in I.read_quarantine(spark, store).collect()] == [(4, "worse")]
    put(path, line(7) + "\n")  # truncated
    assert I.ingest(spark, root, store).files_read == 1
    put(path, line(10) + "\n", "a")
    assert I.ingest(spark, root, store).bytes_read == len(line(10)) + 1
    assert I.read_quarantine(spark, store).count() == 0


def tail(spark, root, store):
    L.tail_ingest(spark, root, store, L.checkpoint_path(store, "tail")).awaitTermination()
    return {r.message_id: r.source_line for r in I.read_usage(spark, store).collect()}


def test_tail_delivers_appended_lines_and_replays_a_failed_batch(spark, tmp_dir, monkeypatch):
    root, store = f"{tmp_dir}/logs", I.UsageStore(f"{tmp_dir}/store")
    path = f"{root}/-p/a.jsonl"
    put(path, line(1) + "\n\n" + line(2) + "\n" + line(3)[:20])
    assert tail(spark, root, store) == {"m1": 1, "m2": 3}  # the line being written is not delivered
    put(path, line(3)[20:] + "\n" + line(4) + "\n", "a")
    # The batch fails once its facts are stored, before its manifest rows.
    real = L.load_lines

    def dies(spark, lines, root, store, now, known=None):
        real(spark, lines, root, store, now, known)
        raise RuntimeError("lost driver")

    monkeypatch.setattr(L, "load_lines", dies)
    with pytest.raises(Exception, match="lost driver"):
        tail(spark, root, store)
    monkeypatch.setattr(L, "load_lines", real)
    assert tail(spark, root, store) == {"m1": 1, "m2": 3, "m3": 4, "m4": 5}
    put(path, line(9) + "\n")  # truncated: read from its start
    put(f"{root}/-q/b.jsonl", line(5) + "\n")
    assert tail(spark, root, store) == {"m1": 1, "m2": 3, "m3": 4, "m4": 5, "m9": 1, "m5": 1}
    totals = I.live_totals(spark, store).agg(F.sum("messages"), F.sum("output_tokens")).first()
    assert tuple(totals) == (6, 1 + 2 + 3 + 4 + 5 + 9)
    # The batch job goes on where the stream stopped.
    put(path, line(11) + "\n", "a")
    assert I.ingest(spark, root, store).rows_added == 1
    assert {r.message_id: r.source_line for r in I.read_usage(spark, store).collect()}["m11"] == 2


def test_ranges_of_small_files_are_dealt_to_several_tasks(spark, tmp_dir):
    names = [f"{tmp_dir}/{i}.jsonl" for i in range(6)]
    for i, name in enumerate(names):
        with open(name, "w") as fh:
            fh.write(f"old\nnew {i}\n")
    rows = [(name, 4, 1, os.path.getsize(name), dt.datetime(2024, 1, 1)) for name in names]
    found = spark.createDataFrame(rows, "source_file string, resume_offset bigint, resume_line bigint, length bigint, modified_at timestamp")
    got = R.read_ranges(found).select("value", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.value for r in got) == [f"new {i}" for i in range(6)]
    assert len({r.task for r in got}) > 1
    assert R.read_ranges(found.where("length < 0")).count() == 0


def test_block_totals_do_not_sort_the_lines(spark, tmp_dir, capsys):
    with open(f"{tmp_dir}/a.jsonl", "w") as fh:
        fh.write("one\n\nthree")
    lines = scan_lines(spark, tmp_dir).withColumn("line_crc", F.crc32("value"))
    blocks = block_totals(lines)
    blocks.explain()
    assert "SortAggregate" not in capsys.readouterr().out
    r = file_totals(blocks).first()
    assert (r.last_line, r.byte_offset, r.resume_offset, r.resume_line, r.open_tail, r.whole) == (3, 10, 5, 2, True, True)
    assert (r.head_bytes, r.head_crc) == (3, zlib.crc32(b"one"))


def test_short_splits_leave_a_set_size_alone(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key, None)
    spark.conf.unset(key)
    try:
        with short_splits(spark):
            assert spark.conf.get(key) == "32m"
            with short_splits(spark, "1m"):
                assert spark.conf.get(key) == "32m"
        assert spark.conf.get(key, None) is None
    finally:
        if before is not None:
            spark.conf.set(key, before)


def test_logs_are_copied_by_several_tasks(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr("tallyspark.sources.ranges.BLOCK", 7)
    os.makedirs(f"{tmp_dir}/whole/p=~replay")
    texts = {f"{i}.txt": f"{i}" * 40 for i in range(6)} | {"p=~replay/r.txt": "again"}
    for name, text in texts.items():
        with open(f"{tmp_dir}/whole/{name}", "w") as fh:
            fh.write(text)
    sc = spark.sparkContext
    for share in (0.5, 1.0):
        sc.setJobGroup(f"copy-{tmp_dir}-{share}", "")
        copy_logs(spark, f"{tmp_dir}/whole", f"{tmp_dir}/grown", share)
        job = max(sc.statusTracker().getJobIdsForGroup(f"copy-{tmp_dir}-{share}"))
        last = max(sc.statusTracker().getJobInfo(job).stageIds)
        assert sc.statusTracker().getStageInfo(last).numTasks > 1
        for name, text in texts.items():
            if share < 1 and "~replay" in name:
                assert not os.path.exists(f"{tmp_dir}/grown/{name}")
            else:
                assert open(f"{tmp_dir}/grown/{name}").read() == text[: int(len(text) * share)]
    sc.setLocalProperty("spark.jobGroup.id", None)
