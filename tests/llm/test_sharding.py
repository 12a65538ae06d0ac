import random

import pytest

from tallyspark.llm import sharding as K

from .corpus import corpus, crc, frame, row, sentence


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shards_are_even_and_slots_gapless(spark, shards):
    r = random.Random(2)
    rows = corpus(4, 40) + [row(50_000 + i, sentence(r, r.randint(3, 40))) for i in range(3000)]
    rows += [row(60_000 + i, "the same text again and again " * 4) for i in range(2000)]  # a hot group
    got = K.shard_by_bytes(frame(spark, rows), shards).collect()
    assert len(got) == len(rows)
    want = sorted(((x[0], len((x[1] or "").encode()) + 16, crc(x[1] or "")) for x in rows), key=str)
    assert sorted(((g.doc_id, g["size"], g.text_crc32) for g in got), key=str) == want
    size, slots = {}, {}
    for g in got:
        size[g.shard] = size.get(g.shard, 0) + g["size"]
        slots.setdefault(g.shard, []).append(g.slot)
    assert set(size) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, largest = sum(size.values()) / shards, max(g["size"] for g in got)
    assert max(size.values()) <= 1.1 * mean + 2 * largest


def test_small_groups_of_equal_texts_stay_together(spark):
    r = random.Random(9)
    texts = [sentence(r, r.randint(5, 60)) for _ in range(1200)]
    rows = [row(i * 10 + j, t) for i, t in enumerate(texts) for j in range(1 + (i % 3))]
    got = K.shard_by_bytes(frame(spark, rows), 8).collect()
    by_text = {}
    for g in got:
        by_text.setdefault((g.text_crc32, g["size"]), set()).add(g.shard)
    assert all(len(s) == 1 for s in by_text.values())


def test_tree_splits_the_widest_dimension_first(spark):
    rows = [(i, i, 0, 1, float(i), 0.0, 0.0, 5.0) for i in range(1000)]
    points = spark.createDataFrame(rows, "g1 long, g2 long, sub long, weight long, d_bytes double, d_lang double, d_source double, d_doc double")
    tree = K.build_tree(K.coordinates(points), 4)
    assert tree.dim == 0 and [k.leaves for k in tree.kids] == [2, 2]
    assert abs((tree.cut >> 32) / ((1 << 30) - 1) - 0.5) < 0.01


def test_tables_smaller_than_the_shards(spark):
    assert K.shard_by_bytes(frame(spark, []), 40).count() == 0
    got = K.shard_by_bytes(frame(spark, [row(1, "a"), row(1, "a"), row(None, None)]), 40).collect()
    assert len(got) == 3 and len({(g.shard, g.slot) for g in got}) == 3
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")  # no metadata columns
    assert K.shard_by_bytes(df, 3).count() == 1


def test_repeated_rows_are_dealt_evenly(spark):
    r = random.Random(12)
    rows = [row(i, sentence(r, 20)) for i in range(2000)] + [row(7, "the same row " * 6)] * 2000
    rows += [row(None, "no id, the same text " * 4)] * 1000
    got = K.shard_by_bytes(frame(spark, rows), 40).collect()
    size, slots = {}, {}
    for g in got:
        size[g.shard] = size.get(g.shard, 0) + g["size"]
        slots.setdefault(g.shard, []).append(g.slot)
    mean, largest = sum(size.values()) / 40, max(g["size"] for g in got)
    assert len(got) == len(rows) and len(size) == 40
    assert max(size.values()) <= 1.1 * mean + 2 * largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
