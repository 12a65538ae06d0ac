import random

from tallyspark.llm import decontaminate as D

from .corpus import corpus, frame, row, sentence, shingles

ITEMS = "item_id long, text string"


def planted(seed: int = 5):
    r = random.Random(seed)
    items = [(i, sentence(r, n)) for i, n in enumerate([5, 6, 9, 17, 33, 64, 120, 300])]
    items += [(20, items[3][1]), (21, "one two"), (22, ""), (23, None), (None, sentence(r, 12)), (24, sentence(r, 15)), (24, sentence(r, 15))]
    rows = corpus(seed, 30)
    for i, (_, text) in enumerate(items):
        if text:
            w = text.split(" ")
            if len(w) > 30:
                w[len(w) // 2] = "changed"
            rows.append(row(20_000 + i, sentence(r, 900) + " " + " ".join(w) + " " + sentence(r, 700)))
            # The item's halves far apart: still contained in the whole text.
            half = len(w) // 2
            rows.append(row(21_000 + i, " ".join(w[: half + 4]) + " " + sentence(r, 2000) + " " + " ".join(w[half:])))
    rows.append(row(22_000, "One Two"))
    return rows, items


def brute(rows, items):
    out = []
    for x in rows:
        s = shingles(x[1], 5)
        for item_id, text in items:
            q = shingles(text, 5)
            if q and len(q & s) >= 0.8 * len(q) - 1e-9:
                out.append((x[0], item_id, len(q), len(q & s)))
    return sorted(out, key=str)


def test_contained_items_equal_brute_force(spark, monkeypatch):
    rows, items = planted()
    want = brute(rows, items)
    assert len(want) > 15
    table = spark.createDataFrame(items, ITEMS)
    got = [tuple(r) for r in D.contained_items(frame(spark, rows), table).collect()]
    assert sorted(got, key=str) == want
    monkeypatch.setattr(D, "BLOCK_ITEMS", 4)  # items in several passes
    got = [tuple(r) for r in D.contained_items(frame(spark, rows), table).collect()]
    assert sorted(got, key=str) == want


def test_decontaminate_drops_rows_one_by_one(spark):
    rows, items = planted()
    out = D.decontaminate(frame(spark, rows), spark.createDataFrame(items, ITEMS))
    dirty = [x for x in rows if brute([x], items)]
    assert out.columns == frame(spark, []).columns
    assert out.count() == len(rows) - len(dirty)


def test_empty_tables(spark):
    rows, items = planted()
    none, table = spark.createDataFrame([], ITEMS), spark.createDataFrame(items, ITEMS)
    assert D.contained_items(frame(spark, rows), none).count() == 0
    assert D.decontaminate(frame(spark, rows), none).count() == len(rows)
    assert D.contained_items(frame(spark, []), table).count() == 0
