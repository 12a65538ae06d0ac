"""Small corpora for the operator tests, and brute-force versions of what operators compute."""

from __future__ import annotations

import itertools
import random
import re
import zlib

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Extra columns with names that operators use themselves.
        T.StructField("score", T.StringType()),
        T.StructField("Component_Id", T.IntegerType()),
        T.StructField("line", T.StringType()),
        T.StructField("length", T.IntegerType()),
    ]
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), "x", 7, "y", 9)


def sentence(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)).capitalize() + "."


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Distinct texts, exact and near copies in crowds, nulls, empties, blanks, ties, repeated rows, a very long text."""
    r = random.Random(seed)
    texts = ["\n".join(sentence(r, r.randint(6, 30)) for _ in range(r.randint(1, 6))) for _ in range(n)]
    for base in texts[:4]:
        for _ in range(8):
            w = base.split(" ")
            for _ in range(r.randint(0, max(1, len(w) // 8))):
                w[r.randrange(len(w))] = sentence(r, 1).strip(".").lower()
            texts.append(" ".join(w))
    texts += texts[:5] + [texts[0].upper()] * 3
    texts += ["", "", " \n\t ", "word", "Word", "two words", "a b c d e", "A  b\tc\nd e", "é è ê ë ñ"]
    texts.append("\n".join(sentence(r, 40) for _ in range(600)))
    rows = [row(i * 3 + 1, t, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", None])) for i, t in enumerate(texts)]
    rows += [row(10_001, None), row(10_002, None), row(None, texts[0]), row(None, None)]
    rows += [rows[0], rows[5], rows[5]]  # repeated rows
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def shingles(text: str | None, k: int) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_components(rows, k: int) -> dict[int, int]:
    """Least doc_id reachable over links of 0.8, by all pairs; rows of one doc_id are one document."""
    sets: dict[int, set] = {}
    for x in rows:
        if x[0] is not None:
            sets.setdefault(x[0], set()).add(shingles(x[1], k))
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def crc(text: str) -> int:
    return zlib.crc32(text.encode())
