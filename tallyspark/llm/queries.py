"""The operators' registered queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import (
    conversation_repair,
    decontaminate,
    hard_negatives,
    line_dedup,
    near_dedup,
    packing,
    quality,
    repeats,
    sharding,
    token_counts,
    topk,
    toxicity,
    warc,
)
from tallyspark.llm.common import shared_path, table, tune, written
from tallyspark.llm.labels import is_held_out

#: Where the byte-level BPE file is; the same path on every executor.
BPE_PATH = public_tokenizers.path("byte_bpe_50k.json")


def op1_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, then read every capture back through the two-level index."""
    tune(spark)
    pages = table(spark, sf_dir, "pages")
    manifest = warc.write_archives(pages)
    keys = pages.select(warc.entry_key(F.col("url"), F.col("page_id").cast("long")).alias("key"))
    return warc.read_captures(manifest, keys).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )


def _scored(docs: DataFrame, modulus: int, held_out: int) -> DataFrame:
    return docs.select(
        "doc_id",
        is_held_out(modulus, held_out).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op2_toxicity_bigru(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), modulus=5, held_out=0)
    return _scored(quality.with_scores(docs.select("doc_id", "text"), model, toxicity.score_column), 5, 0)


def op3_packing_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), BPE_PATH)
    return pieces.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on 2-word shingles at Jaccard 0.8."""
    tune(spark)
    groups = near_dedup.near_duplicate_groups(table(spark, sf_dir, "documents"), k=2)
    return groups.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that repeat or resemble (Jaccard 0.8) an earlier line of any document."""
    return line_dedup.removed_lines(table(spark, sf_dir, "documents"))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of all documents after inserts, deletes, revised counts and replayed batches."""
    docs = written(token_counts.counted(table(spark, sf_dir, "documents"), BPE_PATH), "token-counts")
    rollup = token_counts.Rollup(spark, shared_path(spark, "token-rollup"))
    # Every document arrives, counted in white-space words and in BPE tokens.
    load = token_counts.inserts(docs, "words", "words-1").union(token_counts.inserts(docs, "bpe", "byte-bpe-50k"))
    rollup.apply("load", load)
    # Later copies of a text leave again.
    first = docs.where("text_name is not null").groupBy("text_name").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    first = written(first.where("n > 1").select("text_name", "first"), "token-first")
    marked = docs.join(first, "text_name", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    marked = written(marked, "token-marked")
    copies = marked.where("copy")
    rollup.apply("copies", token_counts.deletes(copies, "words", "words-1").union(token_counts.deletes(copies, "bpe", "byte-bpe-50k")))
    # The word rule changes: what is left is counted anew.  Batches that come twice change nothing.
    rollup.apply("words-2", token_counts.revisions(marked.where("not copy"), "words", "words-1", "runs", "words-2"))
    rollup.apply("load", load)
    rollup.compact()
    rollup.apply("copies", token_counts.deletes(copies, "words", "words-1"))
    return rollup.totals()


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items held by documents: at least 0.8 of an item's 5-word shingles."""
    found = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.round(F.col("shared_shingles") / F.col("item_shingles"), 6))


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), modulus=3, held_out=1)
    return _scored(quality.with_scores(docs.select("doc_id", "text"), model), 3, 1)


def op10_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows by integer inner product, for every vec_id divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    hits = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """Every conversation damaged, then repaired; one of which no row is left has nothing to report."""
    tune(conversations.sparkSession)
    found = conversation_repair.repaired(conversation_repair.damaged(conversations)).withColumnRenamed("conv_id", "conv")
    every = conversations.select("conv_id").distinct()
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return every.join(found, every.conv_id.eqNullSafe(found.conv), "left").select(
        "conv_id", *[F.coalesce(F.col(c), none.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns if c != "conv"]
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair."""
    return repaired_conversations(table(spark, sf_dir, "conversations"))


def op12_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vec_id divisible by 100; a seventh of the labels is moved on first."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_deep_shallow_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents under 100-byte strings that start earlier."""
    return repeats.removed(table(spark, sf_dir, "documents")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_capture_index": op1_warc_capture_index,
    "op2_toxicity_bigru": op2_toxicity_bigru,
    "op3_packing_dp": op3_packing_dp,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_rollup": op6_token_rollup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_kd_sharding": op8_kd_sharding,
    "op9_quality_mil": op9_quality_mil,
    "op10_impact_topk": op10_impact_topk,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_cover_tree_negatives": op12_cover_tree_negatives,
    "op13_deep_shallow_repeats": op13_deep_shallow_repeats,
}

#: DuckDB twins.  Words are split at ASCII white space and lower-cased A-Z only, as in the operators.
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _shingles(source: str, key: str, k: int) -> str:
    """Distinct shingles (key, s) of a table; a text of fewer words is one shingle."""
    return f"""
    SELECT DISTINCT {key}, unnest(CASE
        WHEN len(w) >= {k} THEN list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i+{k - 1}], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM (SELECT {key}, {_WORDS} AS w FROM {source} WHERE text IS NOT NULL)"""


_LINE_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(line), '[ \t\x0B\f\r]+'), lambda w: w <> ''))"

ORACLE: dict[str, str] = {
    # Equal lines once; pairs that share a word and whose sizes allow the threshold; exact Jaccard.
    "op5_line_dedup": f"""
WITH l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, x[i] AS line
           FROM (SELECT doc_id, string_split(text, chr(10)) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
                 FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
           WHERE regexp_matches(x[i], '[^ \t\x0B\f\r]')),
     r AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS nth FROM l),
     c AS (SELECT doc_id, line_no, row_number() OVER (ORDER BY doc_id, line_no) AS id, {_LINE_WORDS} AS w FROM r WHERE nth = 1),
     n AS (SELECT id, len(w) AS n FROM c),
     t AS (SELECT id, n, unnest(w) AS w FROM c JOIN n USING (id)),
     p AS (SELECT x.id AS x, y.id AS y, any_value(x.n) AS xn, any_value(y.n) AS yn, count(*) AS k
           FROM t x JOIN t y ON x.w = y.w AND y.id < x.id AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n) GROUP BY 1, 2),
     s AS (SELECT DISTINCT x AS id FROM p WHERE 5 * k >= 4 * (xn + yn - k))
SELECT doc_id, line_no, 'copy' AS reason FROM r WHERE nth > 1
UNION ALL SELECT doc_id, line_no, 'similar' AS reason FROM c JOIN s USING (id)
""",
    # All pairs that share a shingle, exact Jaccard, then everything reachable over the links.
    "op4_minhash_near_dedup": f"""
WITH RECURSIVE s AS ({_shingles("documents", "doc_id", 2)}),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
     l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
     e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) c USING (doc_id)
""",
    "op7_benchmark_decontamination": f"""
WITH d AS ({_shingles("documents", "doc_id", 5)}),
     q AS ({_shingles("benchmark", "item_id", 5)}),
     n AS (SELECT item_id, count(*) AS item_shingles FROM q GROUP BY item_id),
     x AS (SELECT d.doc_id, q.item_id, count(*) AS shared_shingles FROM d JOIN q USING (s) GROUP BY ALL)
SELECT doc_id, item_id, item_shingles, shared_shingles,
       round(shared_shingles / item_shingles, 6) AS containment
FROM x JOIN n USING (item_id) WHERE shared_shingles >= 0.8 * item_shingles - 1e-9
""",
    "op10_impact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
                  CAST(list_sum(list_transform(list_zip(q.v, v.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op12_cover_tree_negatives": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same,
                  CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.r <> b.r),
     p AS (SELECT a, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS nth
           FROM s WHERE same),
     n AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
                  CAST(row_number() OVER (PARTITION BY a, nth ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
           FROM p JOIN s USING (a) WHERE nth <= 5 AND NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""",
    "op1_warc_capture_index": """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
     k AS (SELECT d, min(page_id) AS kept FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to,
       regexp_replace(coalesce(url, '-'), '[\\x00-\\x20\\x7F]', '%20', 'g') AS url
FROM p LEFT JOIN k ON p.d = k.d
""",
}
