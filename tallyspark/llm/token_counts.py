"""Token totals kept up to date by signed deltas.

A change is one signed row: (doc_id, source, lang, tokenizer_version, documents,
tokens) with +1 / +tokens for an insert, -1 / -tokens for a delete, and both rows
for a revised count (minus the old, plus the new; source, language and
tokenizer version may change with it).  A batch of changes is pre-aggregated to
one delta row a key and committed under its batch id; totals are the sums of
all committed deltas, so a batch costs what it changes, not what is stored.

Commit: an attempt writes its delta rows, then its commit row, both under a name
of its own.  A commit counts once its write has finished (_SUCCESS), and readers
take one attempt of each batch, the least name of the finished ones.  So a
batch applied twice, again after a driver lost at any point, or by two drivers at once
counts once (a batch id stands for the same changes each time), and attempts that
did not finish count never and stop nobody.  ``compact`` folds all committed deltas
into one and names the batches it holds, under the same protocol; one
compaction runs at a time.

Null source, language and tokenizer version are keys of their own; changes with
null counts count as 0; keys whose documents and tokens are both 0 are not reported.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import tokens
from tallyspark.llm.common import in_task, text_bytes, text_chunks, tune
from tallyspark.llm.shingles import run_spans, word_spans
from tallyspark.sources.tables import delete_path, finished_paths

KEYS = ("source", "lang", "tokenizer_version")
_DELTAS = "source string, lang string, tokenizer_version string, documents long, tokens long, batch_id string, attempt string"
#: A batch's own row, or (``folded``) a batch that the compaction of that attempt holds.
_COMMITS = "batch_id string, attempt string, folded boolean"


def _signed(rows: DataFrame, count: str, version: str, sign: int) -> DataFrame:
    return rows.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(version).cast("string").alias("tokenizer_version"),
        F.lit(sign).cast("long").alias("documents"),
        (F.coalesce(F.col(count).cast("long"), F.lit(0)) * sign).alias("tokens"),
    )


def inserts(rows: DataFrame, count: str, version: str) -> DataFrame:
    """Changes that add documents ``rows(source, lang, <count>)``."""
    return _signed(rows, count, version, 1)


def deletes(rows: DataFrame, count: str, version: str) -> DataFrame:
    """Changes that take documents away."""
    return _signed(rows, count, version, -1)


def revisions(rows: DataFrame, old: str, old_version: str, new: str, new_version: str) -> DataFrame:
    """Changes that replace documents' counts."""
    return _signed(rows, old, old_version, -1).union(_signed(rows, new, new_version, 1))


class Rollup:
    """Additive totals by source, language and tokenizer version in a folder of the shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _commits(self) -> DataFrame:
        """(batch_id, attempt, folded) of commits whose write finished: one attempt a batch, and what those attempts fold."""
        finished = finished_paths(self.spark, f"{self.path}/commits")
        if not finished:
            return self.spark.createDataFrame([], _COMMITS)
        rows = self.spark.read.schema(_COMMITS).parquet(*finished)
        own = rows.where("not folded").groupBy("batch_id").agg(F.min("attempt").alias("attempt"))
        held = rows.where("folded").join(own.select("attempt"), "attempt", "left_semi").select("batch_id").distinct()
        return own.withColumn("folded", F.lit(False)).unionByName(
            held.select("batch_id", F.lit(None).cast("string").alias("attempt"), F.lit(True).alias("folded"))
        )

    def committed(self, batch_id: str) -> bool:
        """Whether the batch counts already, by its own commit or inside a compaction."""
        return not self._commits().where(F.col("batch_id") == batch_id).isEmpty()

    def _commit(self, batch_id: str, deltas: DataFrame, folded: DataFrame | None = None) -> bool:
        attempt = uuid.uuid4().hex
        deltas.withColumns({"batch_id": F.lit(batch_id), "attempt": F.lit(attempt)}).write.parquet(f"{self.path}/deltas/{attempt}")
        commit = self.spark.range(1).select(F.lit(batch_id).alias("batch_id"), F.lit(False).alias("folded"))
        if folded is not None:
            commit = commit.unionByName(folded.select("batch_id", F.lit(True).alias("folded")))
        if self.committed(batch_id):  # by another driver meanwhile
            return False
        commit.withColumn("attempt", F.lit(attempt)).coalesce(1).write.parquet(f"{self.path}/commits/{attempt}")
        return not self._commits().where(F.col("attempt") == attempt).isEmpty()

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit a batch of signed changes; False if that batch was committed before."""
        if self.committed(batch_id):
            return False
        # Summed on the map side first: a source that brings a third of all rows is one row a task.
        deltas = changes.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return self._commit(batch_id, deltas.where("documents <> 0 or tokens <> 0"))

    def _live(self) -> list[tuple[str, str]]:
        """(batch_id, attempt) of committed batches that no compaction has folded in: those since the last one, and it."""
        commits = self._commits()
        held = commits.where("folded").select("batch_id")
        return [(c.batch_id, c.attempt) for c in commits.where("not folded").join(held, "batch_id", "left_anti").collect()]

    def _sums(self, live: list[tuple[str, str]]) -> DataFrame:
        rows = self.spark.createDataFrame([], _DELTAS)
        if live:
            rows = self.spark.read.schema(_DELTAS).parquet(*[f"{self.path}/deltas/{attempt}" for _, attempt in live])
        sums = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.where("documents <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, documents, tokens) over all committed batches."""
        return self._sums(self._live())

    def compact(self) -> bool:
        """Fold every committed batch into one delta and remove what it folds.

        The batches are listed once, so one that is committed meanwhile is neither folded nor summed here.  One
        driver compacts at a time, while no other reads totals it planned before.
        """
        live = self._live()
        if len(live) < 2:
            return False
        names = self.spark.createDataFrame([(batch,) for batch, _ in live], "batch_id string")
        folded = names.union(self._commits().where("folded").select("batch_id"))
        old = finished_paths(self.spark, f"{self.path}/commits")
        if not self._commit(f"compaction-{uuid.uuid4().hex[:12]}", self._sums(live), folded):
            return False
        # All that was committed before is named by the new commit, but for batches that came after the listing.
        kept = {attempt for _, attempt in self._live()}
        for path in old:
            attempt = path.rsplit("/", 1)[1]
            if attempt not in kept:
                delete_path(self.spark, path)
                delete_path(self.spark, f"{self.path}/deltas/{attempt}")
        return True


def counted(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, source, lang, text_name (128-bit hash; null text: null) and the counts words, runs and bpe of whole texts."""
    tune(docs.sparkSession)

    def column(name: str, kind: str):
        return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name)

    rows = docs.select(
        column("doc_id", "long"),
        column("source", "string"),
        column("lang", "string"),
        F.concat_ws("-", F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(1), F.col("text")))).alias("name"),
        F.col("text").cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.load(tokenizer_path)
        for batch in batches:
            texts = batch.column("text")
            n = [len(bpe.ids(t.as_py() or "")) for t in texts]
            cols = [batch.column(c) for c in ("doc_id", "source", "lang")]
            name = pc.if_else(pc.is_valid(texts), batch.column("name"), pa.scalar(None, pa.string()))
            words, runs = [], []
            for lo, hi in text_chunks(texts):
                data, offsets = text_bytes(texts.slice(lo, hi - lo))
                for out, spans in ((words, word_spans), (runs, run_spans)):
                    out.append(np.diff(np.searchsorted(spans(data, offsets)[0], offsets)))
            counts = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, runs)]
            yield pa.RecordBatch.from_arrays(
                [*cols, name, *(pa.array(x, pa.int64()) for x in (*counts, n))],
                names=["doc_id", "source", "lang", "text_name", "words", "runs", "bpe"],
            )

    schema = "doc_id long, source string, lang string, text_name string, words long, runs long, bpe long"
    return rows.mapInArrow(in_task(run), schema)
