"""WARC archives with a two-level capture index.

Writing: pages are ordered by entry key (reversed-host URL key, then page_id) with
a range shuffle.  Each range becomes one archive of gzip members, one WARC 1.1
record each, and one index shard: lines ``key <tab> JSON`` sorted by key and
compressed in blocks of ``BLOCK_LINES``, followed by the shard's sparse directory
(first key, offset and length of every block).  A task writes its files under
names of its own, and the shards' manifest is a Parquet table that Spark commits:
files of a lost or repeated attempt are in no manifest and are never read.

Reading: a key is sought by binary search in the manifest (one row a shard), then
in the shard's directory, then in one block fetched by a range read; the record is
fetched by a range read of its own.

Equal payloads (SHA-256, at least ``MIN_REVISIT`` bytes) are stored once: the record
of the smallest page_id is the response, the others are revisit records with its
headers and digest.  Null html is an empty payload; rows without a page_id are
never the kept response of a group that has one; rows that repeat the smallest
page_id are all responses.  Null urls have the key ``-``.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import in_task, shared_path, tune, written

BLOCK_LINES, MIN_REVISIT = 256, 100
#: Stored records for each task that reads captures back.
READ_RECORDS = 2048
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "urn:capture:page:"

SHARD = T.StructType(
    [
        T.StructField("first_key", T.StringType()),
        T.StructField("last_key", T.StringType()),
        T.StructField("base", T.StringType()),
        T.StructField("directory_offset", T.LongType()),
        T.StructField("directory_length", T.LongType()),
        T.StructField("records", T.LongType()),
    ]
)
CAPTURE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def clean_url(url: Column) -> Column:
    """The URL on one line: white space and control characters are percent-encoded as spaces."""
    return F.regexp_replace(F.coalesce(url.cast("string"), F.lit("-")), r"[\x00-\x20\x7F]", "%20")


def url_key(url: Column) -> Column:
    """Reversed-host sort key: ``org,example,www:8080)/path?query``, lower-cased; other texts stand as they are."""
    pattern = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)(:[0-9]*)?([^#]*)"
    url = clean_url(url)
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(url, pattern, 1)), r"\.")), ",")
    rest = F.lower(F.regexp_extract(url, pattern, 3))
    key = F.concat(host, F.regexp_extract(url, pattern, 2), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    return F.when(F.regexp_extract(url, pattern, 1) != "", key).otherwise(F.lower(url))


def entry_key(url: Column, page_id: Column) -> Column:
    return F.concat(url_key(url), F.lit(" "), F.coalesce(page_id.cast("string"), F.lit("-")))


def with_roles(pages: DataFrame) -> DataFrame:
    """page_id, url, key, payload, and what kind of record each page becomes."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        clean_url(F.col("url")).alias("url"),
        entry_key(F.col("url"), F.col("page_id").cast("long")).alias("key"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    # Pre-aggregated by digest before the shuffle: a payload that fills a third of the pages is one row a task.
    kept = (
        rows.where(F.octet_length("payload") >= MIN_REVISIT)
        .groupBy("digest")
        .agg(F.min("page_id").alias("kept"), F.count("*").alias("n"))
        .where("n > 1 and kept is not null")
    )
    kept = written(kept.select("digest", "kept"), "warc-kept")
    same = F.col("page_id").eqNullSafe(F.col("kept"))
    return rows.join(kept, "digest", "left").withColumn("refers_to", F.when(F.col("kept").isNotNull() & ~same, F.col("kept")))


def _open(base: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(base)


def record(page_id, url: str, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC 1.1 record: a response, or a revisit of another page's equal payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{_RECORD}{'-' if page_id is None else page_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(body)),
    }
    if refers_to is not None:
        head |= {"WARC-Refers-To": f"<{_RECORD}{refers_to}>", "WARC-Profile": _PROFILE}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names lower-cased) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length does not match its header")
    return headers, rest[:size]


def _page(urn: str) -> int | None:
    name = urn.strip("<>").removeprefix(_RECORD)
    return None if name == "-" else int(name)


def capture(data: bytes) -> tuple:
    """A stored record as a CAPTURE row; a response's length and digest are those of the bytes read."""
    headers, block = parse(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = headers["warc-type"]
    size = next(int(x.split(b": ")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: "))
    digest = headers["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
    refers = headers.get("warc-refers-to")
    return (
        _page(headers["warc-record-id"]),
        headers["warc-target-uri"],
        kind,
        _page(refers) if refers else None,
        size,
        digest,
        payload if kind == "response" else None,
    )


def _write_shards(base: str, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(base)
        files.create_dir(root, recursive=True)
        name = uuid.uuid4().hex
        at = records = 0
        first = last = None
        lines: list[str] = []
        directory: list[tuple[str, int, int]] = []
        warc = index = None
        place = 0

        def flush() -> None:
            nonlocal place, lines
            data = zlib.compress("\n".join(lines).encode())
            index.write(data)
            directory.append((lines[0].split("\t", 1)[0], place, len(data)))
            place += len(data)
            lines = []

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("key", "page_id", "url", "payload", "digest", "refers_to")), strict=True):
                key, page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                if warc is None:
                    warc = files.open_output_stream(f"{root}/{name}.warc.gz", compression=None)
                    index = files.open_output_stream(f"{root}/{name}.cdx", compression=None)
                    first = key
                data = gzip.compress(record(page_id, url, payload.encode(), digest, refers_to, date), 6, mtime=0)
                warc.write(data)
                lines.append(f"{key}\t{json.dumps({'offset': at, 'length': len(data), 'digest': digest})}")
                at, records, last = at + len(data), records + 1, key
                if len(lines) == BLOCK_LINES:
                    flush()
        if warc is None:
            return
        if lines:
            flush()
        data = zlib.compress(json.dumps(directory).encode())
        index.write(data)
        warc.close()
        index.close()
        values = [first, last, f"{base}/{name}", place, len(data), records]
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], pa.string() if i < 3 else pa.int64()) for i, v in enumerate(values)], names=SHARD.names
        )

    return run


def write_archives(pages: DataFrame, captured_at: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write archives and their index to the shared folder; returns the manifest, one row a shard."""
    spark = pages.sparkSession
    tune(spark)
    base = shared_path(spark, "warc")
    rows = with_roles(pages).select("key", "page_id", "url", "payload", "digest", "refers_to")
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key")
    return written(ordered.mapInArrow(in_task(_write_shards(base, captured_at)), SHARD), "warc-manifest")


class Reader:
    """Binary search over the manifest, a shard's directory and a block; keeps the last shard and block."""

    def __init__(self, shards: list[tuple]):
        self.shards = sorted(shards)
        self.firsts = [s[0].encode() for s in self.shards]
        self.shard = self.block = None

    def _load_shard(self, i: int) -> None:
        if self.shard == i:
            return
        self.close()
        _, _, base, offset, length, _ = self.shards[i]
        files, path = _open(base)
        self.index, self.warc = files.open_input_file(f"{path}.cdx"), files.open_input_file(f"{path}.warc.gz")
        directory = json.loads(zlib.decompress(self.index.read_at(length, offset)))
        self.block_firsts = [d[0].encode() for d in directory]
        self.places = [(d[1], d[2]) for d in directory]
        self.shard, self.block = i, None

    def close(self) -> None:
        if self.shard is not None:
            self.index.close()
            self.warc.close()
            self.shard = None

    def _load_block(self, i: int) -> None:
        if self.block == i:
            return
        offset, length = self.places[i]
        pairs = [x.split("\t", 1) for x in zlib.decompress(self.index.read_at(length, offset)).decode().split("\n")]
        self.keys, self.entries = [k.encode() for k, _ in pairs], [e for _, e in pairs]
        self.block = i

    def find(self, key: str) -> Iterator[bytes]:
        """Every record stored under ``key``; equal keys may run over blocks and shards."""
        wanted = key.encode()
        shard = max(0, bisect.bisect_left(self.firsts, wanted) - 1)
        while shard < len(self.shards) and self.firsts[shard] <= wanted:
            if self.shards[shard][1].encode() >= wanted:
                self._load_shard(shard)
                block = max(0, bisect.bisect_left(self.block_firsts, wanted) - 1)
                while block < len(self.places) and self.block_firsts[block] <= wanted:
                    self._load_block(block)
                    for i in range(bisect.bisect_left(self.keys, wanted), bisect.bisect_right(self.keys, wanted)):
                        entry = json.loads(self.entries[i])
                        yield gzip.decompress(self.warc.read_at(entry["length"], entry["offset"]))
                    block += 1
            shard += 1


def read_captures(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """CAPTURE rows of all records stored under the entry keys of ``keys(key)``, found through the index.

    The keys are sorted by ranges, so neighbouring look-ups meet the same block.  Keys are small and
    records are not, so the number of ranges follows from the stored records.  The
    manifest has one row for each range of the writing shuffle; tasks read it from there.
    """
    shards = [tuple(r) for r in manifest.select(*SHARD.names).collect()]  # one row a written file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shards)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                rows = [capture(r) for key in batch.column(0).slice(i, 64).to_pylist() for r in reader.find(key)]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=CAPTURE.names
                    )
        reader.close()

    tasks = max(1, -(-sum(s[-1] for s in shards) // READ_RECORDS))
    wanted = keys.select("key").distinct().repartitionByRange(tasks, "key").sortWithinPartitions("key")
    return wanted.mapInArrow(in_task(run), CAPTURE)


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
