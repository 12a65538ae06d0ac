"""Byte ranges of log files: reading from a saved offset, in batch and as a stream.

A range is (file, from byte, to byte).  It is cut into blocks of ``BLOCK`` bytes, each
read by a task of its own; a line belongs to the block it starts in.  Rows have the
columns of ``logs.scan_lines`` and the offset and line the range resumes at, so line numbers go
on where the last run stopped and a file that grew by a kilobyte costs a kilobyte.

* ``read_ranges`` -- batch: the ranges are a DataFrame and stay one.
* ``LogTail`` -- a streaming source of append-style logs.  Its offset is the number of
  whole lines' bytes consumed of each file, so a replayed batch reads the same bytes.

Files are opened through ``pyarrow.fs`` (file, HDFS with libhdfs, S3, GCS).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a range that one task reads; bytes read at once beyond a block to end its last line.
BLOCK, STEP = 8 << 20, 1 << 16
#: Bytes of files that one task gets to read or copy.
TASK_BYTES = 32 << 20

RANGE_LINES = T.StructType(
    [
        T.StructField("value", T.StringType()),
        T.StructField("n_bytes", T.LongType()),  # of the line as stored, without its separator
        T.StructField("source_file", T.StringType()),
        T.StructField("block_start", T.LongType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("base_offset", T.LongType()),
        T.StructField("base_line", T.LongType()),
    ]
)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem of a plain path or URI as the scans report them."""
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def opened(path: str):
    where, name = filesystem(path)
    return where.open_input_file(name)


def _pread(f, lo: int, hi: int) -> bytes:
    f.seek(lo)
    return f.read(max(hi - lo, 0))


def block_lines(f, start: int, lo: int, hi: int, to: int) -> list[bytes]:
    """The lines of the range ``start`` to ``to`` that start in ``lo`` to ``hi``, without separators."""
    data = _pread(f, max(lo - 1, start), hi)
    if lo > start:  # a line that starts before the block is another block's
        end = data.find(b"\n") + 1
        if not end or end == len(data):
            return []
        data = data[end:]
    pieces, at = [data], hi
    while at < to and not pieces[-1].endswith(b"\n"):
        more = _pread(f, at, min(at + STEP, to))
        if not more:
            break
        end = more.find(b"\n") + 1
        pieces.append(more[: end or len(more)])
        at += len(pieces[-1])
    lines = b"".join(pieces).split(b"\n")
    if not lines[-1]:
        lines.pop()
    return lines


def last_line_end(f, size: int, start: int = 0) -> int:
    """Bytes up to the end of the last whole line (``start`` if none ends behind it)."""
    at = size
    while at > start:
        lo = max(start, at - STEP)
        end = _pread(f, lo, at).rfind(b"\n") + 1
        if end:
            return lo + end
        at = lo
    return start


def continues(f, offset: int, head_bytes: int, head_crc: int) -> bool:
    """Whether a file still begins with the line it began with and a line ends at the offset."""
    if offset and _pread(f, offset - 1, offset) != b"\n":
        return False
    return zlib.crc32(_pread(f, 0, head_bytes)) == head_crc


def _batch(lines: list[bytes], path: str, lo: int, size: int, modified_at, start: int, base_line: int) -> pa.RecordBatch:
    n = len(lines)
    columns = [
        pa.array([x.decode("utf-8", "replace") for x in lines], pa.string()), pa.array([len(x) for x in lines], pa.int64()),
        pa.array([path] * n), pa.array([lo] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([size] * n, pa.int64()),
        pa.array([modified_at] * n, pa.timestamp("us", "UTC")), pa.array([start] * n, pa.int64()), pa.array([base_line] * n, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=RANGE_LINES.names)


# --- batch --------------------------------------------------------------------


def dealt(rows: DataFrame, n_rows: int, n_bytes: int) -> DataFrame:
    """``rows`` that stand for ``n_bytes`` of files, dealt to tasks of about ``TASK_BYTES``, at least one a core.

    The number is given: adaptive execution knows only the size of the rows, would
    find them few and put them into one task.
    """
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, min(n_rows, max(least, -(-n_bytes // TASK_BYTES)))))


def unbroken(candidates: DataFrame, open_file: Callable = opened) -> DataFrame:
    """The rows (source_file, resume_offset, head_bytes, head_crc, ...) whose file is the one that was read, grown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for r in batch.select(["source_file", "resume_offset", "head_bytes", "head_crc"]).to_pylist():
                try:
                    with open_file(r["source_file"]) as f:
                        keep.append(continues(f, r["resume_offset"], r["head_bytes"], r["head_crc"]))
                except OSError:  # it is read as a whole, by Spark's own reader
                    keep.append(False)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return candidates.mapInArrow(run, candidates.schema)


def read_ranges(ranges: DataFrame, open_file: Callable = opened) -> DataFrame:
    """RANGE_LINES of ``ranges(source_file, resume_offset, resume_line, length, modified_at)``, from the offset to the length.

    A file that fails gives no line, so that its bytes do not add up and it is tried again.
    """
    block = F.explode(F.expr(f"sequence(resume_offset, length - 1, {BLOCK}L)")).alias("lo")
    ranges = ranges.where("length > resume_offset")
    blocks = ranges.select("source_file", "resume_offset", "resume_line", "length", "modified_at", block)
    size = F.col("length") - F.col("resume_offset")
    n_blocks, n_bytes = ranges.agg(F.coalesce(F.sum(F.ceil(size / BLOCK)), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                start, lo, to = r["resume_offset"], r["lo"], r["length"]
                try:
                    with open_file(r["source_file"]) as f:
                        lines = block_lines(f, start, lo, min(lo + BLOCK, to), to)
                except OSError:
                    continue
                yield _batch(lines, r["source_file"], lo, to, r["modified_at"], start, r["resume_line"])

    return dealt(blocks, n_blocks, n_bytes).mapInArrow(run, RANGE_LINES)


# --- stream -------------------------------------------------------------------


@dataclass
class Range(InputPartition):
    source_file: str
    start: int
    lo: int
    hi: int
    to: int
    modified_at: int  # microseconds


class LogTail(DataSource):
    """``spark.readStream.format("log_tail").load(root)``: whole lines as they are appended below a root.

    Option: ``glob`` (of file names).  A file with less than its offset was truncated or replaced
    and is read from its start.  ``base_line`` is unknown to the source (-1): it is the line the
    store's manifest has at ``base_offset``.  Each trigger lists the root on the driver, as Spark's
    file stream does, and the offset has a number a file.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> T.StructType:
        return RANGE_LINES

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return LogTailReader(self.options["path"], self.options.get("glob", "*.jsonl"))


class LogTailReader(DataSourceStreamReader):
    def __init__(self, root: str, glob: str):
        self.root, self.glob = root, glob
        self.seen: dict[str, tuple[int, int, int]] = {}  # size, time, end of the last whole line

    def _files(self) -> dict[str, pafs.FileInfo]:
        where, base = filesystem(self.root.removeprefix("file://"))
        scheme = self.root.split("://")[0] + "://" if "://" in self.root and not self.root.startswith("file:") else ""
        found = where.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
        # The same files as the scans: hidden ones are no logs.
        return {
            scheme + i.path: i for i in found
            if i.type == pafs.FileType.File and fnmatch(i.base_name, self.glob) and not i.base_name.startswith(("_", "."))
        }

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        """Bytes of whole lines of each file; reads the end of files that changed."""
        for path, info in self._files().items():
            state = (info.size, info.mtime_ns)
            if path not in self.seen or self.seen[path][:2] != state:
                try:
                    with opened(path) as f:
                        self.seen[path] = (*state, last_line_end(f, info.size))
                except OSError:  # tried again by the next trigger
                    continue
        return {"files": json.dumps({path: x[2] for path, x in self.seen.items() if x[2]}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        before, files, out = json.loads(start["files"]), self._files(), []
        for path, to in json.loads(end["files"]).items():
            lo = before.get(path, 0)
            if to == lo or path not in files:
                continue
            lo = lo if to > lo else 0
            at = int(files[path].mtime_ns // 1000)
            out += [Range(path, lo, b, min(b + BLOCK, to), to, at) for b in range(lo, to, BLOCK)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p = partition
        with opened(p.source_file) as f:
            lines = block_lines(f, p.start, p.lo, p.hi, p.to)
        yield _batch(lines, p.source_file, p.lo, p.to, p.modified_at, p.start, -1)

    def commit(self, end: dict) -> None:
        """Offsets live in the checkpoint; there is nothing to release."""
