"""Stored dimension tables: price sheet, budgets; schema-evolution defaults."""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import stored_time
from ..schemas import BUDGETS, PRICING, SOURCE_MANUAL
from ..session import fresh_path


#: Tables staged by the runs under way in a thread, innermost last.
_runs = threading.local()


@contextlib.contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Removes what is staged inside once it is done."""
    open_runs = _runs.__dict__.setdefault("open", [])
    open_runs.append([])
    try:
        yield
    finally:
        for path in open_runs.pop():
            delete_path(spark, path)


@contextlib.contextmanager
def short_splits(spark: SparkSession, size: str = "32m") -> Iterator[None]:
    """Files are read in splits of ``size`` inside, unless the platform set a size.

    For plans that sort what a task reads: rows with much repetition take over ten times
    the room in memory that they take in a file.
    """
    key = "spark.sql.files.maxPartitionBytes"
    if spark.conf.get(key, None) is not None:
        yield
        return
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.unset(key)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, and its size is known to the planner.

    Inside ``staging`` the table goes with it.  A report that returns a DataFrame cannot know when its
    rows were read: its tables stay until the platform clears the folder.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if open_runs := getattr(_runs, "open", None):
        open_runs[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table path exists (Hadoop FileSystem of the session)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of a table (one partition) with everything in it."""
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def with_default(df: DataFrame, name: str, default, dtype: str) -> DataFrame:
    """Add a column added to the table later, or fill its nulls, with a default."""
    if name in df.columns:
        return df.withColumn(name, F.coalesce(F.col(name).cast(dtype), F.lit(default).cast(dtype)))
    return df.withColumn(name, F.lit(default).cast(dtype))


def _times(df: DataFrame, cols: list[str]) -> DataFrame:
    """Time columns stored as text become timestamps; unparseable text -> null."""
    for c in cols:
        if c in df.columns and dict(df.dtypes)[c] == "string":
            df = df.withColumn(c, stored_time(F.nullif(F.col(c), F.lit(""))))
    return df


def read_pricing(spark: SparkSession, path: str) -> DataFrame:
    """Price sheet ordered by model; source defaults to manual, empty times -> null."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    df = with_default(df, "source", SOURCE_MANUAL, "string")
    df = with_default(df, "fetched_at", None, "timestamp_ntz") if "fetched_at" not in df.columns else df
    df = with_default(df, "updated_at", None, "timestamp_ntz") if "updated_at" not in df.columns else df
    df = _times(df, ["fetched_at", "updated_at"])
    return df.select(*[F.col(f.name).cast(f.dataType) for f in PRICING.fields]).orderBy("model")


def read_budgets(spark: SparkSession, path: str) -> DataFrame:
    """Budgets ordered by id; the pin flag (a later column) defaults to false."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    df = with_default(df, "show_in_dashboard", False, "boolean")
    for c in ("created_at", "updated_at"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    df = _times(df, ["created_at", "updated_at"])
    return df.select(*[F.col(f.name).cast(f.dataType) for f in BUDGETS.fields]).orderBy("id")


# --- versioned tables -------------------------------------------------------
# A table version is a directory <base>/v=<n>; a version counts only once its
# write committed (_SUCCESS present).  Writers always create v=<latest+1>, so
# the path being read is never overwritten.


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def finished_paths(spark: SparkSession, base: str) -> list[str]:
    """The folders in ``base`` whose write finished (_SUCCESS present)."""
    p, fs = _fs(spark, f"{base}/*/_SUCCESS")
    return sorted(st.getPath().getParent().toString() for st in fs.globStatus(p) or [])


def partition_values(spark: SparkSession, path: str, column: str) -> list[str]:
    """The values of a table's partition column, in order, from its folders' names."""
    p, fs = _fs(spark, f"{path}/{column}=*")
    names = (st.getPath().getName().split("=", 1)[1] for st in fs.globStatus(p) or [])
    return sorted(v for v in names if not v.startswith("__"))


def committed_versions(spark: SparkSession, base: str) -> list[int]:
    p, fs = _fs(spark, base)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v=") and name[2:].isdigit():
            if fs.exists(st.getPath().suffix("/_SUCCESS")):
                out.append(int(name[2:]))
    return sorted(out)


def read_latest_path(spark: SparkSession, base: str) -> str | None:
    versions = committed_versions(spark, base)
    return f"{base.rstrip('/')}/v={versions[-1]}" if versions else None


def read_latest(spark: SparkSession, base: str) -> DataFrame | None:
    path = read_latest_path(spark, base)
    return spark.read.parquet(path) if path else None


def write_version(spark: SparkSession, df: DataFrame, base: str) -> int:
    """Write ``df`` as the next version of the table at ``base``; returns it."""
    versions = committed_versions(spark, base)
    n = (versions[-1] if versions else 0) + 1
    df.write.mode("errorifexists").parquet(f"{base.rstrip('/')}/v={n}")
    return n
