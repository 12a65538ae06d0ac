"""Small hand-made fact tables for rule tests."""

import datetime as dt

from pyspark.sql import functions as F

from tallyspark.functions.scalars import project_key
from tallyspark.schemas import PRICING, USAGE

DEFAULTS = dict(request_id=None, session_id="s1", project_slug="-p", cwd=None, git_branch=None, model="m-1",
                input_tokens=0, output_tokens=0, cache_creation_tokens=0, cache_read_tokens=0,
                source_file="f", source_line=1)


def make_usage(spark, rows):
    out = []
    for i, r in enumerate(rows):
        d = dict(DEFAULTS, message_id=f"id{i}", **r)
        ts = d["ts"] if isinstance(d["ts"], dt.datetime) else dt.datetime.fromisoformat(d["ts"])
        d["ts"] = ts
        d["project_key"] = ""
        d["usage_date"] = ts.date()
        out.append(tuple(d[f.name] for f in USAGE.fields))
    df = spark.createDataFrame(out, USAGE)
    return df.withColumn("project_key", project_key())


def make_rates(spark, rows):
    return spark.createDataFrame([(m, i, o, w, r, "manual", None, None) for (m, i, o, w, r) in rows], PRICING)
