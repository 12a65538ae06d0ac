"""Budget change sets: create, update, delete (keyed by id).

A change set is a DataFrame of requested edits; each operation returns the
new budgets table and a per-change status column, the table being written
as a new version by the caller.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.keyed import delete_keys, last_per_key, numbered, upsert, with_status
from ..schemas import BUDGETS

BUDGET_COLUMNS = [f.name for f in BUDGETS.fields]


def _valid(name: str = "name", amount: str = "amount_usd"):
    return F.col(name).isNotNull() & (F.col(name) != "") & (F.col(amount) > 0)


def create_budgets(budgets: DataFrame, changes: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """New budgets need a name and a positive amount; they start unpinned.

    Ids continue after the current maximum in change order (``pos``).
    """
    if "pos" not in changes.columns:
        changes = changes.withColumn("pos", F.lit(0).cast("bigint"))
    c = changes.withColumn("status", F.when(_valid(), F.lit("created")).otherwise(F.lit("invalid")))
    base = budgets.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    ok = c.filter(F.col("status") == "created").withColumn("_base", base)
    ok = numbered(ok, ["pos", "name", "amount_usd"], "_rank")
    ts = F.lit(now).cast("timestamp_ntz")
    new_rows = ok.select(
        (F.col("_base") + F.col("_rank")).cast("bigint").alias("id"),
        "name",
        F.col("amount_usd").cast("double").alias("amount_usd"),
        F.lit(False).alias("show_in_dashboard"),
        ts.alias("created_at"),
        ts.alias("updated_at"),
    )
    return budgets.select(*BUDGET_COLUMNS).unionByName(new_rows), c.select("pos", "name", "amount_usd", "status")


def update_budgets(budgets: DataFrame, changes: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """Replace name, amount and pin of existing ids; invalid edits are rejected, the last edit of an id stays."""
    st = with_status(changes, budgets, "id", "updated", "not_found")
    st = st.withColumn("status", F.when(~_valid(), F.lit("invalid")).otherwise(F.col("status")))
    created = budgets.select("id", "created_at")
    upd = (
        last_per_key(st.filter(F.col("status") == "updated"), "id")
        .join(created, "id")
        .select(
            "id",
            "name",
            F.col("amount_usd").cast("double").alias("amount_usd"),
            F.coalesce(F.col("show_in_dashboard"), F.lit(False)).alias("show_in_dashboard"),
            "created_at",
            F.lit(now).cast("timestamp_ntz").alias("updated_at"),
        )
    )
    return upsert(budgets.select(*BUDGET_COLUMNS), upd, "id"), st.select("id", "status")


def delete_budgets(budgets: DataFrame, ids: DataFrame) -> DataFrame:
    return delete_keys(budgets, ids, "id")
