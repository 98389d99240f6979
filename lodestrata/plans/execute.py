"""Plans become DataFrames; Catalyst does the rest. Filters reach the scan, and a ranking is a
TakeOrderedAndProject over map-side combined groups."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import Filter, Plan

_COMPARE = {"eq": operator.eq, "ne": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}


def predicate(f: Filter, json_column: str = "dimensions") -> Column:
    """Fields compare by type; values inside the JSON map compare as text, also for gt and lt."""
    if f.json_key:
        return _COMPARE[f.operator](F.try_element_at(F.col(json_column), F.lit(f.field)), F.lit(str(f.value)))
    return _COMPARE[f.operator](F.col(f.field), F.lit(f.value))


#: Active revisions that are broadcast; with more of them Spark joins by revision.
FEW_REVISIONS = 100_000


def active(rows: DataFrame, revisions: DataFrame | None) -> DataFrame:
    """Rows of active revisions only. The registry has one row per revision and is counted before
    it is broadcast. ``rows`` of a source that keeps no revisions go without one."""
    if revisions is None:
        return rows
    ids = revisions.where("state = 'active'").select("revision_id").distinct()
    return rows.join(F.broadcast(ids) if ids.limit(FEW_REVISIONS + 1).count() <= FEW_REVISIONS else ids, "revision_id")


#: Where rows of each source keep their further attributes.
JSON_COLUMN = {"facts": "dimensions", "records": "attributes"}


def filtered(plan: Plan, rows: DataFrame) -> DataFrame:
    if plan.table_number is not None:
        rows = rows.where(F.col("table_number") == plan.table_number)
    for name in ("semantic_metric_key", "measure_name"):
        if plan.source == "facts" and getattr(plan, name):
            rows = rows.where(F.col(name) == getattr(plan, name))
    if plan.year_basis is not None:
        rows = rows.where(F.col("year_basis") == plan.year_basis)
    for name, value in plan.dedupe:
        rows = rows.where(F.try_element_at("attributes", F.lit(name)) == value)
    for f in plan.filters:
        rows = rows.where(predicate(f, JSON_COLUMN[plan.source]))
    return rows


def aggregated(plan: Plan) -> Column:
    if plan.source == "records":
        return F.count(F.lit(1))
    value = F.col("value_numeric")
    return {"sum": F.sum, "avg": F.avg, "count": F.count, "min": F.min, "max": F.max}[plan.aggregate](value)


def ordering(columns: list[str], descending: bool, by: str) -> list[Column]:
    """By one column, nulls last both ways, then by the others so that ties are settled."""
    first = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return [first, *(F.col(c).asc_nulls_last() for c in columns if c != by)]


def execute(plan: Plan, rows: DataFrame, revisions: DataFrame | None = None) -> DataFrame:
    """The plan's answer: group columns and ``value``, or for a select the rows' own columns.
    Only rows of active revisions count."""
    plan.validate()
    rows = filtered(plan, active(rows, revisions))
    if plan.operation == "select":
        value = [F.col("value_numeric").alias("value")] if plan.source == "facts" else []
        out = rows.select(*plan.group_by, *(F.try_element_at(F.col(JSON_COLUMN[plan.source]), F.lit(k)).alias(k) for k in plan.json_keys), *value)
        return out.orderBy(*ordering(out.columns, plan.descending, plan.order_by or out.columns[0])).limit(plan.limit)
    names = list(plan.group_by)
    out = rows.groupBy(*names).agg(aggregated(plan).alias("value"))
    if plan.operation == "rank" or plan.order_by:
        return out.orderBy(*ordering([*names, "value"], plan.descending, plan.order_by or "value")).limit(plan.limit)
    return out.orderBy(*(F.col(c).asc_nulls_last() for c in names)).limit(plan.limit) if names else out


def metadata(plan: Plan, rows: DataFrame, revisions: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """What the plan's answer rests on, over the rows that it counts, in one row or one for each
    value of ``by``: contributing values, units, the first revision, why values are blank, and
    whether units can be combined."""
    units = F.sort_array(F.collect_set("unit"))
    blank = [F.array_join(F.sort_array(F.collect_set(F.when(F.col("value_numeric").isNull(), F.col("blank_meaning")))), ";").alias("blank_meanings")] if "blank_meaning" in rows.columns else []
    return filtered(plan, active(rows, revisions)).groupBy(*(by or [])).agg(
        F.count("value_numeric").alias("contributing"),
        F.array_join(units, ";").alias("units"),
        F.min("revision_id").alias("first_revision"),
        F.when(F.size(units) > 1, F.lit("refused")).otherwise(F.lit("ok")).alias("unit_status"),
        *blank,
    )


def provenance(plan: Plan, rows: DataFrame, revisions: DataFrame | None = None, n: int = 5) -> DataFrame:
    """The first contributing rows of active revisions, in a stated order."""
    return filtered(plan, active(rows, revisions)).where("value_numeric is not null").orderBy("fact_id").limit(n)
