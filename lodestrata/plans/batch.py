"""Plans as rows: checked by a column expression, and answered many at a time in one scan.

A table of plans has the columns of ``SCHEMA``; values of filters are text. ``verdict`` says of
every row what ``Plan.validate`` says of a plan. ``answers`` runs all valid aggregates and ranks
over facts or records together. Rows are first summed to cells that no plan tells apart. What a
plan wants to be equal is its key; plans that say the same are one; cells, which stand once for every set of fields that plans
compare, meet the plans of their keys in a join, and other comparisons are checked on what has
met. A grouped aggregation gives every plan's groups. Plans without any equality meet all cells.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrata.sources.scratch import written

from .execute import JSON_COLUMN, active
from .model import AGGREGATES, DUAL_YEAR_TABLES, FACT_FIELDS, MAX_ROWS, OPERATORS, RECORD_FIELDS, SHORT_NAMES, YEAR_AXES, YEARS, Plan

SCHEMA = (
    "plan_id string, source string, operation string, aggregate string, table_number int, semantic_metric_key string, measure_name string, "
    "filters array<struct<field: string, operator: string, value: string, json_key: boolean>>, group_by array<string>, json_keys array<string>, "
    "order_by string, descending boolean, limit int, year_basis string, require_year_basis boolean"
)
#: Sets of compared fields that rows are expanded by in one scan, and plans that are broadcast; more take further scans, or a shuffled join.
SETS_AT_ONCE, FEW_PLANS = 32, 100_000


def plan_rows(spark: SparkSession, plans: dict[str, Plan]) -> DataFrame:
    """Plans as rows."""
    of = lambda k, p: (k, p.source, p.operation, p.aggregate, p.table_number, p.semantic_metric_key, p.measure_name, [(f.field, f.operator, str(f.value), f.json_key) for f in p.filters], list(p.group_by), list(p.json_keys), p.order_by, p.descending, p.limit, p.year_basis, p.require_year_basis)
    return spark.createDataFrame([of(k, p) for k, p in plans.items()], SCHEMA)


def _names(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values))


def _listed(value: Column, values: Iterable[str]) -> Column:
    return F.array_contains(_names(values), value)


def _columns() -> Column:
    return F.when(F.col("source") == "facts", _names((*FACT_FIELDS, *SHORT_NAMES))).otherwise(_names((*RECORD_FIELDS, *SHORT_NAMES)))


def verdict() -> Column:
    """``accept``, ``clarify``, or ``reject: `` and the rule that the plan breaks first."""
    known, fields = _columns(), F.transform(F.filter("filters", lambda f: ~f["json_key"]), lambda f: f["field"])
    rank_or_sum = F.col("operation") != "select"
    order = F.col("order_by")
    broken = {
        "source": ~_listed(F.col("source"), ("facts", "records")),
        "operation": ~_listed(F.col("operation"), ("aggregate", "select", "rank")),
        "aggregate": ~_listed(F.col("aggregate"), AGGREGATES),
        "records can be counted only": (F.col("source") == "records") & rank_or_sum & (F.col("aggregate") != "count"),
        "limit": ~F.col("limit").between(1, MAX_ROWS),
        "comparison": F.exists("filters", lambda f: ~_listed(f["operator"], OPERATORS)),
        "filter": F.size(F.array_except(fields, known)) > 0,
        "group": F.size(F.array_except("group_by", known)) > 0,
        "key": (F.size("json_keys") > 0) & ~((F.col("operation") == "select") & (F.col("source") == "records")),
        "order": F.coalesce(order != "", F.lit(False)) & ~F.array_contains(F.concat("group_by", "json_keys", F.array(F.lit("value"))), order),
    }
    ambiguous = F.col("require_year_basis") & F.col("table_number").isin(*DUAL_YEAR_TABLES) & F.col("year_basis").isNull() & F.arrays_overlap(fields, _names(sorted(YEARS))) & ~F.arrays_overlap(fields, _names(sorted(YEAR_AXES)))
    out = F.when(F.lit(False), F.lit(""))
    for rule, condition in broken.items():
        out = out.when(F.coalesce(condition, F.lit(True)), F.lit(f"reject: {rule}"))
    return out.when(F.coalesce(ambiguous, F.lit(False)), F.lit("clarify")).otherwise(F.lit("accept"))


def _implied(plans: DataFrame) -> DataFrame:
    """Equalities that a plan states in columns of their own join its filters; what is equal becomes its key."""
    stated = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("field"), F.lit("eq").alias("operator"), F.col(c).cast("string").alias("value"), F.lit(False).alias("json_key"))) for c in ("table_number", "year_basis")]
    stated += [F.when((F.col("source") == "facts") & (F.coalesce(F.col(c), F.lit("")) != ""), F.struct(F.lit(c).alias("field"), F.lit("eq").alias("operator"), F.col(c).alias("value"), F.lit(False).alias("json_key"))) for c in ("semantic_metric_key", "measure_name")]
    every = F.concat("filters", F.filter(F.array(*stated), lambda f: f.isNotNull()))
    equal = F.array_sort(F.transform(F.filter(every, lambda f: f["operator"] == "eq"), lambda f: F.struct(F.concat(F.when(f["json_key"], F.lit("j:")).otherwise(F.lit("c:")), f["field"]).alias("name"), f["value"].alias("value"))))
    return plans.select("plan_id", "operation", "aggregate", "group_by", "order_by", "descending", "limit", equal.alias("equal"), F.filter(every, lambda f: f["operator"] != "eq").alias("other"))


def _value(name: str, json_column: str) -> Column:
    return F.try_element_at(F.col(json_column), F.lit(name[2:])) if name.startswith("j:") else F.col(name[2:]).cast("string")


def _name(f: Column) -> Column:
    return F.concat(F.when(f["json_key"], F.lit("j:")).otherwise(F.lit("c:")), f["field"])


def _holds(f: Column, values: Column, numeric: list[str]) -> Column:
    """A comparison of a row's value, by number for numeric columns, else as text; a missing value fulfils none."""
    value = F.try_element_at(values, _name(f))
    by_number = ~f["json_key"] & _listed(f["field"], numeric) if numeric else F.lit(False)
    left, right = value.try_cast("decimal(38,10)"), f["value"].try_cast("decimal(38,10)")
    sign = F.when(by_number, F.when(left < right, -1).when(left > right, 1).when(left == right, 0)).otherwise(F.when(value < f["value"], -1).when(value > f["value"], 1).when(value == f["value"], 0))
    op = f["operator"]
    return F.coalesce(F.when(op == "ne", sign != 0).when(op == "gt", sign > 0).when(op == "gte", sign >= 0).when(op == "lt", sign < 0).when(op == "lte", sign <= 0), F.lit(False))


def answers(plans: DataFrame, rows: DataFrame, revisions: DataFrame | None, source: str = "facts") -> DataFrame:
    """(plan_id, groups, value, place, contributing, units, first_revision, status) of all valid
    aggregates and ranks over ``source``: a row for every group, in the plan's order, at most its
    limit. ``groups`` are the group columns' values as text. Of a plan that no row meets there is
    one row if it groups by nothing, with nothing in it, else none. ``status`` is ``refused`` if the
    plan's values have several units; then ``value`` is null."""
    spark, json_column = rows.sparkSession, JSON_COLUMN[source]
    stated = _implied(plans.where((F.col("source") == source) & F.col("operation").isin("aggregate", "rank") & (verdict() == "accept")))
    content = [c for c in stated.columns if c != "plan_id"]
    stated = written(stated.withColumn("same", F.sha2(F.to_json(F.struct(*content)), 256)), "stated")
    asked = stated.select(F.col("plan_id").alias("asked"), "same")
    # plans that say the same are answered once, under their digest
    valid = written(stated.groupBy("same").agg(*(F.first(c).alias(c) for c in content)).withColumnRenamed("same", "plan_id"), "plans")
    sets = [r[0] for r in valid.select(F.array_join(F.transform("equal", lambda e: e["name"]), "\n").alias("names")).distinct().collect()]
    compared = F.concat(F.transform("other", _name), F.transform("group_by", lambda g: F.concat(F.lit("c:"), g)), F.transform("equal", lambda e: e["name"]))
    used = sorted(r[0] for r in valid.select(F.explode(compared)).distinct().collect())
    numeric = [f.name for f in rows.schema if f.dataType.typeName() in ("integer", "long", "short", "double", "float", "decimal")]
    base = active(rows, revisions)
    base = base if "revision_id" in base.columns else base.withColumn("revision_id", F.lit(None).cast("string"))
    number = F.col("value_numeric").cast("decimal(38,10)") if source == "facts" else F.lit(None).cast("decimal(38,10)")
    unit = F.col("unit") if source == "facts" else F.lit(None).cast("string")
    at = {n: f"f{i}" for i, n in enumerate(used)}
    # rows that no plan tells apart are summed before they meet the plans
    cells = base.select(*(_value(n, json_column).alias(c) for n, c in at.items()), number.alias("number"), unit.alias("unit"), "revision_id").groupBy(*at.values()).agg(
        F.sum("number").alias("sum"), F.min("number").alias("min"), F.max("number").alias("max"), F.count("number").alias("numbers"), F.count(F.lit(1)).alias("n"),
        F.collect_set("unit").alias("units"), F.min("revision_id").alias("first_revision"),
    )
    cells = written(cells, "cells") if len(sets) > SETS_AT_ONCE else cells
    values = F.create_map(*(x for n, c in at.items() for x in (F.lit(n), F.col(c)))) if used else F.expr("cast(map() as map<string,string>)")
    key = F.array_join(F.transform("equal", lambda e: F.concat(F.length(e["value"]).cast("string"), F.lit(":"), e["value"])), "")
    keyed = written(valid.withColumn("names", F.array_join(F.transform("equal", lambda e: e["name"]), "\n")).withColumn("key", key), "plans")
    wanted = F.broadcast(keyed) if keyed.limit(FEW_PLANS + 1).count() <= FEW_PLANS else keyed
    measures, met = ("sum", "min", "max", "numbers", "n", "units", "first_revision"), None
    for i in range(0, max(len(sets), 1), SETS_AT_ONCE):
        stands = []
        for names in sets[i : i + SETS_AT_ONCE]:
            parts = [F.col(at[n]) for n in names.split("\n") if n]
            stands.append(F.struct(F.lit(names).alias("names"), (F.concat(*(x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p))) if parts else F.lit("")).alias("key")))
        stand = F.explode(F.array(*stands) if stands else F.expr("cast(array() as array<struct<names:string,key:string>>)"))
        expanded = cells.select(*measures, values.alias("values"), stand.alias("s")).select(*measures, "values", "s.names", "s.key").where("key is not null")
        joined = expanded.join(wanted, ["names", "key"]).where(F.forall("other", lambda f: _holds(f, F.col("values"), numeric)))
        part = joined.select("plan_id", F.transform("group_by", lambda g: F.try_element_at("values", F.concat(F.lit("c:"), g))).alias("groups"), *measures)
        met = part if met is None else met.union(part)
    summed = met.groupBy("plan_id", "groups").agg(
        F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("numbers").alias("numbers"), F.sum("n").alias("n"),
        F.array_distinct(F.flatten(F.collect_set("units"))).alias("units"), F.min("first_revision").alias("first_revision"),
    )
    nothing = F.size("group_by") == 0
    every = valid.select("plan_id", "operation", "aggregate", "order_by", "descending", "limit", "group_by").join(summed, "plan_id", "left").where(F.col("groups").isNotNull() | nothing)
    count = F.coalesce(F.col("numbers") if source == "facts" else F.col("n"), F.lit(0))
    value = F.when(F.col("aggregate") == "count", count.cast("double"))
    for name in ("sum", "min", "max"):
        value = value.when(F.col("aggregate") == name, F.col(name).cast("double"))
    value = value.when(F.col("aggregate") == "avg", F.try_divide(F.col("sum").cast("double"), F.col("numbers")))
    out = every.withColumn("value", value).withColumn("contributing", count).withColumn("groups", F.coalesce("groups", F.array().cast("array<string>")))
    units = summed.select("plan_id", F.explode("units").alias("unit")).groupBy("plan_id").agg(F.sort_array(F.collect_set("unit")).alias("all_units"))
    out = out.drop("units").join(units, "plan_id", "left")
    by_value = (F.col("operation") == "rank") | (F.coalesce(F.col("order_by"), F.lit("")) == "value")
    column = F.array_position("group_by", F.col("order_by"))
    first = F.when(~by_value & (column > 0), F.get("groups", (column - 1).cast("int")))
    order = [
        F.when(by_value & F.col("descending"), F.col("value")).desc_nulls_last(), F.when(by_value & ~F.col("descending"), F.col("value")).asc_nulls_last(),
        F.when(F.col("descending"), first).desc_nulls_last(), F.when(~F.col("descending"), first).asc_nulls_last(), F.col("groups").asc_nulls_last(),
    ]
    placed = out.withColumn("place", F.row_number().over(Window.partitionBy("plan_id").orderBy(*order))).where(F.col("place") <= MAX_ROWS).where("place <= limit")
    several = F.coalesce(F.size("all_units"), F.lit(0)) > 1
    placed = asked.join(placed, F.col("same") == F.col("plan_id")).drop("same", "plan_id").withColumnRenamed("asked", "plan_id")
    return placed.select("plan_id", "groups", F.when(~several, F.col("value")).alias("value"), "place", "contributing", F.coalesce(F.array_join("all_units", ";"), F.lit("")).alias("units"), "first_revision", F.when(several, F.lit("refused")).otherwise(F.lit("ok")).alias("status"))
