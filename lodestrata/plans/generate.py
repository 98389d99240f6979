"""Questions made from facts, each with its plan, kept only if the plan's answer agrees.

Release questions look one value up, or add a scope's values up; challenge questions ask for a
trend, a comparison, a ranking, a value that is not there, or leave the year's meaning open. A
candidate is one row with the columns of a plan. Scopes come from grouped facts, never from a
product of their values, so there are as many candidates as there are scopes. All plans are
answered together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.sources.scratch import written

from .batch import answers, verdict
from .execute import active

LOOKUPS = (
    "What was {label} in {year} Q{quarter}?",
    "For {year} Q{quarter}, what value was reported for {label}?",
    "What value for {label} was reported in the Q{quarter} {year} update?",
    "In Q{quarter} {year}, what was reported as {label}?",
)
SCOPED = "In {year}, how much {label} was attributed to {scope}?"
SPLIT = "For {line} lines in {tier}, what {label} was reported in {year} Q{quarter}?"
TREND = "How did {label} of {line} change across the quarters of {year}?"
COMPARISON = "In {year} Q{quarter}, which regions but {tier} reported most {label}?"
RANKING = "In {year}, which three segments had the highest {label}?"
MISSING = "Has {label} been reported for {year} Q{quarter} yet?"
OPEN_YEAR = "What {label} was reported for {year}?"


def _said(template: str, **values: Column) -> Column:
    """The template with columns in its places."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), values[name].cast("string")]
    return F.concat(*out, F.lit(rest))


def _filter(name: str, value: Column, operator: str = "eq", json_key: bool = False) -> Column:
    return F.struct(F.lit(name).alias("field"), F.lit(operator).alias("operator"), value.cast("string").alias("value"), F.lit(json_key).alias("json_key"))


def _plan(rows: DataFrame, kind: str, answer_kind: str, question: Column, filters: list[Column], *, expected: Column | None = None, group_by: tuple[str, ...] = (), operation: str = "aggregate", aggregate: str = "sum", limit: int = 50, table: int | None = None) -> DataFrame:
    null, groups = F.lit(None).cast("string"), F.array(*map(F.lit, group_by)) if group_by else F.array().cast("array<string>")
    return rows.select(
        F.concat(F.lit(kind + ": "), question).alias("plan_id"), F.lit(kind).alias("kind"), F.lit(answer_kind).alias("answer_kind"), question.alias("question"), (F.lit(None) if expected is None else expected).cast("double").alias("expected"),
        F.lit("facts").alias("source"), F.lit(operation).alias("operation"), F.lit(aggregate).alias("aggregate"), (F.col("table_number") if table is None else F.lit(table)).cast("int").alias("table_number"), null.alias("semantic_metric_key"), null.alias("measure_name"),
        F.array(*filters).alias("filters"), groups.alias("group_by"), F.array().cast("array<string>").alias("json_keys"), null.alias("order_by"), F.lit(operation == "rank").alias("descending"), F.lit(limit).alias("limit"), null.alias("year_basis"), F.lit(True).alias("require_year_basis"),
    )


def candidates(facts: DataFrame, revisions: DataFrame | None, scope: str = "nation", without: str = "ASIA", later: int = 30) -> DataFrame:
    """Candidates over metric, year, quarter, region, line type and one JSON key, ``scope``. Periods
    ``later`` years on, and those that are there, are asked for as missing ones."""
    fine = ("table_number", "metric_name", "year", "quarter", "region", "line_type", "scope")
    rows = active(facts, revisions).withColumn("scope", F.try_element_at("dimensions", F.lit(scope)))
    cells = written(rows.groupBy(*fine).agg(F.sum("value_numeric").alias("total")), "cells")  # one pass over the facts for all kinds
    metric, year, quarter = F.col("metric_name"), F.col("year"), F.col("quarter")
    label = T.question_label(metric)
    by = lambda *names: cells.groupBy("table_number", "metric_name", *names).agg(F.sum("total").alias("total"))
    of, at_year, at_quarter = _filter("metric_name", metric), _filter("year", year), _filter("quarter", quarter)
    period = {"label": label, "year": year, "quarter": quarter}
    lookup = reduce(lambda c, i: c.when((year + quarter) % 4 == i, _said(LOOKUPS[i], **period)), range(1, 4), F.when((year + quarter) % 4 == 0, _said(LOOKUPS[0], **period)))
    quarters, expected = by("year", "quarter"), F.col("total")
    parts = [
        _plan(quarters, "metric_lookup", "numeric", lookup, [of, at_year, at_quarter], expected=expected),
        _plan(by("year", "scope"), "scoped_aggregate", "numeric", _said(SCOPED, label=label, year=year, scope=F.col("scope")), [of, at_year, _filter(scope, F.col("scope"), json_key=True)], expected=expected),
        _plan(by("year", "quarter", "region", "line_type"), "split_lookup", "numeric", _said(SPLIT, **period, line=F.col("line_type"), tier=F.col("region")), [of, at_year, at_quarter, _filter("region", F.col("region")), _filter("line_type", F.col("line_type"))], expected=expected),
        _plan(by("year", "line_type"), "period_trend", "rows", _said(TREND, label=label, year=year, line=F.col("line_type")), [of, at_year, _filter("line_type", F.col("line_type"))], group_by=("quarter",), limit=8),
        _plan(quarters, "group_comparison", "rows", _said(COMPARISON, **period, tier=F.lit(without)), [of, at_year, at_quarter, _filter("region", F.lit(without), "ne")], group_by=("region",), operation="rank", limit=3),
        _plan(by("year"), "ranking", "rows", _said(RANKING, label=label, year=year), [of, at_year], group_by=("line_type",), operation="rank", aggregate="max", limit=3),
        *(_plan(quarters, "missing_value", "empty", _said(MISSING, label=label, year=year + n, quarter=quarter), [of, _filter("year", year + n), at_quarter]) for n in (0, later)),
        _plan(by("year"), "year_scope", "clarification", _said(OPEN_YEAR, label=label, year=year), [of, at_year], table=14),
    ]
    return reduce(DataFrame.unionByName, parts)


def verified(made: DataFrame, facts: DataFrame, revisions: DataFrame | None) -> DataFrame:
    """(kind, question, answer_kind, answer, groups, n_rows) of the candidates whose plans agree: one
    value that is the expected one; at least two rows; nothing at all; a refusal to guess. ``answer``
    is the first row's value."""
    plans = written(made.withColumn("verdict", verdict()), "candidates")
    rows = answers(plans.drop("kind", "answer_kind", "question", "expected", "verdict"), facts, revisions)
    found = rows.groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), F.sum("contributing").alias("contributing"), F.min_by("value", "place").alias("value"), F.transform(F.array_sort(F.collect_list(F.struct("place", "groups"))), lambda r: r["groups"]).alias("groups"))
    joined = plans.join(found, "plan_id", "left")
    close = F.abs(F.col("value") - F.col("expected")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(F.col("expected")))
    accepted, kind, none = F.col("verdict") == "accept", F.col("answer_kind"), F.coalesce("contributing", F.lit(0)) == 0
    keep = F.when(kind == "numeric", accepted & (F.col("n") == 1) & close).when(kind == "rows", accepted & (F.col("n") >= 2)).when(kind == "empty", accepted & none).otherwise(F.col("verdict") == "clarify")
    n = F.when(none, F.lit(0)).otherwise(F.col("n"))
    return joined.where(F.coalesce(keep, F.lit(False))).select("kind", "question", "answer_kind", F.col("value").alias("answer"), "groups", n.alias("n_rows"))
