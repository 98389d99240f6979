"""Tabular cleaning: duplicates, lifecycles, revisions, crosswalks, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST, LAST = Window.unboundedPreceding, Window.currentRow


def forward_fill(df: DataFrame, column: str, order: list[str], within: list[str]) -> DataFrame:
    """Null cells take the last value above them (merged cells)."""
    w = Window.partitionBy(*within).orderBy(*order).rowsBetween(FIRST, LAST)
    return df.withColumn(f"{column}_filled", F.last(column, ignorenulls=True).over(w))


def exact_duplicates(df: DataFrame, fingerprint: list[str], order: list[str]) -> DataFrame:
    """duplicate_count and duplicate_index (from 1) of rows with equal fingerprints; nulls are equal."""
    w = Window.partitionBy(*fingerprint)
    return df.withColumn("duplicate_count", F.count(F.lit(1)).over(w)).withColumn("duplicate_index", F.row_number().over(w.orderBy(*order)))


def lifecycle(df: DataFrame, key: str, fingerprint: str, period: str) -> DataFrame:
    """Status of every (key, fingerprint, period): against the previous period there is, whose
    fingerprints of a key form a set. Periods are few; their dense numbers are joined as a
    broadcast while Spark measures them below its threshold."""
    rows = df.select(key, fingerprint, period).distinct()
    periods = rows.select(period).distinct().withColumn("n", F.row_number().over(Window.orderBy(period)))
    rows = rows.join(periods, period)
    of_key = rows.groupBy(key, "n").agg(F.collect_set(fingerprint).alias("fps"))
    spans = Window.partitionBy(key).orderBy("n")
    of_key = of_key.withColumn("before", F.lag("n").over(spans)).withColumn("fps_before", F.lag("fps").over(spans))
    status = (
        F.when(F.col("n") == 1, F.lit("first_available_snapshot"))
        .when(F.col("before").isNull(), F.lit("newly_seen"))
        .when(F.col("before") < F.col("n") - 1, F.lit("reappeared_after_gap"))
        .when(F.array_contains("fps_before", F.col(fingerprint)), F.lit("continued_unchanged"))
        .otherwise(F.lit("continued_with_attribute_change"))
    )
    return rows.join(of_key, [key, "n"]).select(key, fingerprint, period, status.alias("status"))


def lifecycle_summary(df: DataFrame, key: str, fingerprint: str, period: str) -> DataFrame:
    """First and last period, periods seen, and distinct fingerprints of each key as text."""
    return df.groupBy(key).agg(
        F.min(period).alias("first_seen"),
        F.max(period).alias("last_seen"),
        F.count_distinct(period).alias("periods_observed"),
        F.array_join(F.sort_array(F.collect_set(fingerprint)), ";").alias("variants"),
    )


def revision_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """added, removed, changed or unchanged per key, the changed columns' names, and each delta."""
    o = old.select(key, F.lit(1).alias("in_old"), *(F.col(c).alias(f"{c}_old") for c in columns))
    n = new.select(key, F.lit(1).alias("in_new"), *(F.col(c).alias(f"{c}_new") for c in columns))
    both = o.join(n, key, "full_outer")
    named = F.array(*(F.when(~F.col(f"{c}_old").eqNullSafe(F.col(f"{c}_new")), F.lit(c)) for c in columns))
    changed = F.filter(named, lambda x: x.isNotNull())
    status = F.when(F.col("in_old").isNull(), F.lit("added")).when(F.col("in_new").isNull(), F.lit("removed")).when(F.size(changed) > 0, F.lit("changed")).otherwise(F.lit("unchanged"))
    deltas = [(F.col(f"{c}_new") - F.col(f"{c}_old")).alias(f"{c}_delta") for c in columns]
    return both.select(key, status.alias("status"), F.when(status == "changed", F.array_join(changed, ";")).alias("changed_fields"), *deltas)


def strict_sum(value: Column) -> Column:
    """A sum that is null as soon as one part is."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def melt(df: DataFrame, ids: list[str], measures: list[str]) -> DataFrame:
    """Wide to long; null measures stay as rows."""
    return df.unpivot(ids, measures, "measure_name", "value")


def check(total: Column, expected: Column, tolerance: float = 1e-6) -> Column:
    close = F.abs(total - expected) <= tolerance * F.greatest(F.lit(1.0), F.abs(total), F.abs(expected))
    return F.when(total.isNull() | expected.isNull(), F.lit("not_testable_due_to_blank")).when(close, F.lit("reconciled")).otherwise(F.lit("mismatch"))


def component_status(total: Column, parts: Column, n_parts: Column, tolerance: float = 1e-6) -> Column:
    """Total against the sum of its parts, four ways."""
    close = F.abs(total - parts) <= tolerance * F.greatest(F.lit(1.0), F.abs(total), F.abs(parts))
    return F.when(total.isNull(), F.lit("total_missing")).when(n_parts == 0, F.lit("components_missing")).when(close, F.lit("reconciled")).otherwise(F.lit("residual"))


def overlay(base: DataFrame, amendments: DataFrame, removed: DataFrame, key: str, column: str) -> DataFrame:
    """Base values, amended where an amendment has one, plus what is new, without what is removed."""
    a = amendments.select(key, F.col(column).alias("amended"))
    merged = base.select(key, F.col(column).alias("base")).join(a, key, "full_outer")
    origin = F.when(F.col("base").isNull(), F.lit("new")).when(F.col("amended").isNotNull(), F.lit("amended")).otherwise(F.lit("baseline"))
    return merged.join(removed.select(key), key, "left_anti").select(key, F.coalesce("amended", "base").alias(column), origin.alias("origin"))


def crosswalk(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Null-safe join of two schemas on a semantic key, with whether the key is unique on each side."""
    o = old.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_old"), F.min(value).alias("old_value"))
    n = new.groupBy(*(F.col(k).alias(f"{k}_new") for k in keys)).agg(F.count(F.lit(1)).alias("n_new"), F.min(value).alias("new_value"))
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"{k}_new"))
        on = same if on is None else on & same
    both = o.join(n, on, "inner")
    status = F.when((F.col("n_old") == 1) & (F.col("n_new") == 1), F.lit("one_to_one")).otherwise(F.lit("ambiguous"))
    return both.select(*keys, "old_value", "new_value", status.alias("crosswalk_status"))
