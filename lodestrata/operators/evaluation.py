"""Retrieval metrics, calibration, folds and gates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.sources.scratch import written


def ir_metrics(judged: DataFrame, k: int) -> DataFrame:
    """Per question from (question_id, rank, gold, n_gold): hit at 1, recall, reciprocal rank and
    nDCG at k, and the first gold rank."""
    top = F.col("rank") <= k
    gain = F.sum(F.when(F.col("gold") & top, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0))
    n = F.max("n_gold")
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(k)).cast("int")), lambda i: 1 / F.log2(i + 1.0)), F.lit(0.0), lambda a, v: a + v)
    first = F.min(F.when(F.col("gold"), F.col("rank")))
    return judged.groupBy("question_id").agg(
        F.count_if(F.col("gold") & (F.col("rank") == 1)).alias("hit_at_1"),
        F.try_divide(F.count_if(F.col("gold") & top).cast("double"), n).alias("recall"),
        F.when(first <= k, 1.0 / first).otherwise(0.0).alias("mrr"),
        F.when(n > 0, gain / ideal).otherwise(0.0).alias("ndcg"),
        first.alias("first_gold_rank"),
    )


def totals_before(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows that come before in ``order`` (distinct
    values). Rows are dealt in ranges; each range is summed on its own, and the ranges' offsets,
    one number each, are added from a broadcast. No task orders more than its range."""
    ranges = written(rows.repartitionByRange(order).withColumn("range_no", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("range_no").agg(F.sum(value).alias("total")).orderBy("range_no").collect()  # a row a range
    offsets, so_far = [], 0
    for r in sums:
        offsets.append((r["range_no"], so_far))
        so_far += r["total"] or 0
    kind = ranges.select(F.sum(value).alias("total")).schema["total"].dataType.simpleString()
    base = rows.sparkSession.createDataFrame(offsets, f"range_no int, offset {kind}")
    inside = F.sum(value).over(Window.partitionBy("range_no").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return ranges.withColumn(name, inside).join(F.broadcast(base), "range_no").withColumn(name, F.coalesce(name, F.lit(0)) + F.col("offset")).drop("range_no", "offset")


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: area under the curve, tied scores counting half. Scores are counted per distinct
    value first; what lies below a value comes from sums over ranges of values. Rows without a score
    or label do not count."""
    sound = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    values = sound.groupBy(score).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    below = totals_before(values, score, "neg", "below")
    return below.withColumn("wins", F.col("pos") * (F.col("below") + F.col("neg") / 2)).agg(F.try_divide(F.sum("wins"), (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


#: Groups that are fitted at once, two numbers each on the driver, and rows of counts that one task sums.
MOST_CURVES, FEW_COUNTS = 10_000, 100_000


def _gradients_here(points: list) -> Callable:
    g, x, y, w = (np.array([r[c] for r in points], "f8") for c in ("g", "x", "y", "w"))
    g = g.astype("i8")

    def step(a: list[float], b: list[float]) -> list[tuple[int, float, float]]:
        error = w * (1 / (1 + np.exp(-np.clip(np.array(a)[g] * x + np.array(b)[g], -60, 60))) - y)
        return list(zip(range(len(a)), np.bincount(g, error * x, len(a)).tolist(), np.bincount(g, error, len(a)).tolist(), strict=True))

    return step


def _gradients(points: DataFrame) -> Callable:
    def step(a: list[float], b: list[float]) -> list[tuple[int, float, float]]:
        held = F.split(F.lit(",".join(map(repr, [*a, *b]))), ",").cast("array<double>")  # one constant: every step runs the same compiled code
        z = F.get(held, F.col("g")) * F.col("x") + F.get(held, F.col("g") + len(a))
        error = F.col("w") * (1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z)))) - F.col("y"))
        return [tuple(r) for r in points.groupBy("g").agg(F.sum(error * F.col("x")), F.sum(error)).collect()]

    return step


def platt_curves(df: DataFrame, group: str, score: str, label: str, steps: int = 400, rate: float = 0.05) -> DataFrame:
    """(group, a, b, positives, negatives) of sigmoid(a * score + b) per group by class-balanced
    gradient descent; a group with one class keeps its raw scores (a null). The counts give back the
    base rate that balancing leaves out.

    Scores are counted per group and value once. At most FEW_COUNTS counts are summed on the driver;
    with more, a step is one grouped sum over them, and only two numbers a group come to the driver.
    Rows without group, score or label do not count."""
    spark = df.sparkSession
    sound = df.where(F.col(group).isNotNull() & F.col(score).isNotNull() & F.col(label).isNotNull())
    counted = sound.groupBy(F.col(group).alias("of"), F.col(score).cast("double").alias("x"), F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    counted = written(counted, "counts")
    kind = counted.schema["of"].dataType.simpleString()
    sizes = counted.groupBy("of").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 1, 0).otherwise(F.col("n"))).alias("neg"))
    groups = sizes.limit(MOST_CURVES + 1).collect()
    if len(groups) > MOST_CURVES:
        raise ValueError(f"more than {MOST_CURVES} groups to fit")
    fitted = [r for r in groups if r["pos"] and r["neg"]]
    numbers = spark.createDataFrame([(r["of"], i, 0.5 / r["pos"], 0.5 / r["neg"]) for i, r in enumerate(fitted)], f"of {kind}, g int, of_pos double, of_neg double")
    weight = F.col("n") * F.when(F.col("y") == 1, F.col("of_pos")).otherwise(F.col("of_neg"))
    points = counted.join(F.broadcast(numbers), "of").select("g", "x", "y", weight.alias("w"))
    few = counted.limit(FEW_COUNTS + 1).count() <= FEW_COUNTS
    gradient = _gradients_here(points.collect()) if few else _gradients(written(points, "points"))
    a, b = [1.0] * len(fitted), [0.0] * len(fitted)
    for _ in range(steps if fitted else 0):
        for g, da, db in gradient(a, b):
            a[g] -= rate * da
            b[g] -= rate * db
    at = {r["of"]: i for i, r in enumerate(fitted)}
    rows = [(r["of"], a[at[r["of"]]] if r["of"] in at else None, b[at[r["of"]]] if r["of"] in at else None, r["pos"], r["neg"]) for r in groups]
    return spark.createDataFrame(rows, f"`{group}` {kind}, a double, b double, positives bigint, negatives bigint")


def platt(score: Column, a: Column, b: Column, positives: Column | None = None, negatives: Column | None = None) -> Column:
    """The calibrated probability. With the counts of the fit the balanced posterior is brought
    back to the base rate, so that types of unequal rarity can be compared."""
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), a * score + b))
    p = 1 / (1 + F.exp(-z))
    if positives is not None:
        rate = F.try_divide(positives.cast("double"), positives + negatives)
        p = F.when((rate > 0) & (rate < 1), p * rate / (p * rate + (1 - p) * (1 - rate))).otherwise(p)
    return F.when(a.isNull() | F.isnan(a), score).otherwise(p)


def citation_scores(cited: Column, expected: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and exact match of distinct ids."""
    c, e = F.array_distinct(cited), F.array_distinct(expected)
    both = F.size(F.array_intersect(c, e)).cast("double")
    return F.coalesce(F.try_divide(both, F.size(c)), F.lit(0.0)), F.coalesce(F.try_divide(both, F.size(e)), F.lit(0.0)), F.array_sort(c) == F.array_sort(e)
