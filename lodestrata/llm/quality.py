"""Quality by hierarchical empirical Bayes.

A classifier of surface features gives each document its evidence. Summed over all documents of
a site (``host``) and of a part of a site (``path``), evidence gives counts of expected good
documents; a Beta prior whose strength is fitted by moments to the spread between sites shrinks
sparse sites toward the global rate, and sparse paths toward their site. The final odds are the
document's likelihood ratio, its evidence against the share of good labels the classifier was
fitted with, times the prior odds of its path, in whose sums and whose site's the document itself
is left out: its evidence counts once.

Labels are learnt only from rows whose crc32(doc_id) mod 3 is not 1. Defined cases: null texts
count as empty; texts of any length are read whole; null host or path is a site or path of its
own; a document alone on its site has the global rate as its prior; null or unknown labels are
ignored, of several labels of one document the lowest counts; with labels of one class only,
evidence is neutral; repeated rows each get their row; empty tables give an empty result; extra
columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, discard, hash_sample, held_out, materialize, slices

MAX_LABELLED = 20_000
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "shout": b"!?", "symbol": b"#$%&*^~<>{}[]\\=+_@",
    "bar": b"|", "stop": b".,;:", "space": b" \t", "line": b"\n", "other": bytes(range(0x80, 0x100)),
}
_OF = np.full(256, len(CLASSES))
for _k, _chars in enumerate(CLASSES.values()):
    _OF[list(_chars)] = _k
N_FEATURES = 2 * len(CLASSES) + 5


def surface(data: bytes) -> list[float]:
    """Shares of byte classes and their square roots, length, word length, repeated words and lines."""
    n = max(1, len(data))
    by_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = (np.bincount(_OF, by_byte, len(CLASSES) + 1) / n)[: len(CLASSES)]
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    return [*share, *np.sqrt(share), math.log(n), math.log1p(n / max(1, len(words))), len(set(words)) / max(1, len(words)), len(set(lines)) / max(1, len(lines)), math.log1p(len(words) / max(1, len(lines)))]


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton steps on standardised features; (mean, scale, weights with bias last)."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + l2 * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + l2 * np.eye(len(w)), g)
        w -= step * min(1.0, 5.0 / (np.linalg.norm(step) + 1e-9))
    return mean, scale, w


def evidence(docs: DataFrame, labels: DataFrame, host: Column, path: Column, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, float]:
    """doc_id, host, path, p (classifier's probability of good quality) for every row, and the share of good labels in the fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = pa.array([surface(t) for t in as_bytes(batch.column("text"))], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], x], names=["doc_id", "host", "path", "x"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    rows = materialize(rows.mapInArrow(run, "doc_id long, host string, path string, x array<float>"), "surface")
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where(~held_out(F.col("doc_id")))
    known = materialize(known.join(rows.select("doc_id").distinct(), "doc_id", "left_semi"), "known")
    sample = materialize(hash_sample(known, max_labelled, "doc_id"), "sample")
    fit_rows = rows.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").select("x", "quality").collect()  # at most max_labelled
    y = np.array([r["quality"] for r in fit_rows], float)
    if len(set(y.tolist())) == 2:
        mean, scale, w = fit_logistic(np.array([r["x"] for r in fit_rows], float), y)
    else:
        mean, scale, w = np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES + 1)
    good = float(y.mean()) if 0 < y.sum() < len(y) else 0.5
    discard(known, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
            z = (x - mean) / scale @ w[:-1] + w[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "host", "path", "p"])

    return rows.mapInArrow(score, "doc_id long, host string, path string, p double"), good


def _strength(groups: DataFrame, mean: Column, n: Column, good: Column) -> float:
    """Prior strength by moments: how many documents the prior counts as, from the spread of
    group rates beyond what chance explains; between 2 and 1e6."""
    r = groups.where(n >= 2).agg(F.sum(n), F.sum(n * F.pow(good / n - mean, 2)), F.count(F.lit(1)), F.sum(n * mean * (1 - mean)), F.sum(F.pow(n, 2))).first()
    if not r[0] or r[2] < 2:
        return 10.0
    within = r[3] / r[0]
    between = (r[1] - (r[2] - 1) * within) / max(1e-9, r[0] - r[4] / r[0])
    return min(1e6, max(2.0, within / between - 1)) if between > 0 else 1e6


def score_quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """doc_id, held_out, evidence, host_rate, path_rate, score, predicted for every row."""
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    rows, good = evidence(docs, labels, host, path)
    rows = materialize(rows, "evidence")
    paths = materialize(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("good")), "paths")
    total = paths.agg(F.sum("good") / F.sum("n")).first()[0]
    total = 0.5 if total is None else min(1 - 1e-6, max(1e-6, total))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    kappa = _strength(hosts, F.lit(total), F.col("host_n"), F.col("host_good"))
    paths = materialize(paths.join(hosts.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).drop("of").withColumn("host_rate", (F.col("host_good") + kappa * total) / (F.col("host_n") + kappa)), "rates")
    below = _strength(paths, F.col("host_rate"), F.col("n"), F.col("good"))
    sums = paths.select(F.col("host").alias("h"), F.col("path").alias("q"), "n", "good", "host_n", "host_good")
    out = rows.join(sums, rows["host"].eqNullSafe(sums["h"]) & rows["path"].eqNullSafe(sums["q"]), "left")
    # without the document's own evidence
    out = out.withColumn("host_rate", (F.col("host_good") - F.col("p") + kappa * total) / (F.col("host_n") - 1 + kappa))
    out = out.withColumn("path_rate", (F.col("good") - F.col("p") + below * F.col("host_rate")) / (F.col("n") - 1 + below))
    logit = lambda p: F.log(p / (1 - p))
    safe = lambda c: F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col(c)))
    score = 1 / (1 + F.exp(-(logit(safe("p")) - F.lit(math.log(good / (1 - good))) + logit(safe("path_rate")))))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p").alias("evidence"), "host_rate", "path_rate", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
