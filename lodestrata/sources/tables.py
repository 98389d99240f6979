"""Cleaned tables as text columns, JSON lines, and paths of an object store."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.text import clean


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text with trimmed names; a byte order mark is dropped, quoted cells may
    hold line ends. The header's columns must differ."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    names = [c.lstrip("﻿").strip() for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"repeated columns in {path}: {names}")
    return df.toDF(*names)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a given schema; blank lines are skipped, broken ones fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def cleaned(df: DataFrame) -> DataFrame:
    return df.select(*(clean(F.col(f"`{c}`")).alias(c) for c in df.columns))


def without_raw(df: DataFrame) -> DataFrame:
    """Without the audit columns whose names end in _raw."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if not c.lower().endswith("_raw")))


def write_csv(df: DataFrame, path: str) -> None:
    """Text cells that a spreadsheet would take for a formula are quoted."""
    text = {c for c, t in df.dtypes if t == "string"}
    safe = [F.when(F.col(f"`{c}`").rlike("^[=+@-]"), F.concat(F.lit("'"), F.col(f"`{c}`"))).otherwise(F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`") for c in df.columns]
    df.select(*safe).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def safe_key(key: str) -> str:
    """A store key that stays below its prefix."""
    if not key or key.startswith("/") or ".." in key.split("/") or re.match(r"^[A-Za-z]:", key):
        raise ValueError(f"unsafe key {key!r}")
    return key


def is_safe_key(key: Column) -> Column:
    """``safe_key`` as a condition; a null key is not safe."""
    return F.coalesce((key != "") & ~key.rlike(r"^/|^[A-Za-z]:|(^|/)\.\.(/|$)"), F.lit(False))


def object_uri(root: str, key: Column) -> Column:
    """Address of a stored object below its root; an unsafe key fails the query."""
    return F.when(is_safe_key(key), F.concat(F.lit(root.rstrip("/") + "/"), key)).otherwise(F.raise_error(F.concat(F.lit("unsafe key "), F.coalesce(key, F.lit("null")))))
