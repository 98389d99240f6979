"""Contracts, revisions and merges."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAMILIES = ("long_metric", "wide_risk", "entity")


@dataclass(frozen=True)
class TableContract:
    """Which bucket owns each column of a cleaned table."""

    number: int
    family: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()  # personal data: never persisted
    value: str | None = None
    melt: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.family not in FAMILIES:
            raise ValueError(f"unknown family {self.family}")
        if clash := set(self.excluded) & {*self.required, *self.optional, *self.melt, self.value}:
            raise ValueError(f"excluded columns are also persisted: {sorted(clash)}")

    @property
    def persisted(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.required, *self.optional, *self.melt, *((self.value,) if self.value else ()))))

    def inventory(self, header: list[str]) -> dict[str, list[str]]:
        """Header columns by what becomes of them."""
        known = {*self.persisted, *self.excluded}
        return {
            "present": [c for c in header if c in self.persisted],
            "unknown": [c for c in header if c not in known],
            "missing_required": [c for c in self.required if c not in header],
            "missing_optional": [c for c in self.optional if c not in header],
            "excluded_present": [c for c in header if c in self.excluded],
        }

    def inventory_rows(self, rows: DataFrame, keys: str) -> DataFrame:
        """(bucket, column_name, n_rows): what becomes of the columns that the rows of a ragged table
        have, each row naming its own in the array ``keys``, and which the contract misses. Required
        columns that only some rows have are ``incomplete_required``."""
        n = rows.count()
        found = rows.select(F.explode(F.array_distinct(keys)).alias("column_name")).groupBy("column_name").agg(F.count(F.lit(1)).alias("n_rows"))
        known = [(c, "excluded" if c in self.excluded else "required" if c in self.required else "optional" if c in self.optional else "persisted") for c in dict.fromkeys((*self.persisted, *self.excluded))]
        stated = rows.sparkSession.createDataFrame(known, "column_name string, kind string")
        both = found.join(F.broadcast(stated), "column_name", "left").select("column_name", "kind", "n_rows").union(stated.join(found, "column_name", "left_anti").select("column_name", "kind", F.lit(0).cast("bigint")))
        missing, kind = F.col("n_rows") == 0, F.col("kind")
        bucket = (
            F.when(kind.isNull(), F.lit("unknown")).when(kind == "excluded", F.when(~missing, F.lit("excluded_present")))
            .when((kind == "required") & missing, F.lit("missing_required")).when((kind == "required") & (F.col("n_rows") < n), F.lit("incomplete_required"))
            .when(missing, F.when(kind == "optional", F.lit("missing_optional"))).otherwise(F.lit("present"))
        )
        return both.select(bucket.alias("bucket"), "column_name", "n_rows").where("bucket is not null")

    def load(self, rows: DataFrame) -> DataFrame:
        found = self.inventory(rows.columns)
        if found["missing_required"]:
            raise ValueError(f"table {self.number} lacks {found['missing_required']}")
        return rows.select(*(F.col(f"`{c}`") for c in found["present"]))


def one_row_each(df: DataFrame, key: str) -> DataFrame:
    """``df`` if ``key`` is unique in it; otherwise an error that names the first repeated values, before anything is written."""
    twice = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(key).limit(5).collect()
    if twice:
        raise ValueError(f"{key} repeats: {[r[0] for r in twice]}")
    return df


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and old rows whose key has none."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def signature(settings: dict) -> str:
    """Digest of all settings that change stored rows: SHA-256 of their JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def signed(df: DataFrame, settings: dict[str, Column], name: str = "signature") -> DataFrame:
    """The same digest per row, of settings that are columns; nulls stay in the JSON. Equal to
    ``signature`` for texts in ASCII, whole numbers and booleans."""
    values = F.struct(*(settings[k].alias(k) for k in sorted(settings)))
    return df.withColumn(name, F.sha2(F.to_json(values, {"ignoreNullFields": "false"}), 256))


def changed(sources: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Sources whose (hash, signature) is not registered as active."""
    done = registry.where("state = 'active'").select(key, "content_hash", "signature")
    return sources.join(done, [key, "content_hash", "signature"], "left_anti")


def activate(registry: DataFrame, source: str, revision: str) -> DataFrame:
    """States after the newest loaded revision of each source is activated: earlier active and
    staged ones are superseded, failed ones stay failed."""
    newest = registry.where("state in ('staging', 'active')").groupBy(source).agg(F.max(revision).alias("newest"))
    state = F.when(F.col("state") == "failed", F.lit("failed")).when(F.col(revision) == F.col("newest"), F.lit("active")).otherwise(F.lit("superseded"))
    return registry.join(newest, source, "left").withColumn("state", state).drop("newest")


def split_bad(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows with their reason."""
    marked = df.withColumn("error", error)
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def write_revision(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace only the partitions that ``df`` has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def reset(spark: SparkSession, tables: list[str], confirmed: bool = False) -> list[str]:
    """Drops those of the given tables that exist and names them; no other table is touched, and
    nothing is without ``confirmed``."""
    if not confirmed:
        raise ValueError("a reset drops tables: confirm it")
    found = [t for t in tables if spark.catalog.tableExists(t)]
    for t in found:
        spark.sql(f"DROP TABLE {t}")
    return found
