"""Exact deduplication against a persistent digest index.

The index is Parquet tables bucketed and sorted by digest, a generation for each batch and merged
ones. A batch is reduced to one row per digest (map-side combined, so a text that holds a third of
all rows is one row per task), that reduced set is anti-joined with every generation by
sort-merge, in the order that its files have, and what is new is appended as a generation. Rows then look up their digest's entry; digests with many rows go through a broadcast
of at most ``1 / HOT_SHARE`` entries, all others through a sort-merge join.

A batch has a name, the caller's or one made of its ids and digests. Entries that carry the
batch's own name count as its own, so a batch that is added once more, after a crash or by a
retry, keeps the rows that it kept before and appends nothing twice.

Defined cases: null text counts as empty; a null doc_id loses to any other; of rows that repeat
id and text exactly one is kept, any of them where their other columns differ; ties of ids are
settled by the order of reading; texts of any length are hashed whole; an empty table gives an
empty result; extra columns are never read, and no column name of theirs clashes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, discard, id_key, materialize, quoted, scratch_path, without

#: Generations of one size that are merged; buckets at least, and entries of a bucket about.
FAN, LEAST_BUCKETS, BUCKET_ROWS = 8, 64, 1 << 20
#: A digest with at least this share of a batch's rows is hot; so at most 1 / HOT_SHARE are.
HOT_SHARE = 1e-3


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made here trust the order of buckets that are one file each."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class DigestIndex:
    """Generations of tables over files at ``path``; an existing path is opened again. Without a path
    the index lives in the scratch folder and goes with ``close``, which otherwise only forgets the
    tables' names in the session's catalog.

    Every batch adds a generation, bucketed and sorted by digest with one file a bucket, which no later
    batch touches; FAN generations of one size are merged into one. A folder's name has the first and
    last batch that it holds: one that is not finished, or whose batches a finished one holds
    as well, is not read, so a crash in a merge or an append changes nothing."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.own, self.path = spark, path is None, (path or scratch_path(spark, "digests")).rstrip("/")
        if not re.fullmatch(r"[^'\\]+", self.path):
            raise ValueError("the index path must not hold quotes or backslashes")
        self.buckets, self.generations, self.name = buckets, {}, f"digests_{uuid.uuid4().hex}"
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [f.getPath() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        names = {m.groups(): f for f in found if (m := re.fullmatch(r"batches-(\d+)-(\d+)-(\d+)-\w+", f.getName())) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))}
        spans = {(int(a), int(b)): (int(n), f) for (a, b, n), f in names.items()}
        for (a, b), (n, f) in sorted(spans.items()):
            if not any(x <= a and b <= y and (x, y) != (a, b) for x, y in spans):
                self._name(a, b, n, f"{self.path}/{f.getName()}")

    def _name(self, first: int, last: int, buckets: int, path: str) -> None:
        name = f"{self.name}_{first}_{last}"
        self.spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, n_rows BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        self.generations[first, last] = (name, path)

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        for name, _ in self.generations.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.generations = {}
        if self.own:
            delete_path(self.spark, self.path)

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for _, (name, _) in sorted(self.generations.items())]

    def rows(self) -> DataFrame:
        none = self.spark.createDataFrame([], "digest binary, keep_id long, n_rows long, batch string")
        return reduce(DataFrame.union, self.tables(), none)

    def _append(self, entries: DataFrame, n: int, first: int, last: int) -> None:
        """Write a generation of about ``n`` entries."""
        buckets = self.buckets or max(LEAST_BUCKETS, 1 << max(0, (n // BUCKET_ROWS).bit_length()))
        name, path = f"{self.name}_{first}_{last}", f"{self.path}/batches-{first:08d}-{last:08d}-{buckets}-{uuid.uuid4().hex}"
        entries.repartition(buckets, "digest").sortWithinPartitions("digest").write.format("parquet").option("path", path).bucketBy(buckets, "digest").sortBy("digest").saveAsTable(name)
        self.generations[first, last] = (name, path)

    def _merge(self) -> None:
        """Of the newest generations, FAN that hold equally many batches become one."""
        while True:
            newest = sorted(self.generations, reverse=True)[:FAN]
            if len(newest) < FAN or len({b - a for a, b in newest}) > 1:
                return
            old = [self.generations.pop(k) for k in newest]
            every = self.spark.read.parquet(*(path for _, path in old))  # as plain files, so that buckets are dealt anew, one file each
            self._append(every, every.count(), newest[-1][0], newest[0][1])
            for name, path in old:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                delete_path(self.spark, path)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Append what is new in ``docs``; returns one row per row of ``docs``: doc_id, keep_id,
        group_size (rows of this batch with that text), kept, digest. The result does not read
        the index, which may be closed."""
        return self._place(docs, id_col, text_col, batch).drop("here")

    def _place(self, docs: DataFrame, id_col: str, text_col: str, batch: str | None) -> DataFrame:
        """As add, with ``here``: whether the row that stays is in this batch."""
        seen = materialize(docs.select(quoted(id_col).cast("long").alias("doc_id"), digest(quoted(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
        n, sign = seen.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("doc_id", "digest", F.hash("digest", "doc_id")))).first()
        batch = f"content:{n}:{sign}" if batch is None else f"named:{batch}"
        groups = seen.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))
        groups = materialize(groups.select("digest", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("first_row"), "group_size"), "groups")
        own = F.lit(batch).alias("batch")
        with _sorted_scans(self.spark):
            new = reduce(lambda left, table: left.join(table.hint("merge"), "digest", "left_anti"), self.tables(), groups)
            last = max((b for _, b in self.generations), default=0) + 1
            self._append(new.select("digest", F.col("first_id").alias("keep_id"), F.col("group_size").alias("n_rows"), own), n, last, last)
            found = [groups.join(table.hint("merge"), "digest").select("digest", "keep_id", "group_size", F.when(F.col("batch") == own, F.col("first_row")).alias("kept_row")) for table in self.tables()]  # a digest is in one generation
            known = materialize(reduce(DataFrame.union, found), "known")
            self._merge()
        discard(groups)
        at_least = max(2, int(n * HOT_SHARE))
        hot = known.where(F.col("group_size") > at_least)  # fewer than 1 / HOT_SHARE rows, by its own condition
        marked = seen.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "digest", "left")
        out = ("doc_id", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("kept_row"), F.lit(False)).alias("kept"), "digest", F.col("kept_row").isNotNull().alias("here"))
        rest = seen.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(known.where(F.col("group_size") <= at_least).hint("merge"), "digest")
        return rest.select(*out).union(marked.where("hot").select(*out))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Only rows that may be dropped are
    shuffled, on (id, digest), which no group of copies makes uneven."""
    own = index or DigestIndex(docs.sparkSession)
    placed = own._place(docs, id_col, text_col, batch).where("not kept")
    again = F.col("here") & F.col("doc_id").eqNullSafe(F.col("keep_id"))  # the row that stays comes more than once
    gone = materialize(placed.select(*(k.alias(n) for k, n in zip(id_key(F.col("doc_id")), ("id", "no_id"), strict=True)), "digest", again.alias("again")).distinct(), "gone")
    if index is None:
        own.close()
    keys = [*id_key(quoted(id_col)), digest(quoted(text_col))]
    kept = without(docs, gone.drop("again"), keys)
    twice = gone.where("again").drop("again")
    if twice.isEmpty():
        return kept
    names = [f"k{uuid.uuid4().hex}_{i}" for i in range(3)]
    once = docs.withColumns(dict(zip(names, keys, strict=True))).join(twice.toDF(*names), names, "left_semi").dropDuplicates(names)
    return kept.union(once.select(*(quoted(c) for c in docs.columns)))
