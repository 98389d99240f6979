"""Revisions of sources, published by an append-only manifest, and objects by key.

A revision is staged first: its rows go to a folder of their own, and nothing refers to it. It
becomes active by one entry in its source's manifest, numbered one after the last and put there
only if no such entry exists, so of two writers one wins. Readers resolve the active revision
from the highest entry; a crash between staging and commit leaves the old one. A run that fails
leaves a record with its error. Nothing is updated in place.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.tables import is_safe_key, safe_key
from lodestrata.sources.workbook import store_of

#: Fixed value: characters of an error that are kept.
SUMMARY_CHARS = 2000


class Conflict(RuntimeError):
    """Another writer has committed this entry."""


class Folder:
    """Small files of one folder, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.hadoop = spark._jsc.hadoopConfiguration()
        self.fs = self._of(self.path).getFileSystem(self.hadoop)

    def _of(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def put_if_absent(self, name: str, text: str) -> None:
        """Written aside, then renamed without overwriting: the rename fails if the name is taken."""
        target, staged = self._of(f"{self.path}/{name}"), self._of(f"{self.path}/.{uuid.uuid4().hex}")
        out = self.fs.create(staged, False)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.isAbsoluteAndSchemeAuthorityNull() is False else self.fs.getUri(), self.hadoop)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self.fs.makeQualified(staged), self.fs.makeQualified(target), options)
        except Exception as x:
            self.fs.delete(staged, False)
            if "FileAlreadyExists" in str(x):
                raise Conflict(name) from None
            raise

    def names(self) -> list[str]:
        folder = self._of(self.path)
        found = self.fs.listStatus(folder) if self.fs.exists(folder) else []
        return sorted(n for n in (f.getPath().getName() for f in found) if not n.startswith("."))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._of(f"{self.path}/{name}"))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def delete(self) -> bool:
        return self.fs.delete(self._of(self.path), True)


class Publisher:
    """Revisions below ``root``, by source (a safe key)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _manifest(self, source: str) -> Folder:
        return Folder(self.spark, f"{self.root}/manifest/{safe_key(source)}")

    def entries(self, source: str) -> list[dict]:
        """Committed entries of a source, oldest first."""
        folder = self._manifest(source)
        return [json.loads(folder.read(n)) for n in folder.names()]

    def stage(self, source: str, df: DataFrame) -> dict:
        """The rows in a folder of their own, and what a commit needs to know of them."""
        path = f"{self.root}/data/{safe_key(source)}/{uuid.uuid4().hex}"
        after = len(self._manifest(source).names())
        df.write.parquet(path)
        rows = self.spark.read.parquet(path).count()
        return {"source": source, "path": path, "rows": rows, "after": after}

    def commit(self, staged: dict, content_hash: str = "", signature: str = "") -> dict:
        """Make a staged revision the active one; ``Conflict`` if another was committed since it was staged."""
        entry = {"source": staged["source"], "revision": staged["after"] + 1, "path": staged["path"], "rows": staged["rows"], "content_hash": content_hash, "signature": signature}
        self._manifest(staged["source"]).put_if_absent(f"{entry['revision']:09d}.json", json.dumps(entry, sort_keys=True))
        return entry

    def publish(self, source: str, df: DataFrame, content_hash: str = "", signature: str = "", check: Callable[[DataFrame], str | None] | None = None) -> dict:
        """Stage, check, commit. The same content by the same signature is not loaded again. ``check``
        gets the staged rows and returns what is wrong with them, or none. Whatever fails is
        recorded, with the beginning of its error, and raised."""
        last = (self.entries(source) or [None])[-1]
        if last and content_hash and (last["content_hash"], last["signature"]) == (content_hash, signature):
            return last | {"skipped": True}
        staged = None
        try:
            staged = self.stage(source, df)
            if check and (wrong := check(self.spark.read.parquet(staged["path"]))):
                raise ValueError(wrong)
            return self.commit(staged, content_hash, signature)
        except Exception as x:
            record = {"source": source, "path": staged and staged["path"], "error": str(x)[:SUMMARY_CHARS]}
            Folder(self.spark, f"{self.root}/failed").put_if_absent(f"{uuid.uuid4().hex}.json", json.dumps(record))
            raise

    def active(self, source: str) -> DataFrame:
        """The rows of a source's active revision."""
        entries = self.entries(source)
        if not entries:
            raise LookupError(f"no revision of {source!r} is active")
        return self.spark.read.parquet(entries[-1]["path"])

    def registry(self) -> DataFrame:
        """(source, revision, state, rows, path, error): a source's last entry is active, earlier ones
        are superseded, runs that failed have no revision."""
        entries = self._json("manifest/*", "source string, revision bigint, path string, rows bigint")
        newest = entries.groupBy("source").agg(F.max("revision").alias("newest"))
        state = F.when(F.col("revision") == F.col("newest"), F.lit("active")).otherwise(F.lit("superseded"))
        done = entries.join(newest, "source").select("source", "revision", state.alias("state"), "rows", "path", F.lit(None).cast("string").alias("error"))
        failed = self._json("failed", "source string, path string, error string")
        return done.union(failed.select("source", F.lit(None).cast("bigint"), F.lit("failed"), F.lit(None).cast("bigint"), "path", "error"))

    def _json(self, folder: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}/*.json")
        if not (path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(str(path))


class ObjectStore:
    """Objects below ``root`` by safe keys."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def uri(self, key: str) -> str:
        return f"{self.root}/{safe_key(key)}"

    def put(self, objects: DataFrame) -> DataFrame:
        """Write (key, content) rows from the executors; returns (key, uri, size). An unsafe key fails the query
        before anything of its row is written; a row that is written again replaces its object."""
        root = self.root
        checked = objects.select(F.when(is_safe_key(F.col("key")), F.col("key")).otherwise(F.raise_error(F.concat(F.lit("unsafe key "), F.coalesce("key", F.lit("null"))))).alias("key"), F.coalesce(F.col("content"), F.lit(b"")).alias("content"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, base = store_of(root)
            for batch in batches:
                done = []
                for key, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    target = f"{base}/{key}"
                    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    with store.open_output_stream(target) as out:
                        out.write(content)
                    done.append((key, f"{root}/{key}", len(content)))
                yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["key", "uri", "size"])

        return checked.mapInArrow(run, "key string, uri string, size bigint")

    def read(self, prefix: str = "") -> DataFrame:
        """(key, size, content) of all objects below a prefix that hold anything: Spark skips empty files."""
        folder = self.uri(prefix) if prefix else self.root
        rows = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        plain = re.sub("^[a-z0-9]+:(//[^/]*)?", "", self.root)
        return rows.select(F.regexp_extract("path", re.escape(plain) + "/(.*)$", 1).alias("key"), F.col("length").alias("size"), "content")

    def clear_prefix(self, prefix: str) -> bool:
        """Delete all objects below a prefix; the root itself never."""
        key = safe_key(prefix.strip("/") if not prefix.startswith("/") else prefix)
        if not [p for p in key.split("/") if p not in ("", ".")]:
            raise ValueError(f"refusing to clear {prefix!r}")
        return Folder(self.spark, f"{self.root}/{key}").delete()
