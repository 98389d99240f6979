"""Shared plumbing: the scratch folder all executors see, materialised tables, text bytes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only if that is unset on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="lodestrata-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return "file://" + _own_root[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's scratch folder, which goes when the application ends."""
    folder = f"{shared_root(spark)}/lodestrata-{spark.sparkContext.applicationId}"
    hpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.mkdirs(hpath):
        fs.deleteOnExit(hpath)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, so a lost
    executor costs a re-read and not a re-computation."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files behind tables that materialize() made, once nothing reads them any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/lodestrata-" in f}:
            delete_path(df.sparkSession, path)


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_key(doc_id: Column) -> list[Column]:
    """An id as two columns that are never null, for joins in which null equals null."""
    return [F.coalesce(doc_id.cast("long"), F.lit(0)), doc_id.isNull()]


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


#: Words of 64 bits in the largest filter that without() broadcasts (about 60 MB as a hash table).
FILTER_WORDS = 1 << 20


def without(docs: DataFrame, drop: DataFrame, keys: list[Column]) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` (never null) are no row of ``drop``, which has the same
    keys in the same order and is a written table.

    A filter of one hash per key, a table of 64-bit words of bounded size, goes to every task and
    tells what surely stays; those rows are not shuffled. Only what may be dropped meets ``drop``
    in an anti-join on all keys, which is exact. With far more keys than the filter has bits it
    lets everything through to the join, and the result is the same."""
    n = drop.count()
    if not n:
        return docs
    words = min(FILTER_WORDS, 1 << max(6, (n // 2).bit_length()))
    tag = f"k{uuid.uuid4().hex}"
    slot, word, bits, names = f"{tag}_slot", f"{tag}_word", f"{tag}_bits", [f"{tag}_{i}" for i in range(len(keys))]
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(words * 64))
    drop = drop.toDF(*names)
    filled = drop.select(place(F.col(names[0])).alias(slot)).groupBy(F.expr(f"shiftright({slot}, 6)").alias(word)).agg(F.expr(f"bit_or(shiftleft(1L, cast({slot} & 63 as int)))").alias(bits))
    probed = docs.withColumn(slot, place(keys[0])).withColumn(word, F.expr(f"shiftright({slot}, 6)")).join(F.broadcast(filled), word, "left")
    perhaps = F.expr(f"coalesce(shiftright({bits}, cast({slot} & 63 as int)) & 1 = 1, false)")
    own = [quoted(c) for c in docs.columns]
    stays = probed.where(~perhaps).select(*own)
    rest = probed.where(perhaps).withColumns(dict(zip(names, keys, strict=True))).join(drop, names, "left_anti").select(*own)
    return stays.union(rest)


def hash_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most ``n`` rows of ``df``, those with the smallest hashes of ``keys``. Rows are thinned
    by hash before they are ordered, so no task orders more than a few times ``n``."""
    total = df.count()
    if total > 4 * n:
        df = df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int((1 << 30) * (2 * n / total)))
    return df.orderBy(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)), *keys).limit(n)


def numbers(values: list[float]) -> Column:
    """A constant array of doubles, as one literal whatever its length."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>") if len(values) else F.array().cast("array<double>")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches in parts, so that a worker holds the Python objects of a few rows only."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, nulls as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


#: Every byte that is not part of a word becomes a space, A-Z become a-z; bytes from 0x80 up are word bytes.
WORD_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def pieces(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """``data`` (words separated by ASCII white space) in pieces of about ``size`` bytes that cut no word."""
    at, n = 0, len(data)
    while n - at > size:
        cut = at + size
        m = _SPACE.search(data, cut)
        cut = m.start() if m else n
        yield data[at:cut]
        at = cut
    yield data[at:]


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def words_of(data: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return data.translate(WORD_TABLE).split()


def fold(doc_id: Column) -> Column:
    """crc32 of the id's text modulo 3; rows at 1 are held out of every fit."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 1
