"""Tables of a database: partitioned reads, and bulk writes through a staging table.

A read measures the bounds of its key first, in the database, and is split by them. A write goes in
batches to a staging table, by as many connections as the rows have partitions; then one MERGE
moves it into its target, so a run that is repeated, or begun again after a crash, adds nothing.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.scratch import delete, new_path, shared_folder

#: Fixed value: rows of one batch.
BATCH = 1000


class Database:
    def __init__(self, spark: SparkSession, url: str, properties: dict[str, str] | None = None) -> None:
        self.spark, self.url, self.properties = spark, url, dict(properties or {})

    def query(self, sql: str) -> DataFrame:
        """The rows of a query that the database runs."""
        return self.spark.read.format("jdbc").option("url", self.url).option("query", sql).options(**self.properties).load()

    def table(self, name: str, key: str | None = None, partitions: int = 1, fetch: int = 10_000) -> DataFrame:
        """A table, read in ranges of a whole-number key; rows without a key are in the first range.
        Filters and columns are pushed down."""
        reader = self.spark.read.format("jdbc").option("url", self.url).option("dbtable", name).option("fetchsize", fetch).options(**self.properties)
        if key and partitions > 1:
            low, high, n = self.query(f"SELECT min({key}) AS low, max({key}) AS high, count({key}) AS n FROM {name}").first()
            if n and low < high:
                reader = reader.option("partitionColumn", key).option("lowerBound", int(low)).option("upperBound", int(high) + 1).option("numPartitions", min(partitions, int(high - low) + 1))
        return reader.load()

    def execute(self, *statements: str) -> list[int]:
        """Statements in one transaction; rows that each has changed."""
        connection = self._open()
        try:
            connection.setAutoCommit(False)
            statement = connection.createStatement()
            changed = [statement.executeUpdate(s) for s in statements]
            connection.commit()
            return changed
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def _open(self):
        properties = self.spark._jvm.java.util.Properties()
        for k, v in self.properties.items():
            properties.setProperty(k, v)
        return self.spark._jvm.java.sql.DriverManager.getConnection(self.url, properties)

    def exists(self, name: str) -> bool:
        connection = self._open()
        try:
            return connection.getMetaData().getTables(None, None, name.upper(), None).next()
        finally:
            connection.close()

    def _load(self, df: DataFrame, staging: str) -> None:
        df.write.format("jdbc").option("url", self.url).option("dbtable", staging).option("batchsize", BATCH).options(**self.properties).mode("append").save()

    def upsert(self, df: DataFrame, name: str, keys: list[str], types: dict[str, str]) -> int:
        """Merge ``df`` (one row a key, keys not null) into ``name``, which is made if there is none, with ``types``
        as its columns; rows that are equal already are not touched. Returns rows that were added or changed."""
        columns = list(types)
        if not self.exists(name):
            declared = ", ".join(f"{c} {t}{' NOT NULL' if c in keys else ''}" for c, t in types.items())
            self.execute(f"CREATE TABLE {name} ({declared}, PRIMARY KEY ({', '.join(keys)}))")
        staging = f"{name}_{uuid.uuid4().hex[:12]}"
        self.execute(f"CREATE TABLE {staging} ({', '.join(f'{c} {t}' for c, t in types.items())})")
        try:
            self._load(df.select(*columns), staging)
            same = " AND ".join(f"((t.{c} IS NOT NULL AND s.{c} IS NOT NULL AND t.{c} = s.{c}) OR (t.{c} IS NULL AND s.{c} IS NULL))" for c in columns if c not in keys)
            rest = [c for c in columns if c not in keys]
            update = f"WHEN MATCHED AND NOT ({same}) THEN UPDATE SET {', '.join(f'{c} = s.{c}' for c in rest)} " if rest else ""
            merge = f"MERGE INTO {name} t USING {staging} s ON {' AND '.join(f't.{k} = s.{k}' for k in keys)} {update}WHEN NOT MATCHED THEN INSERT ({', '.join(columns)}) VALUES ({', '.join(f's.{c}' for c in columns)})"
            return self.execute(merge)[0]
        finally:
            self.execute(f"DROP TABLE {staging}")


class DriverDatabase(Database):
    """A Derby database on the driver's disk that executors cannot connect to: rows go to it and come from
    it as files in the shared folder, by the database's bulk import and export, one file at a time.
    Executors write and read the files; the database, not Spark's driver, holds the rows."""

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(shared_folder(self.spark)).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _call(self, sql: str) -> None:
        connection = self._open()
        try:
            connection.createStatement().execute(sql)
        finally:
            connection.close()

    def _load(self, df: DataFrame, staging: str) -> None:
        quoted = lambda c, t: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"')) if t == "string" else F.col(c).cast("string")
        folder, (path, fs) = new_path(self.spark, "load"), self._files()
        df.select(F.concat_ws(",", *(F.coalesce(quoted(c, t), F.lit("")) for c, t in df.dtypes)).alias("line")).write.text(folder)
        for status in fs.listStatus(path(folder)):
            if status.getPath().getName().startswith("part-") and status.getLen():
                with tempfile.TemporaryDirectory() as local:
                    fs.copyToLocalFile(False, status.getPath(), path(f"file://{local}/rows"), True)
                    self._call(f"CALL SYSCS_UTIL.SYSCS_IMPORT_DATA(null, '{staging.upper()}', '{','.join(df.columns).upper()}', null, '{local}/rows', null, null, 'UTF-8', 0)")
        delete(self.spark, folder)

    def _unloaded(self, sqls: list[str]) -> DataFrame:
        """The rows of several queries of the same columns, a file each."""
        folder, (path, fs) = new_path(self.spark, "unload"), self._files()
        for i, sql in enumerate(sqls):
            with tempfile.TemporaryDirectory() as local:
                self._call(f"CALL SYSCS_UTIL.SYSCS_EXPORT_QUERY('{sql.replace(chr(39), chr(39) * 2)}', '{local}/rows', null, null, 'UTF-8')")
                fs.copyFromLocalFile(True, True, path(f"file://{local}/rows"), path(f"{folder}/{i}.csv"))
        schema = super().query(sqls[0]).schema
        return self.spark.read.schema(schema).option("multiLine", True).option("escape", '"').option("nullValue", "\0").option("emptyValue", "").option("mode", "FAILFAST").csv(folder)

    def query(self, sql: str) -> DataFrame:
        return self._unloaded([sql])

    def table(self, name: str, key: str | None = None, partitions: int = 1, fetch: int = 10_000) -> DataFrame:
        """The table as it is now, in files of ranges of ``key``; rows without a key are in the first one."""
        low, high, n = self.query(f"SELECT min({key}) AS low, max({key}) AS high, count({key}) AS n FROM {name}").first() if key and partitions > 1 else (0, 0, 0)
        parts = min(partitions, int(high - low) + 1) if n else 1
        ends = [int(low) + (int(high) + 1 - int(low)) * i // parts for i in range(1, parts)]
        first, last = [None, *ends], [*ends, None]
        where = [" AND ".join([f"{key} >= {a}"] * (a is not None) + [f"{key} < {b}"] * (b is not None)) for a, b in zip(first, last, strict=True)]
        conditions = [f"({w})" + (f" OR {key} IS NULL" if i == 0 else "") if w else "" for i, w in enumerate(where)]
        return self._unloaded([f"SELECT * FROM {name}" + (f" WHERE {c}" if c else "") for c in conditions])


def embedded(spark: SparkSession, name: str | None = None) -> Database:
    """A database of this process: in memory if the master is local, where tasks connect to it, else on the
    driver's disk, with rows exchanged as files."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.method", "java.io.OutputStream.nullOutputStream")
    name, driver = name or uuid.uuid4().hex, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        return Database(spark, f"jdbc:derby:memory:{name};create=true", driver)
    folder = tempfile.mkdtemp(prefix="lodestrata-database-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return DriverDatabase(spark, f"jdbc:derby:{folder}/{name};create=true", driver)
