"""Queries against their SQL on small tables of odd rows."""

import os
import random
import subprocess
import sys

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from test_queries import table

from lodestrata.operators import chunking as C
from lodestrata.plans import batch
from lodestrata.queries import QUERIES, SQL
from lodestrata.queries.registry import facts, registry_rows
from lodestrata.sources import scratch, workbook


def agrees(spark, folder, name):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    df = QUERIES[name](spark, str(folder))
    got, want = df.collect(), con.sql(SQL[name])
    assert table(df.columns, got) == table([c[0] for c in want.description], want.fetchall())
    return got


def test_caption_prior_of_accented_captions(spark, tmp_path):
    texts = ["the ÉEL LLAR OS, que", "que DO LA DEÉ thing", "THE EL LLAR OS", "QUE a_EL LLAR OS", None, ""]
    docs = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "lang": ["es", "fr", "de", "es", "fr", None], "source": ["s"] * len(texts), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})
    pq.write_table(docs, tmp_path / "documents.parquet")
    assert len(agrees(spark, tmp_path, "q_caption_prior")) == len(texts)


def test_figure_links_of_pages_that_repeat_or_lack(spark, tmp_path):
    n, sizes = 3000, [None, 1, 1, 2, 3, 9, 30, 50]
    names = ["green figure 5 of" if i % 11 == 0 else "red" for i in range(n)]
    part = pa.table({"p_partkey": pa.array(range(n), pa.int64()), "p_name": names, "p_brand": ["A" if i < n - 40 else f"B{i % 3}" for i in range(n)], "p_size": pa.array([sizes[i // 4 % 8 - i % 2] for i in range(n)], pa.int32())})
    pq.write_table(part, tmp_path / "part.parquet")
    assert len(agrees(spark, tmp_path, "q_figure_link")) == n // 4


def test_nearest_against_pairs(spark):
    rng = random.Random(3)
    points = [(rng.choice("ab"), rng.choice([None, *range(30)])) for _ in range(60)]
    places = [(rng.choice("abc"), rng.choice([None, *range(0, 30, 4)]), i) for i in range(25)]
    got = C.nearest(spark.createDataFrame(points, "k string, p int"), spark.createDataFrame(places, "k string, at int, v int"), ["k"], "p", "at", "v").collect()
    want = {}
    for k, p in points:
        held = [((at is None), abs(at - p) if at is not None else 0, v) for key, at, v in places if key == k] if p is not None else []
        if held:
            far, away, v = min(held)
            want[k, p] = (None if far else away, v)
    assert {(r["k"], r["p"]): (r["away"], r["v"]) for r in got} == want and len(got) == len(want)


def test_workbooks_beyond_a_full_sheet(spark, tmp_path, monkeypatch):
    """A task with more rows than a sheet holds: none is lost, and each workbook has its header."""
    monkeypatch.setattr(workbook, "SHEET_ROWS", 10)
    for n, files in ((0, 1), (1, 1), (9, 1), (10, 2), (18, 2), (31, 4)):
        folder = tmp_path / str(n)
        writer = workbook.WorkbookWriter({"path": str(folder), "sheet": "orders"}, ["k"], False)
        writer.commit([writer.write(iter([(i,) for i in range(n)]))])
        reader = workbook.WorkbookReader({"path": str(folder), "sheet": "orders"})
        rows = [r for p in reader.partitions() for r in reader._rows(p)]
        assert len(list(folder.iterdir())) == files
        assert sorted(int(r[3][0]) for r in rows if r[2] > 1) == list(range(n))
        assert [r[3] for r in rows if r[2] == 1] == [["k"]] * files and {r[1] for r in rows} == {"orders"}


_CLUSTER = """
import sys
from pyspark.sql import SparkSession
from lodestrata.queries import QUERIES
from lodestrata.sources.jdbc import embedded

spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.executor.memory", "1g").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", f"file://{sys.argv[1]}").config("spark.driver.host", "127.0.0.1").getOrCreate()
db, odd = embedded(spark), [(1, 'a"b,\\n', 0.1), (2, "", None), (3, None, 1e-300), (4, "  x ", 1 / 3), (5, "a\\\\b", -2.5)]
rows = spark.createDataFrame(odd, "k long, n string, v double")
types = {"k": "BIGINT", "n": "VARCHAR(20)", "v": "DOUBLE"}
assert (db.upsert(rows, "t", ["k"], types), db.upsert(rows, "t", ["k"], types), db.upsert(rows.selectExpr("k + 3 as k", "n", "v"), "t", ["k"], types)) == (5, 0, 5)
want = {**{r[0]: r for r in odd}, **{r[0] + 3: (r[0] + 3, *r[1:]) for r in odd}}
assert sorted(tuple(r) for r in db.table("t", "k", 3).collect()) == sorted(want.values())
QUERIES["q_jdbc_upsert"](spark, "/root/testdata/sf0.001").write.parquet(f"file://{sys.argv[1]}/out")
"""


def test_jdbc_upsert_on_several_executors(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(_CLUSTER, encoding="utf-8")
    subprocess.run([sys.executable, str(script), str(tmp_path)], check=True, timeout=300, capture_output=True, text=True)
    con = duckdb.connect()
    con.sql("create view customer as select * from '/root/testdata/sf0.001/customer.parquet'")
    got = con.sql(f"select * from '{tmp_path}/out/*.parquet'")
    want = con.sql(SQL["q_jdbc_upsert"])
    assert table(got.columns, got.fetchall()) == table(want.columns, want.fetchall())


def test_plans_that_say_the_same_are_answered_once(spark, monkeypatch):
    sizes = []

    def written(df, name):
        sizes.append((name, df.count()))
        return scratch.written(df, name)

    monkeypatch.setattr(batch, "written", written)
    plans = spark.range(50).selectExpr("CAST(id AS STRING) AS plan_id", "'facts' AS source", "'aggregate' AS operation", "'sum' AS aggregate", "2 AS table_number", "CAST(NULL AS STRING) AS semantic_metric_key", "CAST(NULL AS STRING) AS measure_name", "array(named_struct('field', 'region', 'operator', 'eq', 'value', IF(id % 2 = 0, 'ASIA', 'EUROPE'), 'json_key', false)) AS filters", "CAST(array() AS array<string>) AS group_by", "CAST(array() AS array<string>) AS json_keys", "CAST(NULL AS STRING) AS order_by", "true AS descending", "3 AS limit", "CAST(NULL AS STRING) AS year_basis", "true AS require_year_basis")
    got = batch.answers(plans, facts(spark, "/root/testdata/sf0.001"), registry_rows(spark)).collect()
    assert sorted(int(r["plan_id"]) for r in got) == list(range(50)) and len({r["value"] for r in got}) == 2
    assert {n for name, n in sizes if name == "plans"} == {2}
