"""Workbooks, published revisions, objects and databases."""

import datetime
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrata.operators.publish import Conflict, Folder, ObjectStore, Publisher
from lodestrata.sources import workbook as W
from lodestrata.sources.jdbc import BATCH, Database, embedded

MAIN = W._MAIN[1:-1]


def handmade():
    """A workbook as a spreadsheet program would write it: shared strings, styles, merged cells, a formatted empty cell."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{W._REL[1:-3]}"><sheets><sheet name="Data" sheetId="1" r:id="rId1"/><sheet name="Other" sheetId="2" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/a.xml"/><Relationship Id="rId2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>head</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="[$-409]d-mmm-yyyy;@"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        z.writestr(
            "xl/worksheets/a.xml",
            f'<worksheet xmlns="{MAIN}"><dimension ref="A1:XFD99"/><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row r="3"><c r="A3" s="1"><v>45292</v></c><c r="B3" s="2"><v>45293</v></c><c r="C3" s="3"><v>45294</v></c><c r="D3" s="4"><v>45292.5</v></c></row>'
            '<row r="4"><c r="B4" t="b"><v>1</v></c><c r="C4"><v>1.0E3</v></c><c r="D4"><v>0.1</v></c><c r="E4" t="str"><f>A1</f><v>text</v></c><c r="F4" t="e"><v>#N/A</v></c></row><row r="99"><c r="XFD99" s="1"/></row></sheetData><mergeCells><mergeCell ref="A2:B3"/><mergeCell ref="G4:H9"/></mergeCells></worksheet>',
        )
        z.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{MAIN}"><sheetData><row><c t="inlineStr"><is><t>no references</t></is></c><c><v>2</v></c></row></sheetData></worksheet>')
    return out.getvalue()


@pytest.fixture
def books(spark, tmp_path):
    W.register(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.xlsx").write_bytes(handmade())
    (tmp_path / "in/broken.xlsx").write_bytes(b"no zip")
    (tmp_path / "in/~a.xlsx").write_bytes(b"lock file")
    (tmp_path / "in/notes.txt").write_text("not a workbook")
    return spark.read.format("workbook"), tmp_path


def test_workbook_format(books):
    reader, path = books
    rows = sorted(reader.load(f"{path}/in").collect(), key=lambda r: (r["error"] or "", r["sheet"] or "", r["row"] or 0))
    data = [(r["sheet"], r["row"], r["cells"]) for r in rows if not r["error"]]
    assert data == [
        ("Data", 2, ["head", None, "two runs", None, None, None]),
        ("Data", 3, ["2024-01-01", "2024-01-02", "45294", "2024-01-01 12:00:00", None, None]),
        ("Data", 4, [None, "TRUE", "1000", "0.1", "text", "#N/A"]),
        ("Other", 1, ["no references", "2"]),
    ]
    assert next(r["formats"] for r in rows if r["row"] == 3)[:4] == ["mm-dd-yy", "[$-409]d-mmm-yyyy;@", '0.0"d"', "m/d/yy h:mm"]
    assert [os.path.basename(r["path"]) for r in rows if r["error"]] == ["broken.xlsx"]


def test_workbook_options(books, monkeypatch):
    reader, path = books
    filled = reader.option("merged", "fill").option("sheet", "Data").load(f"{path}/in/a.xlsx").orderBy("row").collect()
    assert [r["cells"][:3] for r in filled] == [["head", "head", "two runs"], ["head", "head", "45294"], [None, "TRUE", "1000"]]
    monkeypatch.setattr(W, "PARTITION_BYTES", 100)
    parts = W.WorkbookReader({"path": f"{path}/in"}).partitions()
    assert [(os.path.basename(p.paths[0]), p.sheet) for p in parts] == [("a.xlsx", "Data"), ("a.xlsx", "Other"), ("broken.xlsx", None)]
    with pytest.raises(FileNotFoundError):
        W.WorkbookReader({"path": f"{path}/nowhere"}).partitions()


def test_workbook_round_trip(spark, books):
    _, path = books
    at = datetime.datetime(2024, 2, 29, 13, 30)
    rows = [(1, 1.5, "=SUM(A1)", True, datetime.date(1950, 3, 1), at), (2, None, "a<b>&\x01  c", False, None, None), (3, 1e300, None, None, datetime.date(2099, 12, 31), at)]
    df = spark.createDataFrame(rows, "i long, d double, s string, b boolean, day date, at timestamp_ntz")
    for mode in ("append", "overwrite", "append"):
        df.repartition(2, "i").write.format("workbook").mode(mode).option("sheet", "x").save(f"{path}/out")
    assert not [f for f in os.listdir(f"{path}/out") if f.startswith("_")]
    got = spark.read.format("workbook").load(f"{path}/out").where("row > 1").collect()
    cells = sorted(r["cells"] for r in got)
    want = [["1", "1.5", "'=SUM(A1)", "TRUE", "1950-03-01", "2024-02-29 13:30:00"], ["2", None, "a<b>&  c", "FALSE", None, None], ["3", "1e+300", None, None, "2099-12-31", "2024-02-29 13:30:00"]]
    pad = lambda r: r + [None] * (6 - len(r))
    assert [pad(c) for c in cells] == [w for w in want for _ in range(2)]


def test_full_sheets_go_on(monkeypatch):
    monkeypatch.setattr(W, "SHEET_ROWS", 2)
    book = W.workbook_bytes({"s": [[i] for i in range(5)]})
    assert [(s, n, c) for s, n, c in W.sheets(book)] == [("s", 1, ["0"]), ("s", 2, ["1"]), ("s (2)", 1, ["2"]), ("s (2)", 2, ["3"]), ("s (3)", 1, ["4"])]


@pytest.mark.parametrize(("code", "date"), [("General", False), ("0.00", False), ("yyyy-mm-dd", True), ('0" days"', False), ("[Red]0", False), ("[h]:mm", True), ("#,##0_);(#,##0)", False), ("\\d0", False), ("mmm yy;@", True)])
def test_date_formats(code, date):
    assert W.is_date_format(code) is date


# --- revisions


def frame(spark, n):
    return spark.range(n).withColumn("v", F.lit(n))


def test_a_revision_is_seen_once_it_is_committed(spark, tmp_path):
    p = Publisher(spark, f"file://{tmp_path}/p")
    with pytest.raises(LookupError):
        p.active("a")
    p.publish("a", frame(spark, 3), "h1", "s")
    staged = p.stage("a", frame(spark, 5))  # and then the writer is lost
    assert p.active("a").count() == 3
    assert p.publish("a", frame(spark, 9), "h1", "s").get("skipped") and p.active("a").count() == 3
    p.commit(staged, "h2", "s")
    assert p.active("a").count() == 5
    p.publish("a", frame(spark, 6), "h2", "other settings")
    assert [(r["revision"], r["state"], r["rows"]) for r in p.registry().orderBy("revision").collect()] == [(1, "superseded", 3), (2, "superseded", 5), (3, "active", 6)]


def test_of_two_writers_one_wins(spark, tmp_path):
    p = Publisher(spark, f"file://{tmp_path}/p")
    first, second = p.stage("a", frame(spark, 1)), p.stage("a", frame(spark, 2))
    p.commit(second)
    with pytest.raises(Conflict):
        p.commit(first)
    assert p.active("a").count() == 2 and len(p.entries("a")) == 1


def test_failed_runs_are_recorded(spark, tmp_path):
    p = Publisher(spark, f"file://{tmp_path}/p")
    p.publish("a", frame(spark, 2))
    with pytest.raises(ValueError):
        p.publish("a", frame(spark, 0), check=lambda df: "x" * 5000 if df.isEmpty() else None)
    with pytest.raises(Exception, match="(?i)zero"):
        p.publish("b", frame(spark, 2).select(F.expr("1 / (id - 1)").alias("x")))
    failed = {r["source"]: r["error"] for r in p.registry().where("state = 'failed'").collect()}
    assert failed["a"] == "x" * 2000 and len(failed["b"]) <= 2000 and p.active("a").count() == 2
    assert p.registry().where("state = 'active'").count() == 1
    with pytest.raises(ValueError):
        p.publish("../a", frame(spark, 1))


def test_put_if_absent(spark, tmp_path):
    folder = Folder(spark, f"file://{tmp_path}/f")
    assert folder.names() == []
    folder.put_if_absent("1.json", json.dumps({"é": 1}))
    with pytest.raises(Conflict):
        folder.put_if_absent("1.json", "{}")
    assert folder.names() == ["1.json"] and json.loads(folder.read("1.json")) == {"é": 1}
    assert not [n for n in os.listdir(f"{tmp_path}/f") if n.startswith(".") and not n.endswith(".crc")]


# --- objects


def test_objects(spark, tmp_path):
    store = ObjectStore(spark, f"file://{tmp_path}/o")
    rows = spark.createDataFrame([("a/1.png", bytearray(b"one")), ("a/b/2.png", bytearray(b"")), ("c.png", None)], "key string, content binary")
    assert {(r["key"], r["size"]) for r in store.put(rows).collect()} == {("a/1.png", 3), ("a/b/2.png", 0), ("c.png", 0)}
    assert {(r["key"], bytes(r["content"])) for r in store.read().collect()} == {("a/1.png", b"one")}
    assert os.path.getsize(f"{tmp_path}/o/a/b/2.png") == 0 and {r["key"] for r in store.read("a").collect()} == {"a/1.png"}
    assert store.clear_prefix("a") and store.read().collect() == []
    assert not store.clear_prefix("nothing")
    for bad in ("", "/", ".", "..", "a/../..", "/etc"):
        with pytest.raises(ValueError):
            store.clear_prefix(bad)
    with pytest.raises(Exception, match="unsafe key"):
        store.put(spark.createDataFrame([("../x", bytearray(b"1"))], "key string, content binary")).collect()
    assert sorted(os.listdir(f"{tmp_path}/o")) == ["c.png"] and store.uri("a b.png") == f"file://{tmp_path}/o/a b.png"


# --- databases

TYPES = {"id": "BIGINT", "name": "VARCHAR(20)", "v": "DOUBLE"}


def test_upserts_add_nothing_twice(spark):
    db = embedded(spark)
    rows = spark.range(3 * BATCH + 7).select("id", F.concat(F.lit("n"), "id").alias("name"), F.when(F.col("id") % 5 > 0, F.col("id") / 2).alias("v")).repartition(5)
    assert db.upsert(rows, "t", ["id"], TYPES) == 3 * BATCH + 7
    assert db.upsert(rows, "t", ["id"], TYPES) == 0
    assert db.upsert(rows.withColumn("v", F.when(F.col("id") < 10, F.lit(-1.0)).otherwise(F.col("v"))).union(spark.range(9000, 9003).selectExpr("id", "'new'", "null")), "t", ["id"], TYPES) == 13
    read = db.table("t", "id", 6)
    assert read.rdd.getNumPartitions() == 6 and read.count() == 3 * BATCH + 10
    assert db.query("SELECT count(*) AS n FROM t WHERE v = -1").first()[0] == 10
    names = db.query("SELECT count(*) AS n FROM sys.systables WHERE tabletype = 'T'").first()[0]
    assert names == 1  # staging tables are gone


def test_a_failed_upsert_leaves_the_table(spark):
    db = embedded(spark)
    db.upsert(spark.createDataFrame([(1, "a", 1.0)], "id long, name string, v double"), "t", ["id"], TYPES)
    with pytest.raises(Exception):  # noqa: B017
        db.upsert(spark.createDataFrame([(2, "b", 1.0), (3, "c" * 50, 1.0)], "id long, name string, v double"), "t", ["id"], TYPES)
    with pytest.raises(Exception):  # noqa: B017
        db.upsert(spark.createDataFrame([(4, "b", 1.0), (4, "c", 1.0)], "id long, name string, v double"), "t", ["id"], TYPES)
    assert [tuple(r) for r in db.table("t", "id", 4).collect()] == [(1, "a", 1.0)]
    assert db.query("SELECT count(*) AS n FROM sys.systables WHERE tabletype = 'T'").first()[0] == 1


def test_filters_reach_the_database(spark):
    db = embedded(spark)
    db.upsert(spark.range(100).selectExpr("id", "'x' AS name", "1.0D AS v"), "t", ["id"], TYPES)
    plan = db.table("t", "id", 3).where("V > 5").select("ID")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(V), *GreaterThan(V,5.0)]" in plan
    assert isinstance(db, Database)
