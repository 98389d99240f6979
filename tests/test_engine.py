"""Plans, contracts, reconciliation, sources, streaming."""

import datetime

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import chunking as C
from lodestrata.operators import ingest as I
from lodestrata.operators import reconcile as R
from lodestrata.operators import rewrite as W
from lodestrata.operators.contracts import contract_set, read_contracts
from lodestrata.plans import bind
from lodestrata.plans.execute import execute, metadata
from lodestrata.plans.model import ClarificationNeeded, Filter, Plan, PlanError
from lodestrata.sources import tables
from lodestrata.sources.tables import is_safe_key, object_uri
from lodestrata.sources.workbook import sheets, workbook_bytes, workbook_rows
from lodestrata.streaming import ingest as S

FACTS = "fact_id long, revision_id string, table_number int, metric_name string, value_numeric decimal(18,2), year int, quarter int, region string, unit string, dimensions map<string,string>"


def facts(spark):
    d = lambda v: None if v is None else __import__("decimal").Decimal(v)
    rows = [(1, "r1", 2, "a", d("1.10"), 2023, 1, "N", "km", {"k": "9"}), (2, "r1", 2, "a", d("2.20"), 2023, 2, "S", "km", {"k": "10"}), (3, "r2", 2, "b", None, 2024, 1, None, "mi", {}), (4, "r2", 2, "b", d("-1.00"), 2024, 1, "N", "mi", None)]
    return spark.createDataFrame(rows, FACTS)


@pytest.mark.parametrize("plan", [Plan(aggregate="median"), Plan(source="x"), Plan(operation="join"), Plan(limit=0), Plan(limit=201), Plan(source="records"), Plan(group_by=("secret",)), Plan(filters=(Filter("year", "like", 1),)), Plan(filters=(Filter("nope", "eq", 1),)), Plan(order_by="year")])
def test_bad_plans(plan):
    with pytest.raises(PlanError):
        plan.validate()


def test_dual_year_tables_need_a_basis():
    with pytest.raises(ClarificationNeeded):
        Plan(table_number=15, filters=(Filter("year", "eq", 2023),)).validate()
    Plan(table_number=15, year_basis="reporting", filters=(Filter("year", "eq", 2023),)).validate()


def test_rank_puts_nulls_last_both_ways(spark):
    for descending in (True, False):
        rows = execute(Plan(operation="rank", group_by=("region",), descending=descending), facts(spark).where("fact_id in (1, 2, 3)")).collect()
        assert rows[-1]["value"] is None


def test_json_filter_compares_text(spark):
    out = execute(Plan(filters=(Filter("k", "gt", 8, json_key=True),), group_by=("metric_name",)), facts(spark)).collect()
    assert [(r["metric_name"], float(r["value"])) for r in out] == [("a", 1.1)]  # '10' sorts before '8'


def test_unit_guard(spark):
    assert metadata(Plan(), facts(spark)).first()["unit_status"] == "refused"
    assert metadata(Plan(filters=(Filter("metric_name", "eq", "a"),)), facts(spark)).first()["unit_status"] == "ok"


def test_filters_reach_the_scan(spark, tmp_path):
    path = f"file://{tmp_path}/facts"
    facts(spark).write.parquet(path)
    plan = execute(Plan(filters=(Filter("year", "eq", 2023),), group_by=("metric_name",)), spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(year,2023)" in plan and "region" not in plan.split("ReadSchema")[1]


def test_binding(spark):
    q = spark.createDataFrame([(1, "North in Q2 of 2023"), (2, "2023 or 2024, Q1 and Q2, Northern Ridge"), (3, "nothing")], "question_id long, question string")
    got = [tuple(r) for r in q.select(bind.bind_year(F.col("question")), bind.bind_quarter(F.col("question"))).collect()]
    assert got == [(2023, 2), (None, None), (None, None)]
    vocab = spark.createDataFrame([("area", "North"), ("area", "Northern Ridge"), ("area", "2023"), ("area", "in")], "dimension string, value string")
    assert sorted((r["question_id"], r["value"]) for r in bind.bind_dimensions(q, vocab).collect()) == [(1, "North"), (2, "Northern Ridge")]


def test_contract():
    c = I.TableContract(1, "entity", ("id",), ("note",), ("email",))
    assert c.inventory(["id", "email", "x"]) == {"present": ["id"], "unknown": ["x"], "missing_required": [], "missing_optional": ["note"], "excluded_present": ["email"]}
    with pytest.raises(ValueError, match="also persisted"):
        I.TableContract(1, "entity", ("email",), (), ("email",))
    with pytest.raises(ValueError, match="family"):
        I.TableContract(1, "other", ())


def test_contract_load_drops_personal_data(spark):
    df = spark.createDataFrame([(1, "a@b.c", 2)], "id int, email string, x int")
    assert I.TableContract(1, "entity", ("id",), (), ("email",)).load(df).columns == ["id"]
    with pytest.raises(ValueError, match="lacks"):
        I.TableContract(1, "entity", ("key",)).load(df)


def test_lifecycle_uses_the_previous_available_period(spark):
    day = lambda n: datetime.date(2024, 1, n)
    rows = [("a", "x", day(1)), ("a", "x", day(3)), ("a", "y", day(3)), ("b", "x", day(3)), ("a", "z", day(9)), ("b", "x", day(20)), ("c", "q", day(1)), ("c", "q", day(20))]
    got = {(r["k"], r["f"], r["d"].day): r["status"] for r in R.lifecycle(spark.createDataFrame(rows, "k string, f string, d date"), "k", "f", "d").collect()}
    assert got == {
        ("a", "x", 1): "first_available_snapshot", ("c", "q", 1): "first_available_snapshot", ("a", "x", 3): "continued_unchanged", ("a", "y", 3): "continued_with_attribute_change",
        ("b", "x", 3): "newly_seen", ("a", "z", 9): "continued_with_attribute_change", ("b", "x", 20): "reappeared_after_gap", ("c", "q", 20): "reappeared_after_gap",
    }


def test_crosswalk_joins_nulls(spark):
    a = spark.createDataFrame([("x", None, 1), ("y", 1, 2), ("y", 1, 3)], "p string, q int, v int")
    b = spark.createDataFrame([("x", None, 7), ("y", 1, 8), ("z", 1, 9)], "p string, q int, v int")
    assert {(r["p"], r["crosswalk_status"]) for r in R.crosswalk(a, b, ["p", "q"], "v").collect()} == {("x", "one_to_one"), ("y", "ambiguous")}


def test_revision_diff_and_strict_sum(spark):
    a, b = (spark.createDataFrame(x, "k int, v int") for x in ([(1, 1), (2, None), (3, 3)], [(2, None), (3, 4), (4, 4)]))
    assert {(r["k"], r["status"], r["v_delta"]) for r in R.revision_diff(a, b, "k", ["v"]).collect()} == {(1, "removed", None), (2, "unchanged", None), (3, "changed", 1), (4, "added", None)}
    assert [r[0] for r in a.groupBy(F.col("k") > 1).agg(R.strict_sum(F.col("v")).alias("s")).select("s").orderBy(F.asc_nulls_first("s")).collect()] == [None, 1]


def test_workbooks(spark):
    book = workbook_bytes({"One": [["h", 1], [], ["=x", True], [None, None]], "Empty": []})
    assert list(sheets(book)) == [("One", 1, ["h", "1"]), ("One", 3, ["'=x", "TRUE"])]
    rows = workbook_rows(spark.createDataFrame([("good", bytearray(book)), ("bad", bytearray(b"no zip"))], "path string, content binary")).collect()
    assert [(r["path"], r["row"]) for r in rows if not r["error"]] == [("good", 1), ("good", 3)]
    assert [r["path"] for r in rows if r["error"]] == ["bad"]


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id , name_raw\n1,"two\nlines"\n', encoding="utf-8")
    df = tables.read_csv(spark, f"file://{tmp_path}/a.csv")
    assert df.columns == ["id", "name_raw"] and df.first()["name_raw"] == "two\nlines" and tables.without_raw(df).columns == ["id"]
    tables.write_csv(spark.createDataFrame([("=1+1",)], "x string"), f"file://{tmp_path}/out")
    assert tables.read_csv(spark, f"file://{tmp_path}/out").first()["x"] == "'=1+1"
    (tmp_path / "b.jsonl").write_text('{"q": "“curly”"}\n\n', encoding="utf-8")
    assert [r["q"] for r in tables.read_jsonl(spark, f"file://{tmp_path}/b.jsonl", "q string").collect()] == ["“curly”"]
    for key in ("/abs", "a/../b", "", "C:x"):
        with pytest.raises(ValueError):
            tables.safe_key(key)


def test_merges(spark, tmp_path):
    old, new = (spark.createDataFrame(x, "k int, v int") for x in ([(1, 1), (2, 2)], [(2, 3), (3, 3)]))
    assert sorted(map(tuple, I.upsert(old, new, "k").collect())) == [(1, 1), (2, 3), (3, 3)]
    path = f"file://{tmp_path}/parts"
    I.write_revision(old, path, ["k"])
    I.write_revision(new, path, ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, 1), (2, 3), (3, 3)]
    reg = spark.createDataFrame([("s", 1, "active"), ("s", 2, "staging"), ("s", 3, "failed")], "source string, revision int, state string")
    assert {r["revision"]: r["state"] for r in I.activate(reg, "source", "revision").collect()} == {1: "superseded", 2: "active", 3: "failed"}


def test_stream_takes_each_content_once(spark, tmp_path):
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("src", "out", "check"))
    at = datetime.datetime(2024, 1, 1)
    schema = "doc_id long, text string, arrived timestamp"
    spark.createDataFrame([(1, "a", at), (2, "b", at)], schema).coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        S.append_to(S.first_seen(S.document_stream(spark, src, schema)), out, check).awaitTermination(120)
        spark.createDataFrame([(3, "a", at), (4, "c", at)], schema).coalesce(1).write.mode("append").parquet(src)
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_stream_windows(spark, tmp_path):
    src, out, check = (f"file://{tmp_path}/{x}" for x in ("src", "out", "check"))
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    spark.createDataFrame([(at(1), "x", 1.0), (at(1), "x", 2.0), (at(9), "x", 5.0)], "ts timestamp, event_type string, value double").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(src)
    S.append_to(S.windowed_counts(stream).select("window.start", "n", "total"), out, check).awaitTermination(120)
    assert [(r["n"], r["total"]) for r in spark.read.parquet(out).where("start < '2024-01-01 02:00:00'").collect()] == [(2, 3.0)]


def test_validation_of_years_and_keys():
    year, keys = Filter("reporting_year", "eq", 2023), ("k",)
    with pytest.raises(ClarificationNeeded):
        Plan(table_number=14, filters=(year,)).validate()
    for axis in ("year_basis", "source_vintage_year"):
        Plan(table_number=14, filters=(year, Filter(axis, "eq", 1))).validate()
    Plan(table_number=14, filters=(year,), require_year_basis=False).validate()
    Plan(source="records", operation="select", json_keys=keys).validate()
    for bad in (Plan(json_keys=keys), Plan(operation="select", json_keys=keys), Plan(source="records", aggregate="count", json_keys=keys)):
        with pytest.raises(PlanError):
            bad.validate()


def test_only_active_revisions_count(spark):
    rows = spark.createDataFrame([("1", "a", 2.0), ("2", "a", 5.0)], "revision_id string, metric_name string, value_numeric double").withColumn("dimensions", F.create_map(F.lit("k"), F.lit("v")))
    revisions = spark.createDataFrame([("1", "superseded"), ("2", "active")], "revision_id string, state string")
    assert execute(Plan(), rows, revisions).first()["value"] == 5.0


def test_binding_is_bounded_by_words_of_any_script(spark):
    q = spark.createDataFrame([(1, "Los Ángeles pole 12-34 counts"), (2, "poles in Ángel land, tier-3 (high)")], "question_id long, question string")
    vocab = spark.createDataFrame([("place", "ngeles"), ("place", "Ángel"), ("code", "12-34"), ("kind", "Pole"), ("tier", "Tier-3 (High)"), ("tier", "Tier 3")], "dimension string, value string")
    assert sorted((r["question_id"], r["dimension"], r["value"]) for r in bind.bind_dimensions(q, vocab).collect()) == [(1, "kind", "Pole"), (2, "place", "Ángel"), (2, "tier", "Tier-3 (High)")]


def test_rewrite_falls_back_to_the_question(spark):
    two = "What is a? And what is b?"
    cases = [(1, two, '["b", " B ", "", "What  is a? and what is B?", "c  d", "e"]'), (2, two, None), (3, two, "no json"), (4, two, '{"a": 1}'), (5, two, '["a", null]'), (6, two, '["a", 2]'), (7, two, "[]"), (8, "What is a?", '["b"]'), (9, None, None)]
    q = spark.createDataFrame(cases, "id long, question string, reply string")
    by = {mode: {r["id"]: r for r in W.rewrite(q, mode).collect()} for mode in W.MODES}
    assert by["auto"][1]["search_queries"] == [two, "b", "c d"] and by["auto"][1]["source"] == "api"
    for i in range(2, 8):
        assert (by["auto"][i]["search_queries"], by["auto"][i]["source"]) == ([two], "fallback"), i
    assert (by["auto"][8]["search_queries"], by["auto"][8]["source"], by["auto"][8]["reason"]) == (["What is a?"], "simple", "single_intent")
    assert by["always"][8]["search_queries"] == ["What is a?", "b"] and by["always"][8]["reason"] == "mode_always"
    assert by["auto"][9]["search_queries"] == [""]
    assert all(r["source"] == "disabled" and len(r["search_queries"]) == 1 for r in by["off"].values())
    with pytest.raises(ValueError):
        W.rewrite(q, "sometimes")


def test_outline_paths_and_texts(spark):
    nodes = [("d", 1, 0, " Plan "), ("d", 2, 1, "Risk"), ("d", 3, 2, "Annex.PDF"), ("d", 4, 3, "A.1"), ("d", 5, 1, None), ("d", 6, 0, "End"), ("e", 1, 2, "Deep"), ("e", 2, 1, "Up")]
    o = spark.createDataFrame(nodes, "document string, n long, depth int, title string")
    got = {(r["document"], r["n"]): (r["breadcrumb"], r["sub_document"]) for r in C.section_paths(o, "document", "n", "depth", "title").collect()}
    assert got == {
        ("d", 1): ("Plan", None), ("d", 2): ("Plan > Risk", None), ("d", 3): ("Annex.PDF", "Annex.PDF"), ("d", 4): ("Annex.PDF > A.1", "Annex.PDF"),
        ("d", 5): ("Plan > ", None), ("d", 6): ("End", None), ("e", 1): ("Deep", None), ("e", 2): ("Up", None),
    }
    assert C.section_paths(o.where("false"), "document", "n", "depth", "title").count() == 0
    pages = spark.createDataFrame([("d", 0, " one"), ("d", 1, None), ("d", 2, "three ")], "document string, page int, text string")
    spans = spark.createDataFrame([("d", 1, 0, 3), ("d", 2, 2, 9), ("d", 3, 2, 2), ("x", 4, 0, 1)], "document string, section int, a int, b int")
    texts = C.section_texts(spans, pages, "document", "section", "a", "b", "page", "text").collect()
    assert {r["section"]: r["text"] for r in texts} == {1: "one\n\nthree", 2: "three", 3: "", 4: ""}


def test_signature_reset_and_uris(spark):
    settings = {"version": "v1", "size": 5, "fold": True, "none": None}
    row = I.signed(spark.range(1), {k: F.lit(v) for k, v in settings.items()}).first()
    assert row["signature"] == I.signature(settings) != I.signature(settings | {"size": 6})
    spark.range(1).write.mode("overwrite").saveAsTable("reset_me")
    with pytest.raises(ValueError):
        I.reset(spark, ["reset_me"])
    assert I.reset(spark, ["reset_me", "never_was"], confirmed=True) == ["reset_me"]
    assert not spark.catalog.tableExists("reset_me")
    keys = ["a/b.png", "/a", "a/../b", "C:/x", "", None, "a..b"]
    k = spark.createDataFrame([(x,) for x in keys], "k string")
    assert [r[0] for r in k.select(is_safe_key(F.col("k"))).collect()] == [True, False, False, False, False, False, True]
    assert k.where("k = 'a..b'").select(object_uri("/store/", F.col("k"))).first()[0] == "/store/a..b"
    with pytest.raises(Exception, match="unsafe key"):
        k.where("k = '/a'").select(object_uri("/store", F.col("k"))).collect()


def test_contracts_from_yaml():
    pytest.importorskip("yaml")
    got = read_contracts("""
version: c-1
defaults: {excluded: [phone]}
tables:
  one: {number: 1, family: entity, required: [id, name]}
  two: {number: 2, family: long_metric, required: [id], value: v, excluded: []}
""")
    assert got.version == "c-1" and got[1].excluded == ("phone",) and got[2].persisted == ("id", "v") and got[2].excluded == ()
    assert got[1].inventory(["id", "phone", "x"])["unknown"] == ["x"]
    with pytest.raises(KeyError):
        got[3]
    one = {"number": 1, "family": "entity"}
    bad = [{}, {"a": one, "b": one}, {"a": one | {"odd": 1}}, {"a": {"number": 1}}, {"a": one | {"required": "id"}}, {"a": one | {"required": ["id", "id"]}}, {"a": one | {"required": ["p"], "excluded": ["p"]}}, {"a": one | {"family": "x"}}, {"a": None}]
    for tables_ in bad:
        with pytest.raises(ValueError):
            contract_set({"tables": tables_})
    for text in ("a: [", "- 1", ""):
        with pytest.raises(ValueError):
            read_contracts(text)
