"""Scalar functions and folds on small rows."""

import datetime
import random
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions import values as V
from lodestrata.operators import chunking as C
from lodestrata.operators import evaluation as E
from lodestrata.operators import retrieval as R


def col(spark, values, kind, expr):
    rows = spark.createDataFrame(list(enumerate(values)), f"i long, x {kind}").select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_clean(spark):
    assert col(spark, ["  a  b \n", "", " ", None, "NA", "N/A"], "string", T.clean) == ["a b", None, None, None, "NA", "N/A"]
    assert col(spark, [" n/a", "Not  applicable", "None", "NAB"], "string", T.na_to_null) == [None, None, "None", "NAB"]


def test_parse_decimal(spark):
    got = col(spark, ["$1,234.50", "12 %", "-", "+", ".", "abc", "", None, "-3", "1e3", "5%%"], "string", V.parse_decimal)
    assert got == [Decimal("1234.5"), Decimal(12), None, None, None, None, None, None, Decimal(-3), Decimal(1000), None]
    assert col(spark, ["2.9", "-2.9", "x"], "string", V.parse_int) == [2, -2, None]


def test_dates(spark):
    d = datetime.date(2023, 4, 5)
    assert col(spark, ["2023-04-05", "04/05/2023", "2023/04/05", "5 April", None], "string", V.parse_date) == [d, d, d, None, None]
    assert col(spark, [1, 45021], "int", V.excel_date) == [datetime.date(1899, 12, 31), d]


def test_keys(spark):
    assert col(spark, ["1.2. Risk / Event (total)", "!!", None, "x" * 100], "string", T.semantic_key) == ["risk_event_total", "unspecified", "unspecified", "x" * 80]
    assert col(spark, ["WMP.0123", "wmp.7", "WMP", None], "string", V.tracking_id) == ["WMP.123", "WMP.7", None, None]
    assert col(spark, ["12.0", "12.5", "A.0"], "string", V.identifier) == ["12", "12.5", "A"]
    assert col(spark, ["b; a;;b ", None], "string", V.split_ids) == [["a", "b"], None]
    assert col(spark, ["A", "Z", "AA", "XFD"], "string", V.column_index) == [0, 25, 26, 16383]
    assert col(spark, [0, 25, 26, 701, 702, 16383], "int", V.column_letters) == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]


def test_strict_domain_raises(spark):
    with pytest.raises(Exception, match="outside its domain"):
        col(spark, ["a", "z"], "string", lambda x: T.mapped(x, {"a": "1"}, strict=True))
    assert col(spark, ["a", "z", None], "string", lambda x: T.mapped(x, {"a": "1"})) == ["1", None, None]


def test_text_helpers(spark):
    assert col(spark, ["8.3.5 Title", "8. Title", "Title"], "string", T.section_number) == ["8.3.5", "8", None]
    assert col(spark, ["see Figure 3-1 below", "Map 7", "no label"], "string", T.figure_label) == ["figure 3-1", "map 7", None]
    assert col(spark, ["short", "one two three four five"], "string", lambda x: T.truncate_at_word(x, 12)) == ["short", "one two…"]
    assert col(spark, ['```json\n{"a": 1}\n```', "{}"], "string", T.strip_fence) == ['{"a": 1}', "{}"]
    assert col(spark, ["What? Why?", "What is it and how much is it?", "What is it?"], "string", T.decomposition_reason) == ["multiple_questions", "independent_interrogative_clauses", None]
    assert col(spark, ["the Wildfire Mitigation Plan costs"], "string", T.lexical_query) == [["wildfire", "mitigation", "plan", "costs", "wmp"]]
    assert col(spark, ["costs gas"], "string", T.lexical_terms) == [["cost", "gas"]]
    assert col(spark, [[["a|b", "c"], ["d"]]], "array<array<string>>", T.grid_to_markdown) == ["| a\\|b | c |\n| --- | --- |\n| d |  |"]
    assert col(spark, [Decimal("10.00"), Decimal("1.50"), None], "decimal(10,2)", V.plain) == ["10", "1.5", "—"]
    assert col(spark, [1234.5], "double", V.numeric_variants)[0][0] == "1234.5"


def windows(words, size, overlap):
    out, at = [], 0
    while words:
        out.append(words[at : at + size])
        if at + size >= len(words):
            break
        at += size - overlap
    return out


def test_token_windows(spark):
    rows = [[str(i) for i in range(n)] for n in (0, 1, 9, 10, 11, 18, 19, 26, 40)]
    assert col(spark, rows, "array<string>", lambda x: C.token_windows(x, 10, 2)) == [windows(r, 10, 2) for r in rows]


def packs(costs, budget):
    out, pack, used = [], 0, 0
    for c in costs:
        if used and used + c > budget:
            pack, used = pack + 1, 0
        used += c
        out.append(pack)
    return out


def selected(costs, budget):
    out, used = [], 0
    for c in costs:
        out.append(used + c <= budget)
        used += c if out[-1] else 0
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(1, 60), max_size=12), min_size=1, max_size=20), st.integers(1, 100))
def test_greedy_folds(spark, rows, budget):
    assert col(spark, rows, "array<long>", lambda x: C.greedy_pack(x, budget)) == [packs(r, budget) for r in rows]
    assert col(spark, rows, "array<long>", lambda x: C.greedy_select(x, budget)) == [selected(r, budget) for r in rows]


def test_budget_skips_and_goes_on(spark):
    assert col(spark, [[600, 600, 200]], "array<long>", lambda x: C.greedy_select(x, 1100)) == [[True, False, True]]


def test_rrf_does_not_depend_on_channel_order(spark):
    r = random.Random(1)
    rows = [(i, c, k) for c in ("a", "b", "c") for k, i in enumerate(r.sample(range(50), 20), 1)]
    score = lambda x: {y["id"]: round(y["score"], 12) for y in R.reciprocal_rank_fusion(spark.createDataFrame(x, "id long, channel string, rank int")).collect()}
    a = score(rows)
    assert a == score([(i, {"a": "c", "b": "a", "c": "b"}[c], k) for i, c, k in rows])
    assert abs(a[rows[0][0]] - sum(1 / (60 + k) for i, _, k in rows if i == rows[0][0])) < 1e-9


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "s double, y int")
    assert E.roc_auc(df, "s", "y").first()["auc"] == 0.875


def test_platt(spark):
    rows = [("a", i / 10, int(i > 4)) for i in range(10)] + [("b", 0.5, 1)]
    out = {r["g"]: r for r in E.platt_curves(spark.createDataFrame(rows, "g string, s double, y int"), "g", "s", "y").collect()}
    assert out["a"]["a"] > 1 and out["b"]["a"] is None  # one class: no curve
    assert col(spark, [0.7], "double", lambda x: E.platt(x, F.lit(float("nan")), F.lit(float("nan")))) == [0.7]


def test_citation_scores(spark):
    df = spark.createDataFrame([([1], [1]), ([1, 2, 2], [2, 3]), ([], [1])], "c array<int>, e array<int>")
    got = [tuple(r) for r in df.select(*E.citation_scores(F.col("c"), F.col("e"))).collect()]
    assert got == [(1.0, 1.0, True), (0.5, 0.5, False), (0.0, 0.0, False)]


def test_lexical_weights(spark):
    df = spark.createDataFrame([(["a", "b", "a"], ["b"])], "x array<string>, y array<string>")
    assert df.select(R.weighted_frequency(F.array(F.lit("a")), [(F.col("x"), 0.5), (F.col("y"), 9.0)])).first()[0] == 1.0


def test_acronyms_at_accented_letters_as_in_sql(spark):
    import duckdb

    from lodestrata.queries.retrieval import _light_terms

    texts = ["ÉEL LLAR OS", "Wildfire Mitigation Planñ", "ESCI LLAR OSÉ LA DE EL", "a_EL LLAR OS", "Étude Net Zero Plan", "Net\x0bZero Plan Now", "Net\t Zero\nPlan", "ELÀ PAELLE ON ÀON PAELLE EN"]
    got = col(spark, texts, "string", T.lexical_terms)
    con = duckdb.connect()
    want = [con.execute(f"SELECT {_light_terms('t')} FROM (SELECT ? AS t)", [t]).fetchall()[0][0] for t in texts]
    assert [sorted(g) for g in got] == [sorted(w) for w in want]
    assert "elo" in got[0] and "wmp" in got[1]
