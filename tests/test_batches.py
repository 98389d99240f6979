"""Plans as rows, range sums, calibration and dyadic spans against their plain forms."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import chunking as C
from lodestrata.operators import evaluation as E
from lodestrata.plans import batch
from lodestrata.plans import generate as G
from lodestrata.plans.execute import execute, metadata
from lodestrata.plans.model import ClarificationNeeded, Filter, Plan, PlanError

FACTS = "fact_id long, revision_id string, table_number int, semantic_metric_key string, measure_name string, metric_name string, value_numeric decimal(18,2), year int, quarter int, region string, line_type string, unit string, dimensions map<string,string>"


def facts(spark):
    from decimal import Decimal

    rng = random.Random(4)
    rows = []
    for i in range(600):
        value = rng.choice([None, Decimal(rng.randint(-500, 9000)) / 100])
        rows.append((i, str(i % 3), rng.choice([2, 3, 14]), rng.choice(["k1", "k2", None]), rng.choice(["m", "n"]), rng.choice(["A", "B", None]), value, rng.choice([2022, 2023, None]), rng.randint(1, 4), rng.choice(["ASIA", "EUROPE", "x:y"]), rng.choice(["d", "t"]), "u2" if i % 50 == 7 else "u1", rng.choice([None, {"nation": "N1"}, {"nation": "N2", "p": "10"}, {"p": "9"}])))
    return spark.createDataFrame(rows, FACTS)


def revisions(spark):
    return spark.createDataFrame([("0", "superseded"), ("1", "active"), ("2", "active"), ("2", "active")], "revision_id string, state string")


def some_plans(n=120, seed=8):
    rng, out = random.Random(seed), {}
    fields = ["year", "quarter", "region", "line_type", "metric_name", "unit"]
    for i in range(n):
        filters = []
        for _ in range(rng.randint(0, 3)):
            name = rng.choice(fields)
            value = {"year": rng.choice([2022, 2023, 2030]), "quarter": rng.randint(1, 4), "region": rng.choice(["ASIA", "x:y", "none"]), "line_type": "d", "metric_name": rng.choice("AB"), "unit": rng.choice(["u1", "u2"])}[name]
            filters.append(Filter(name, rng.choice(["eq", "eq", "ne", "gt", "gte", "lt", "lte"]), value))
        if rng.random() < 0.3:
            filters.append(Filter(*rng.choice([("nation", "eq", "N1"), ("p", "gt", "10"), ("p", "lte", "9")]), json_key=True))
        groups = tuple(rng.sample(["region", "metric_name", "line_type"], rng.choice([0, 0, 1, 2])))
        operation = rng.choice(["aggregate", "rank"]) if groups else "aggregate"
        out[f"p{i}"] = Plan(operation=operation, aggregate=rng.choice(["sum", "avg", "count", "min", "max"]), table_number=rng.choice([None, 2, 3]), semantic_metric_key=rng.choice([None, "k1"]), measure_name=rng.choice([None, None, "n"]), filters=tuple(filters), group_by=groups, descending=rng.random() < 0.5, limit=rng.choice([1, 2, 50]))
    return out


@pytest.mark.parametrize("at_once", [1, 32])
def test_batch_answers_are_those_of_single_plans(spark, monkeypatch, at_once):
    monkeypatch.setattr(batch, "SETS_AT_ONCE", at_once)
    rows, registry, plans = facts(spark).cache(), revisions(spark), some_plans(40 if at_once == 1 else 120)
    got = {}
    for r in batch.answers(batch.plan_rows(spark, plans), rows, registry).collect():
        got.setdefault(r["plan_id"], []).append(r)
    checked = 0
    for name, plan in list(plans.items())[:: 1 if at_once == 1 else 4]:
        mine = sorted(got.get(name, []), key=lambda r: r["place"])
        if mine and mine[0]["status"] == "refused":
            assert metadata(plan, rows, registry).first()["unit_status"] == "refused" and all(r["value"] is None for r in mine)
            continue
        want = [(list(map(lambda v: None if v is None else str(v), r[:-1])), None if r[-1] is None else float(r[-1])) for r in execute(plan, rows, registry).collect()]
        mine = [(r["groups"], r["value"]) for r in mine]
        close = lambda a, b: a == b or (a is not None and b is not None and abs(a - b) < 1e-6)
        assert len(mine) == len(want), (name, plan, mine, want)
        for (g, v), (h, w) in zip(mine, want, strict=True):
            assert g == h and close(v, w), (name, plan, mine, want)
        checked += 1
    assert checked > 10
    rows.unpersist()


def test_batch_of_no_plans(spark):
    none = batch.plan_rows(spark, {"x": Plan()}).where("false")
    assert batch.answers(none, facts(spark), revisions(spark)).collect() == []


def test_verdicts_are_those_of_the_validator(spark):
    rng, plans = random.Random(11), {}
    for i in range(1500):
        filters = tuple(Filter(rng.choice(["year", "reporting_year", "year_basis", "source_vintage_year", "bad", "status"]), rng.choice(["eq", "ne", "like"] if rng.random() < 0.2 else ["eq"]), 1, rng.random() < 0.2) for _ in range(rng.randint(0, 2)))
        plans[str(i)] = Plan(
            source=rng.choice(["facts", "facts", "records", "x"]) if rng.random() < 0.5 else "facts", operation=rng.choice(["aggregate", "rank", "select", "aggregate", "drop"]), aggregate=rng.choice(["sum", "count", "avg", "median"] if rng.random() < 0.4 else ["count"]),
            table_number=rng.choice([None, 2, 14, 15]), filters=filters, group_by=tuple(rng.sample(["region", "status", "zzz"], rng.choice([0, 0, 1]))), json_keys=("k",) if rng.random() < 0.15 else (), order_by=rng.choice([None, None, "value", "region", "k", ""]),
            limit=rng.choice([50, 1, 200, 0, 201] if rng.random() < 0.3 else [50]), year_basis=rng.choice([None, None, "r"]), require_year_basis=rng.random() < 0.8,
        )

    def said(p):
        try:
            p.validate()
        except ClarificationNeeded:
            return "clarify"
        except PlanError:
            return "reject"
        return "accept"

    rows = batch.plan_rows(spark, plans).select("plan_id", F.substring_index(batch.verdict(), ":", 1).alias("v")).collect()
    assert {r["plan_id"]: r["v"] for r in rows} == {k: said(p) for k, p in plans.items()}
    assert len({r["v"] for r in rows}) == 3


def test_questions_are_kept_only_if_their_plans_agree(spark):
    rows = facts(spark).where("year is not null and metric_name is not null and unit = 'u1'")
    made = G.candidates(rows, revisions(spark))
    wrong = made.withColumn("expected", F.when(F.col("kind") == "split_lookup", F.col("expected") + 1).otherwise(F.col("expected")))
    kinds = {r["kind"]: r["count"] for r in G.verified(wrong, rows, revisions(spark)).groupBy("kind").count().collect()}
    every = {r["kind"]: r["count"] for r in made.groupBy("kind").count().collect()}
    assert "split_lookup" not in kinds and kinds["year_scope"] == every["year_scope"] and 0 < kinds["missing_value"] < every["missing_value"]


def test_auc_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 0.1, 0.5, 0.5, rng.random()]), rng.choice([0, 1, 1, None])) for _ in range(400)]
    pairs = [(p, n) for p, y in rows if y == 1 and p is not None for n, z in rows if z == 0 and n is not None]
    want = sum((p > n) + (p == n) / 2 for p, n in pairs) / len(pairs)
    df = spark.createDataFrame(rows, "score double, label int").repartition(7)
    got = E.roc_auc(df, "score", "label")
    assert abs(got.first()["auc"] - want) < 1e-12
    assert E.roc_auc(df.where("label = 1"), "score", "label").first()["auc"] is None


def test_totals_before(spark):
    rows = spark.range(0, 1000, 1, 9).select(((F.col("id") * 37) % 1000).alias("x"), F.when(F.col("id") % 10 > 0, F.col("id") % 7).alias("v"))
    out = E.totals_before(rows, "x", "v", "before")
    assert out._jdf.queryExecution().executedPlan().toString().count("SinglePartition") == 0
    values, total = {r["x"]: (r["v"], r["before"]) for r in out.collect()}, 0
    for x in range(1000):
        assert values[x][1] == total
        total += values[x][0] or 0


def test_platt_steps_on_the_cluster_are_those_on_the_driver(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(g, round(rng.gauss(y, 1), 2), y) for g in "ab" for y in (0, 1) for _ in range(60)] + [("c", 0.5, 1), (None, 1.0, 0), ("a", None, 1), ("a", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    here = {r["g"]: r for r in E.platt_curves(df, "g", "s", "y", steps=5).collect()}
    monkeypatch.setattr(E, "FEW_COUNTS", 0)
    there = {r["g"]: r for r in E.platt_curves(df, "g", "s", "y", steps=5).collect()}
    assert here.keys() == there.keys() == {"a", "b", "c"} and here["c"]["a"] is None and here["c"]["positives"] == 1
    for g in "ab":
        assert abs(here[g]["a"] - there[g]["a"]) < 1e-9 and abs(here[g]["b"] - there[g]["b"]) < 1e-9 and here[g]["negatives"] == 60


def test_dyadic_nodes_cover_a_span_once(spark):
    rng = random.Random(3)
    spans = [(a, a + rng.choice([0, 1, 5, 60, -1])) for a in (rng.randint(-50, 50) for _ in range(200))] + [(0, 10**9), (-(10**9), 10**9), (1, 2**40)]
    rows = spark.createDataFrame(spans, "s long, e long").select("s", "e", C.aligned_nodes(F.col("s"), F.col("e")).alias("nodes")).collect()
    for r in rows:
        nodes = r["nodes"] or []
        assert len(nodes) <= 2 * 62 and sum(1 << n["level"] for n in nodes) == max(0, r["e"] - r["s"] + 1)
        at = r["s"]
        for low, size in sorted((n["node"] << n["level"], 1 << n["level"]) for n in nodes):
            assert low == at
            at += size


def test_innermost_of_long_spans(spark):
    rng = random.Random(7)
    spans = [("d", a, a + rng.choice([0, 3, 1000, 10**9, -5]), f"s{i}") for i, a in enumerate(rng.choices(range(-20, 2000), k=80))]
    points = [("d", p) for p in rng.sample(range(-30, 2500), 300)] + [("e", 1)]
    want = {}
    for d, p in points:
        inside = [(a, leaf) for x, a, b, leaf in spans if x == d and a <= p <= b]
        if inside:
            want[d, p] = max(inside)[1]
    got = C.innermost(spark.createDataFrame(points, "d string, p long"), spark.createDataFrame(spans, "d string, a long, b long, leaf string"), "d", "p", "a", "b", "leaf")
    assert {(r["d"], r["p"]): r["leaf"] for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_streamed_folds(spark):
    from lodestrata.operators import folds

    rng = random.Random(12)
    rows = [(k, i, rng.choice([None, 0, rng.randint(1, 120)]), f"t{i}") for k in (None, "a", "b", *map(str, range(40))) for i in range(rng.randint(1, 30))] + [("hot", i, 7, "t") for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, i int, cost long, text string").repartition(6)
    packs, kept = {}, {}
    for k, i, c, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1])):
        c = c or 0
        pack, used = packs.get(k, [(None, 0, 0)])[-1][1:]
        packs.setdefault(k, []).append((i, pack + 1, c) if used > 0 and used + c > 100 else (i, pack, used + c))
        taken = sum(x for _, x, y in kept.get(k, []) if y)
        kept.setdefault(k, []).append((i, c, taken + c <= 100)) if k != "hot" else None
    got = folds.packed(df, ["k"], ["i"], "cost", 100)
    assert got.columns == ["k", "i", "cost", "text", "item", "pack"]
    assert {(r["k"], r["i"]): (r["item"], r["pack"]) for r in got.collect()} == {(k, i): (n, p) for k, v in packs.items() for n, (i, p, _) in enumerate(v)}
    assert {(r["k"], r["i"]): r["kept"] for r in folds.selected(df.where("k is null or k <> 'hot'"), ["k"], ["i"], "cost", 100).collect()} == {(k, i): y for k, v in kept.items() for i, _, y in v}
    assert folds.packed(df.where("false"), ["k"], ["i"], "cost", 5).collect() == []
