"""Binding of question words to plan filters, and the gate before an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def the_only(matches: Column) -> Column:
    distinct = F.array_distinct(matches)
    return F.when(F.size(distinct) == 1, F.get(distinct, F.lit(0)))


def bind_year(question: Column) -> Column:
    """The year a question names, if it names one."""
    return the_only(F.regexp_extract_all(question, F.lit(r"\b(20[23][0-9])\b"), 1)).cast("int")


def bind_quarter(question: Column) -> Column:
    return the_only(F.regexp_extract_all(F.upper(question), F.lit(r"\bQ([1-4])\b"), 1)).cast("int")


def plain_words(text: Column) -> Column:
    """Words of letters, digits and underscores of any script, in lower case."""
    return F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), lambda w: w != "")


def mentions(text: Column, value: Column) -> Column:
    """``value``, punctuation included, stands in ``text`` with no word character at either side."""
    exact = F.regexp_replace(F.lower(F.trim(value)), r"([^\p{L}\p{N}\s])", r"\\$1")
    return F.regexp_like(F.lower(text), F.concat(F.lit(r"(?U)(?<!\w)"), exact, F.lit(r"(?!\w)")))


def vocabulary(rows: DataFrame, promoted: list[str], json_column: str = "dimensions", least: int = 2, most: int = 200) -> DataFrame:
    """(dimension, value) of every dimension that has ``least`` to ``most`` values: promoted
    columns and the keys of the JSON map, in one pass of map-side combined distincts."""
    pairs = F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in promoted))
    inner = F.transform(F.map_entries(json_column), lambda e: F.struct(e["key"].alias("dimension"), e["value"].alias("value")))
    distinct = rows.select(F.explode(F.concat(pairs, inner)).alias("p")).select("p.*").where("value is not null").distinct()
    sizes = distinct.groupBy("dimension").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most))
    return distinct.join(sizes.select("dimension"), "dimension")


def bind_dimensions(questions: DataFrame, vocab: DataFrame) -> DataFrame:
    """(question_id, dimension, value): per dimension the longest value a question mentions, of
    three characters on and not a number or code of digits. A question's words meet the values
    that begin with them in a join; the rest of the value's words are compared where it starts, and
    what is left exactly."""
    words = plain_words(F.col("value"))
    usable = vocab.where((F.length(F.trim("value")) >= 3) & ~F.col("value").rlike(r"^[-.0-9\s]+$")).withColumn("own", words).where("size(own) > 0")
    usable = usable.withColumn("word", F.get("own", F.lit(0)))
    asked = questions.select("question_id", "question", plain_words(F.col("question")).alias("w"))
    asked = asked.select("question_id", "question", "w", F.posexplode("w").alias("at", "word"))
    there = F.slice("w", F.col("at") + 1, F.size("own")) == F.col("own")
    hits = asked.join(usable, "word").where(there & mentions(F.col("question"), F.col("value")))
    return hits.groupBy("question_id", "dimension").agg(F.max_by("value", F.struct(F.length("value").alias("n"), "value")).alias("value"))


#: Tables of records, words that ask for a count, and the score a card needs.
ENTITY_TABLES = (1, 13)
COUNT_CUES = ("how many", "number of", "count of", "how much")
MIN_CARD_SCORE = 0.30


def gate(result: Column, reasons: list[tuple[Column, str]]) -> Column:
    """``answer``, or the first reason to decline that holds, a missing result last."""
    out = F.when(result.isNull(), F.lit("declined: no value")).otherwise(F.lit("answer"))
    for condition, reason in reversed(reasons):
        out = F.when(condition, F.lit(f"declined: {reason}")).otherwise(out)
    return out


def excel_outcome(asked: DataFrame) -> Column:
    """The gate over one row per question: question, card_score (null: no card), card_table,
    metric_key, plan_error, bound_year, refusal, value, contributing. A reason stands before
    those that need what it finds missing."""
    c = {n: F.col(n) for n in asked.columns}
    entity = F.coalesce(c["card_table"].isin(*ENTITY_TABLES), F.lit(False))
    lowered = F.lower(F.coalesce(c["question"], F.lit("")))
    counts = F.lit(False)
    for cue in COUNT_CUES:
        counts = counts | lowered.contains(cue)
    return gate(
        c["value"],
        [
            (c["card_score"].isNull(), "no card"),
            (c["card_score"] < MIN_CARD_SCORE, "card below the floor"),
            (c["card_table"].isNull(), "card names no table"),
            (entity & ~counts, "records, but no count is asked for"),
            (~entity & F.coalesce(c["metric_key"] == "", F.lit(True)), "card names no metric"),
            (c["plan_error"].isNotNull(), "no valid plan"),
            (c["bound_year"].isNull(), "no period"),
            (c["refusal"].isNotNull(), "plan refused"),
            (c["value"].isNull(), "no value"),
            (entity & (c["value"] == 0), "no records match"),
            (~entity & (F.coalesce(c["contributing"], F.lit(0)) == 0), "no facts contribute"),
        ],
    )
