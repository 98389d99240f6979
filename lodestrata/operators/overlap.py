"""Evidence for a value in prose: which chunk says it, with its concept and period.

A needle is a question with a concept and an exact value. A chunk holds it if one printed form of
the value stands there with no digit or point beside it, one of the question's years is a word of
it, one of its quarters occurs, and two of the concept's words (all, if there are fewer) do. The
first chunk by number is the evidence.

No needle meets every chunk. A form that is bounded on both sides ends in a whole run of digits
and points, so chunks and forms meet in a join on equal runs and years; what is left is checked
with the full pattern. Up to FEW_FORMS forms go to the chunks, which are read once and not moved;
more meet the chunks' runs in a shuffle without the texts, which are read again for the pairs only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions import values as V
from lodestrata.sources.scratch import written

#: Printed forms (by year) that are broadcast.
FEW_FORMS = 200_000
#: Words that name no concept.
NO_CONCEPT = "a an and at by did for from how in of on or report reported the to value was were what which with".split()


def normalised(text: Column) -> Column:
    """Lower case; all but letters, digits, point, percent and minus as one blank."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9.%-]+", " "))


def concept_words(concept: Column) -> Column:
    words = F.regexp_extract_all(normalised(concept), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(words, lambda t: (F.length(t) >= 3) & ~t.isin(NO_CONCEPT) & ~F.regexp_like(t, F.lit("^[0-9]+$"))))


def _or_none(values: Column) -> Column:
    """The values, or one empty text that stands for no condition."""
    return F.when(F.size(values) > 0, values).otherwise(F.array(F.lit("")))


def find_evidence(needles: DataFrame, chunks: DataFrame) -> DataFrame:
    """(needle_id, chunk_id) for the needles (needle_id, question, concept, value: decimal) that a
    chunk (chunk_id, caption, content) holds."""
    years = F.array_distinct(F.regexp_extract_all("question", F.lit(r"\b(20[2-3][0-9])\b"), 1))
    quarters = F.array_distinct(F.transform(F.regexp_extract_all("question", F.lit(r"(?i)\b(Q[1-4])\b"), 1), F.lower))
    forms = F.array_distinct(F.transform(V.numeric_variants(F.col("value")), normalised))
    asked = needles.select("needle_id", concept_words(F.col("concept")).alias("words"), quarters.alias("quarters"), F.explode(_or_none(years)).alias("year"), forms.alias("forms"))
    asked = asked.select("*", F.explode("forms").alias("form")).drop("forms").withColumn("run", F.regexp_extract("form", "([0-9.]+)$", 1))
    asked = written(asked, "forms")
    few = asked.limit(FEW_FORMS + 1).count() <= FEW_FORMS
    text = normalised(F.concat_ws(" ", F.coalesce("caption", F.lit("")), F.coalesce("content", F.lit(""))))
    texts = chunks.select("chunk_id", text.alias("text"))
    runs = F.explode_outer(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9.]+)"), 1)))  # outer: Spark would compute the array twice more to see that it is not empty
    if few:
        word = F.contains(F.concat(F.lit(" "), "text", F.lit(" ")), F.concat(F.lit(" "), "year", F.lit(" ")))
        period = ((F.col("year") == "") | word) & ((F.size("quarters") == 0) | F.exists("quarters", lambda q: F.contains(F.col("text"), q)))
        held = texts.select("*", runs.alias("run")).join(F.broadcast(asked), "run").where(period)
    else:
        said = texts.select(
            "chunk_id",
            F.array_union(F.filter(F.array_distinct(F.split("text", " ")), lambda t: F.regexp_like(t, F.lit("^20[2-3][0-9]$"))), F.array(F.lit(""))).alias("years"),
            F.filter(F.array(*(F.lit(f"q{i}") for i in range(1, 5))), lambda q: F.contains(F.col("text"), q)).alias("said"),
            runs.alias("run"),
        )
        said = said.select("chunk_id", "said", "run", F.explode("years").alias("year"))
        quarter = (F.size("quarters") == 0) | F.arrays_overlap("quarters", "said")
        pairs = written(asked.join(said, ["run", "year"]).where(quarter).select("needle_id", "chunk_id", "form", "words").distinct(), "pairs")
        held = pairs.join(texts, "chunk_id")
    pattern = F.concat(F.lit("(?<![0-9.])"), F.replace(F.col("form"), F.lit("."), F.lit("[.]")), F.lit("(?![0-9.])"))
    enough = F.size(F.filter("words", lambda w: F.contains(F.col("text"), w))) >= F.least(F.lit(2), F.size("words"))
    return held.where(F.regexp_like("text", pattern) & enough).groupBy("needle_id").agg(F.min("chunk_id").alias("chunk_id"))
