"""Questions split into search queries, the writer's replies being an input column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T

MODES = ("off", "auto", "always")
MAX_SUB_QUESTIONS = 2


def sub_questions(question: Column, reply: Column, most: int = MAX_SUB_QUESTIONS) -> Column:
    """Sub-questions of a reply, a JSON array of strings, whether fenced or not: blanks folded, the
    first of each spelling in any case, none that repeats the question. Null for any other reply."""
    body = T.strip_fence(reply)
    is_list = F.schema_of_variant(F.try_parse_json(body)) == "ARRAY<STRING>"
    items = F.when(is_list, F.from_json(body, "array<string>"))
    items = F.when(~F.exists(items, lambda s: s.isNull()), items)
    folded = F.transform(items, T.squeeze)
    lower = F.transform(folded, F.lower)
    fresh = F.filter(folded, lambda s, i: (s != "") & (F.lower(s) != F.lower(question)) & (F.array_position(lower, F.lower(s)) == i + 1))
    return F.slice(fresh, 1, most)


def rewrite(questions: DataFrame, mode: str, question: str = "question", reply: str = "reply") -> DataFrame:
    """Adds what to search for: ``search_queries`` (the question first), their ``source`` and
    ``reason``. ``off`` and, for a single intent, ``auto`` keep the question alone, whatever the
    reply says; a reply that is missing or no array of strings falls back to it as well. A null
    question counts as empty."""
    if mode not in MODES:
        raise ValueError(f"unknown rewrite mode {mode!r}; one of {MODES}")
    asked = F.trim(F.coalesce(F.col(question), F.lit("")))
    alone, why = F.array(asked), T.decomposition_reason(asked)
    if mode == "off":
        return questions.withColumns({"search_queries": alone, "source": F.lit("disabled"), "reason": F.lit("mode_off")})
    single = F.lit(False) if mode == "always" else why.isNull()
    parts = sub_questions(asked, F.col(reply))
    return questions.withColumns({
        "search_queries": F.when(single | parts.isNull(), alone).otherwise(F.concat(alone, parts)),
        "source": F.when(single, F.lit("simple")).when(parts.isNull(), F.lit("fallback")).otherwise(F.lit("api")),
        "reason": F.lit("mode_always") if mode == "always" else F.coalesce(why, F.lit("single_intent")),
    })
