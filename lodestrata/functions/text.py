"""Text functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t\n\r\f\x0B \x{00A0}]+"
#: A letter, digit or underscore of a word, and blanks between words, both ASCII.
WORD, BLANK = "[0-9A-Za-z_]", r"[\t\n\f\r ]+"
#: Words that carry no meaning for lexical search.
STOPWORDS = (
    "about after also among and are before between did does for from have how into many much not over that the their "
    "them then these this through under what when where which who with would"
).split()
#: A question word that opens a second clause.
SECOND_CLAUSE = (
    r"(?i)(?:\b(?:and|or)\b|[.;?])\s*,?\s*"
    r"(?:what|who|when|where|why|how|which|is|are|was|were|do|does|did|has|have|can|could|should|would|will)\b"
)
#: Phrases of source labels and how questions say them.
LABEL_PHRASES = (
    (r"\(s\)", "s"),
    (r"net addition \(or removal\)\s*-\s*", "net change in "),
    (r"^number of overhead circuit miles upgraded$", "overhead circuit miles upgraded"),
    (r"\b95 percentile\b", "95th percentile"),
    (r"\bcold end cotter keys\b", "cold-end cotter keys"),
    (r"\bother\s*\(specify\)\b", "other equipment"),
    (r"\bconductor\s*-\s*veg\b", "vegetation-related conductor"),
)
#: Acronyms that labels spell in any case.
LABEL_ACRONYMS = ("PSPS", "HFTD", "FPI", "CALFIRE", "OPI", "SAIDI", "SAIFI", "SCADA", "WMP")


def clean(x: Column) -> Column:
    """Whitespace runs, no-break spaces included, as one space; blank is null. NA stays text."""
    return F.nullif(F.trim(F.regexp_replace(x, SPACE, " ")), F.lit(""))


def na_to_null(x: Column) -> Column:
    """Null for the ways a cell says "not applicable"."""
    return F.when(~F.lower(clean(x)).isin("n/a", "na", "not applicable"), clean(x))


def value_and_status(x: Column, absent: Column, absent_status: str, present_status: str = "reported") -> tuple[Column, Column]:
    """A value and why it is or is not there."""
    missing = F.coalesce(absent, F.lit(True))
    return F.when(~missing, x), F.when(missing, F.lit(absent_status)).otherwise(F.lit(present_status))


def mapped(x: Column, mapping: dict[str, str], strict: bool = False) -> Column:
    """Closed-domain mapping; unknown values become null, or with ``strict`` fail the query."""
    table = F.create_map(*(F.lit(v) for kv in mapping.items() for v in kv))
    found = F.try_element_at(table, x)
    if strict:
        return F.when(x.isNull(), F.lit(None).cast("string")).when(found.isNull(), F.raise_error(F.concat(F.lit("value outside its domain: "), x))).otherwise(found)
    return found


def semantic_key(x: Column) -> Column:
    """Stable snake-case key of a label, at most 80 characters."""
    body = F.regexp_replace(F.lower(clean(x)), r"^[0-9]+(\.[0-9]+)*[.)]?\s+", "")
    slug = F.regexp_replace(F.regexp_replace(body, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(slug, 1, 80), "_+$", ""), F.lit("")), F.lit("unspecified"))


def display_label(x: Column) -> Column:
    return F.regexp_replace(clean(x), r"^[0-9]+(\.[0-9]+)*[.)]?\s+", "")


def semantic_label(*parts: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(" / ", *parts), F.lit("")), F.lit("Unspecified"))


def truncate_at_word(x: Column, n: int) -> Column:
    """At most n characters, cut at a word's end, with an ellipsis if cut."""
    head = F.regexp_extract(x, rf"(?s)^(.{{0,{n - 1}}})[ \t\r\n]", 1)
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.when(head != "", F.rtrim(head)).otherwise(F.substring(x, 1, n - 1)), F.lit("…")))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def fold_punctuation(x: Column) -> Column:
    """Typographic quotes, dashes and no-break spaces as ASCII, character for character."""
    return F.translate(x, "‘’“”–— ", "''\"\"-- ")


def section_number(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"^([0-9]+(\.[0-9]+)*)\.?[ \t]", 1), F.lit(""))


def figure_label(x: Column) -> Column:
    """The first label of a figure or the like, blanks as one; the word may stand right before its number."""
    return F.nullif(F.lower(squeeze(F.regexp_extract(x, r"(?i)\b((?:figure|fig|table|map|chart|exhibit)\.?\s*[0-9]+(?:[-.][0-9]+)*)", 1))), F.lit(""))


def trim_to_heading(text: Column, title: Column) -> Column:
    """Text from its section title on, if the title has two words and eight characters and occurs."""
    at = F.call_function("instr", F.lower(fold_punctuation(text)), F.lower(fold_punctuation(title)))
    usable = (F.length(title) >= 8) & (F.size(F.split(F.trim(title), " +")) >= 2) & (at > 0)
    return F.when(usable, F.call_function("substr", text, at)).otherwise(text)


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def acronyms(x: Column) -> Column:
    """First letters of runs of three or more capitalised words, in lower case. Words and blanks are
    ASCII, spelled out: an accented letter beside a run bounds it, as it does in SQL engines, where
    Java's own word boundary depends on its version."""
    runs = F.regexp_extract_all(x, F.lit(rf"(?<!{WORD})([A-Z][A-Za-z]+(?:{BLANK}[A-Z][A-Za-z]+){{2,}})(?!{WORD})"), 1)
    return F.transform(runs, lambda r: F.lower(F.array_join(F.transform(F.split(r, BLANK), lambda w: F.substring(w, 1, 1)), "")))


def lexical_query(x: Column) -> Column:
    """Distinct search terms: words of three letters on that mean something, then acronyms."""
    stop = F.array(*map(F.lit, STOPWORDS))
    words = F.filter(tokens(x), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))
    return F.array_distinct(F.concat(words, acronyms(x)))


def lexical_terms(x: Column) -> Column:
    """Search terms with a light plural stem, and the acronyms of capitalised phrases."""
    stop = F.array(*map(F.lit, STOPWORDS))
    words = F.filter(tokens(x), lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))
    stems = F.transform(words, lambda t: F.when(F.length(t) > 4, F.regexp_replace(t, "s$", "")).otherwise(t))
    return F.array_distinct(F.concat(stems, acronyms(F.coalesce(x, F.lit("")))))


def token_estimate(x: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(x) / 4)).cast("int")


def strip_fence(x: Column) -> Column:
    """JSON text without a Markdown fence around it."""
    return F.regexp_replace(F.trim(x), r"^```(?:json)?[ \t]*\n|\n?```$", "")


def squeeze(x: Column) -> Column:
    """Blanks at the ends dropped, runs of them as one space."""
    return F.trim(F.regexp_replace(x, SPACE, " "))


def decomposition_reason(x: Column) -> Column:
    """Why a question holds several, or null."""
    q = squeeze(x)
    return F.when(F.length(q) - F.length(F.replace(q, F.lit("?"), F.lit(""))) > 1, F.lit("multiple_questions")).when(F.regexp_like(q, F.lit(SECOND_CLAUSE)), F.lit("independent_interrogative_clauses"))


def question_label(x: Column) -> Column:
    """A source's label as a question says it: no leading number, phrases and acronyms as written out."""
    said = reduce(lambda c, rule: F.regexp_replace(c, "(?i)" + rule[0], rule[1]), LABEL_PHRASES, F.regexp_replace(squeeze(x), r"^[0-9]+\.\s*", ""))
    return reduce(lambda c, a: F.regexp_replace(c, rf"(?i)\b{a}\b", a), LABEL_ACRONYMS, said)


def markdown_cell(x: Column) -> Column:
    return F.replace(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\.{4,}|[\t\n\r ]+", " ")), F.lit("|"), F.lit("\\|"))


def markdown_row(cells: Column, width: Column) -> Column:
    padded = F.concat(F.transform(cells, markdown_cell), F.array_repeat(F.lit(""), F.greatest(width - F.size(cells), F.lit(0))))
    return F.concat(F.lit("| "), F.array_join(padded, " | "), F.lit(" |"))


def grid_to_markdown(grid: Column) -> Column:
    """array<array<string>> as a Markdown table; ragged rows are padded."""
    width = F.array_max(F.transform(grid, F.size))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    rows = F.transform(grid, lambda r: markdown_row(r, width))
    return F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, F.lit(2), F.size(rows))), "\n")


def dot_ratio(x: Column) -> Column:
    return F.try_divide(F.length(x) - F.length(F.replace(x, F.lit("."), F.lit(""))), F.length(x))


def contextual_text(document: Column, section: Column, chunk: Column, budget: int) -> Column:
    """Document, section and chunk lines; the document line goes first when over budget (in
    estimated tokens), and a text still over budget is null for the caller to reject."""
    parts = lambda *x: F.concat_ws("\n", *x)
    full = parts(F.concat(F.lit("Document: "), document), F.concat(F.lit("Section: "), section), F.concat(F.lit("Chunk: "), chunk))
    short = parts(F.concat(F.lit("Section: "), section), F.concat(F.lit("Chunk: "), chunk))
    return F.when(token_estimate(full) <= budget, full).when(token_estimate(short) <= budget, short)


def overlap_prior(query: Column, caption: Column) -> Column:
    """Shared terms over the root of both counts; zero if either side has none."""
    both = F.sqrt(F.size(query).cast("double") * F.size(caption))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(query, caption)).cast("double"), both), F.lit(0.0))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
