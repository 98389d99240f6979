"""English words to stems: the Porter2 rules as stages of SQL expressions.

A stage is a name and an expression over the stages before; all of them use functions that Spark
and other engines share, so the rules also stand in SQL as they are. A word passes every stage as
a column: no row goes to Python. Meant for distinct words (a stem table), not for every word of
a text. Words with digits and words of one or two letters stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The stop words of English text search.
STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here there when where why how all any "
    "both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

#: Words with stems of their own, and words that stay as they are after the plural is gone.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
FINISHED = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")

#: Endings and what replaces them, where the stem before reaches the first region.
STEP2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion",
    "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al",
    "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")

_SHORT = "(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$"
_REGION = "^({}[^aeiouy]*[aeiouy]+[^aeiouy])"


def _has(word: str, pattern: str) -> str:
    return f"regexp_extract({word}, '({pattern})', 1) <> ''"


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has; a search from the left meets it first."""
    return f"regexp_extract({word}, '({'|'.join(endings)})$', 1)"


def _before(word: str, ending: str) -> str:
    return f"substr({word}, 1, length({word}) - length({ending}))"


def _mapped(key: str, table: dict[str, str]) -> str:
    return "CASE " + key + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _vowels_marked(word: str) -> str:
    for v in "aeiouy":
        word = f"replace({word}, '{v}y', '{v}Y')"
    return word


#: (name, expression): ``w`` is the word, ``stem`` the last stage.
STAGES: tuple[tuple[str, str], ...] = (
    ("y0", _vowels_marked("CASE WHEN substr(w, 1, 1) = 'y' THEN concat('Y', substr(w, 2)) ELSE w END")),
    ("e1", f"regexp_extract(y0, '{_REGION.format('gener|commun|arsen|')}', 1)"),
    ("r1", "CASE WHEN e1 = '' THEN length(y0) ELSE length(e1) END"),
    ("e2", f"regexp_extract(substr(y0, r1 + 1), '{_REGION.format('')}', 1)"),
    ("r2", "CASE WHEN e2 = '' THEN length(y0) ELSE r1 + length(e2) END"),
    # plurals
    ("x1", _ending("y0", ("sses", "ied", "ies", "us", "ss", "s"))),
    ("p1", _before("y0", "x1")),
    ("y1", f"CASE WHEN x1 = 'sses' THEN concat(p1, 'ss') WHEN x1 IN ('ied', 'ies') THEN concat(p1, CASE WHEN length(p1) > 1 THEN 'i' ELSE 'ie' END) WHEN x1 = 's' AND {_has('y0', '[aeiouy].+s$')} THEN p1 ELSE y0 END"),
    # past tense and participles
    ("x2", _ending("y1", ("eedly", "ingly", "edly", "eed", "ing", "ed"))),
    ("p2", _before("y1", "x2")),
    ("q2", f"CASE WHEN {_has('p2', '(at|bl|iz)$')} THEN concat(p2, 'e') WHEN {_has('p2', '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} THEN substr(p2, 1, length(p2) - 1) WHEN length(p2) <= r1 AND {_has('p2', _SHORT)} THEN concat(p2, 'e') ELSE p2 END"),
    ("y2", f"CASE WHEN x2 IN ('eed', 'eedly') THEN CASE WHEN length(p2) >= r1 THEN concat(p2, 'ee') ELSE y1 END WHEN x2 <> '' AND {_has('p2', '[aeiouy]')} THEN q2 ELSE y1 END"),
    ("y3", f"CASE WHEN {_has('y2', '.[^aeiouy][yY]$')} THEN concat(substr(y2, 1, length(y2) - 1), 'i') ELSE y2 END"),
    # derived words
    ("x4", _ending("y3", (*STEP2, "ogi", "li"))),
    ("p4", _before("y3", "x4")),
    ("y4", f"CASE WHEN x4 = '' OR length(p4) < r1 THEN y3 WHEN x4 = 'ogi' THEN CASE WHEN {_has('p4', 'l$')} THEN concat(p4, 'og') ELSE y3 END WHEN x4 = 'li' THEN CASE WHEN {_has('p4', '[cdeghkmnrt]$')} THEN p4 ELSE y3 END ELSE concat(p4, {_mapped('x4', STEP2)}) END"),
    ("x5", _ending("y4", (*STEP3, "ative"))),
    ("p5", _before("y4", "x5")),
    ("y5", f"CASE WHEN x5 = '' OR length(p5) < r1 THEN y4 WHEN x5 = 'ative' THEN CASE WHEN length(p5) >= r2 THEN p5 ELSE y4 END ELSE concat(p5, {_mapped('x5', STEP3)}) END"),
    ("x6", _ending("y5", (*STEP4, "ion"))),
    ("p6", _before("y5", "x6")),
    ("y6", f"CASE WHEN x6 = '' OR length(p6) < r2 THEN y5 WHEN x6 = 'ion' THEN CASE WHEN {_has('p6', '[st]$')} THEN p6 ELSE y5 END ELSE p6 END"),
    # a last e or l
    ("p7", "substr(y6, 1, length(y6) - 1)"),
    ("y7", f"CASE WHEN {_has('y6', 'e$')} AND (length(p7) >= r2 OR length(p7) >= r1 AND NOT ({_has('p7', _SHORT)})) THEN p7 WHEN {_has('y6', 'll$')} AND length(p7) >= r2 THEN p7 ELSE y6 END"),
    ("stem", f"CASE WHEN length(w) < 3 OR NOT ({_has('w', '^[a-z]+$')}) THEN w WHEN w IN ({', '.join(repr(x) for x in IRREGULAR)}) THEN {_mapped('w', IRREGULAR)} WHEN y1 IN ({', '.join(map(repr, FINISHED))}) THEN y1 ELSE replace(y7, 'Y', 'y') END"),
)


def with_stems(words: DataFrame, word: str, name: str = "stem") -> DataFrame:
    """``words`` with one more column: the stem of its column ``word``."""
    own = words.columns
    out = words.withColumn("w", F.col(word))
    for stage, expression in STAGES:
        out = out.withColumn(stage, F.expr(expression))
    return out.select(*own, F.col("stem").alias(name))


def stems_sql(source: str, word: str, name: str) -> str:
    """The same in SQL: common table expressions after which ``name`` has (word, stem) of ``source``'s column."""
    parts, last = [f"{name}_w AS (SELECT {word} AS word, {word} AS w FROM {source})"], f"{name}_w"
    for i, (stage, expression) in enumerate(STAGES):
        parts.append(f"{name}_{i} AS (SELECT *, {expression} AS {stage} FROM {last})")
        last = f"{name}_{i}"
    return ", ".join([*parts, f"{name} AS MATERIALIZED (SELECT word, stem FROM {last})"])
