"""Chunking, sections, links."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.operators import chunking as C
from lodestrata.operators import folds

from .registry import query, read


@query("""WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), n AS (SELECT doc_id, w, CASE WHEN len(w) <= 100 THEN 0 ELSE CAST(ceil((len(w) - 100) / 80.0) AS INTEGER) END AS last FROM d), c AS (SELECT doc_id, w, unnest(range(0, last + 1)) AS i FROM n)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, len(list_slice(w, i * 80 + 1, i * 80 + 100)) AS n_tokens, sha256(array_to_string(list_slice(w, i * 80 + 1, i * 80 + 100), ' ')) AS content_hash FROM c WHERE length(array_to_string(list_slice(w, i * 80 + 1, i * 80 + 100), ' ')) >= 20""")
def q_chunk_window(spark, sf_dir):
    w = C.token_windows(F.split("text", " "), 100, 20)
    c = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(w).alias("chunk_index", "words"))
    body = F.array_join("words", " ")
    return c.where(F.length(body) >= 20).select("doc_id", "chunk_index", F.size("words").cast("long").alias("n_tokens"), F.sha2(body.cast("binary"), 256).alias("content_hash"))


_COSTS = "SELECT conv_id, list(CAST(greatest(1, ceil(length(text) / 4)) AS BIGINT) ORDER BY turn, role, sha256(text)) AS costs FROM conversations GROUP BY conv_id"


def _turns(spark, sf_dir):
    """Estimated tokens of the turns of conversations; equal turns are ordered by a hash of their text, which stays where it is."""
    c = read(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("tie"), T.token_estimate(F.col("text")).cast("long").alias("cost"))


_ORDER = ("turn", "role", "tie")


def _fold(budget: int, skip: bool) -> str:
    """The same fold as a recursive query over item numbers."""
    if skip:
        step = f"CASE WHEN used + costs[i + 1] <= {budget} THEN used + costs[i + 1] ELSE used END, CASE WHEN used + costs[i + 1] <= {budget} THEN 1 ELSE 0 END"
    else:
        step = f"CASE WHEN used > 0 AND used + costs[i + 1] > {budget} THEN costs[i + 1] ELSE used + costs[i + 1] END, out + CASE WHEN used > 0 AND used + costs[i + 1] > {budget} THEN 1 ELSE 0 END"
    return f"WITH RECURSIVE c AS ({_COSTS}), f(conv_id, costs, i, used, out) AS (SELECT conv_id, costs, 0, 0::BIGINT, 0 FROM c UNION ALL SELECT conv_id, costs, i + 1, {step} FROM f WHERE i < len(costs))"


@query(_fold(200, False) + " SELECT conv_id, i - 1 AS item, out AS pack FROM f WHERE i > 0")
def q_greedy_pack(spark, sf_dir):
    return folds.packed(_turns(spark, sf_dir), ["conv_id"], _ORDER, "cost", 200).select("conv_id", "item", "pack")


@query(_fold(300, True) + " SELECT conv_id, i - 1 AS item, out = 1 AS kept FROM f WHERE i > 0")
def q_prompt_budget(spark, sf_dir):
    return folds.selected(_turns(spark, sf_dir), ["conv_id"], _ORDER, "cost", 300).select("conv_id", "item", "kept")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), s AS (SELECT doc_id, i, sum(CAST(greatest(1, ceil(length(line) / 4)) AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM l)
SELECT doc_id, greatest(count(*) FILTER (used <= 200), least(4, max(i))) AS lines_kept FROM s GROUP BY doc_id""")
def q_fit_lines(spark, sf_dir):
    """Lines that fit 200 tokens, at least four: a running sum inside the row, no shuffle."""
    costs = F.transform(F.split("text", "\n"), lambda x: T.token_estimate(x).cast("long"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).cast("long").alias("n"))
    fold = F.aggregate(costs, zero, lambda a, c: F.struct((a["used"] + c).alias("used"), (a["n"] + F.when(a["used"] + c <= 200, 1).otherwise(0)).alias("n")), lambda a: a["n"])
    return read(spark, sf_dir, "documents").select("doc_id", F.greatest(fold, F.least(F.lit(4), F.size(costs)).cast("long")).alias("lines_kept"))


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 AS depth, lead(l_partkey % 3) OVER w AS nd, lead(l_linenumber) OVER w AS ends_at FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) SELECT l_orderkey, l_linenumber, depth, ends_at FROM o WHERE nd IS NULL OR nd <= depth""")
def q_leaf_sections(spark, sf_dir):
    o = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 3).alias("depth"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("pos"))
    out = C.leaf_sections(o, "l_orderkey", "pos", "depth")
    return out.select("l_orderkey", "l_linenumber", "depth", F.col("ends_at.l_linenumber").alias("ends_at"))


@query("""WITH s AS (SELECT l_orderkey AS d, l_linenumber AS a, l_linenumber + 1 + l_partkey % 3 AS b, l_linenumber * 100000 + l_partkey AS leaf FROM lineitem), p AS (SELECT DISTINCT l_orderkey AS d, l_linenumber + 1 AS page FROM lineitem)
SELECT d AS document, page, arg_max(leaf, {'a': a, 'l': leaf}) AS leaf FROM p JOIN s USING (d) WHERE a <= page AND page <= b GROUP BY 1, 2""")
def q_interval_join(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    s = li.select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("a"), (F.col("l_linenumber") + 1 + F.col("l_partkey") % 3).alias("b"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("leaf"))
    p = li.select(F.col("l_orderkey").alias("document"), (F.col("l_linenumber") + 1).alias("page")).distinct()
    return C.innermost(p, s, "document", "page", "a", "b", "leaf")


@query("""WITH d AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[.!?]\\s+'), lambda s: s <> '') AS s FROM documents), p AS (SELECT doc_id, s, list_position(list_transform(s, lambda x: contains(lower(x), 'license')), true) AS pos FROM d)
SELECT doc_id, CASE WHEN pos > 0 THEN array_to_string(list_slice(s, greatest(pos - 1, 1), pos + 1), '. ') END AS around FROM p""")
def q_sentence_window(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", C.sentence_window(F.col("text"), F.lit("license")).alias("around"))


_MENTIONS = """f AS (SELECT p_partkey AS figure, p_brand AS document, p_size AS page, 'figure ' || CAST(p_size % 7 AS VARCHAR) AS label FROM part WHERE p_partkey % 4 = 0),
n AS (SELECT p_partkey AS chunk, p_brand AS document, p_size AS page, 'see Figure ' || CAST(p_partkey % 7 AS VARCHAR) || ' of ' || p_name AS content FROM part WHERE p_partkey % 4 <> 0)"""


@query(f"""WITH {_MENTIONS}, t1 AS (SELECT figure, chunk, 1 AS tier, row_number() OVER (PARTITION BY figure ORDER BY abs(n.page - f.page), chunk) AS r FROM f JOIN n ON f.document = n.document AND contains(lower(content), label || ' of')),
t2 AS (SELECT figure, chunk, 2 AS tier, row_number() OVER (PARTITION BY figure ORDER BY abs(n.page - f.page), chunk) AS r FROM f JOIN n ON f.document = n.document AND abs(n.page - f.page) <= 3),
u AS (SELECT figure, chunk, tier FROM t1 WHERE r = 1 UNION ALL SELECT figure, chunk, tier FROM t2 WHERE r = 1)
SELECT f.figure, coalesce(arg_min(u.chunk, u.tier), -1) AS chunk, coalesce(min(u.tier), 3) AS tier FROM f LEFT JOIN u ON f.figure = u.figure GROUP BY f.figure""")
def q_figure_link(spark, sf_dir):
    """Figures of one document, page and label have one answer: the nearest chunk that names the label,
    else the nearest within three pages. Chunks come down to the first of a page before they meet."""
    p = read(spark, sf_dir, "part")
    f = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("figure"), F.col("p_brand").alias("document"), F.col("p_size").alias("page"), (F.col("p_size") % 7).cast("string").alias("label"))
    n = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("chunk"), F.col("p_brand").alias("document"), F.col("p_size").alias("at"), F.lower(F.concat(F.lit("see Figure "), (F.col("p_partkey") % 7).cast("string"), F.lit(" of "), "p_name")).alias("content"))
    named = n.select("document", "chunk", "at", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("figure ([0-9]+) of"), 1))).alias("label"))
    first = C.nearest(f, named, ["document", "label"], "page", "at", "chunk").select("document", "label", "page", F.col("chunk").alias("named"))
    pages = n.groupBy("document", "at").agg(F.min("chunk").alias("chunk")).select("document", "at", "chunk", F.explode(F.sequence(F.col("at") - 3, F.col("at") + 3)).alias("page"))
    near = pages.groupBy("document", "page").agg(F.min(F.struct(F.abs(F.col("at") - F.col("page")).alias("away"), "chunk")).alias("near"))
    found = f.join(first, ["document", "label", "page"], "left").join(near, ["document", "page"], "left")
    tier = F.when(F.col("named").isNotNull(), 1).when(F.col("near").isNotNull(), 2).otherwise(3)
    return found.select("figure", F.coalesce("named", "near.chunk", F.lit(-1)).alias("chunk"), tier.alias("tier"))


@query("""SELECT doc_id, string_split(text, chr(10) || 'Describing context:')[1] || chr(10) || 'Describing context: ' || source AS enriched FROM documents""")
def q_enrich_idempotent(spark, sf_dir):
    mark = "\nDescribing context:"
    enrich = lambda c: F.concat(F.substring_index(c, mark, 1), F.lit(mark + " "), F.col("source"))
    return read(spark, sf_dir, "documents").select("doc_id", enrich(enrich(F.col("text"))).alias("enriched"))


@query("""WITH RECURSIVE o AS (SELECT l_orderkey AS d, row_number() OVER w AS n, l_partkey % 3 AS depth, CASE WHEN l_suppkey % 5 = 0 THEN 'File' || l_suppkey || '.PDF' ELSE 'S' || l_suppkey END AS title FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
 up AS (SELECT o.*, (SELECT max(a.n) FROM o a WHERE a.d = o.d AND a.n < o.n AND a.depth < o.depth) AS parent FROM o),
 t AS (SELECT d, n, depth, title, title AS breadcrumb, CASE WHEN title LIKE '%.PDF' THEN title END AS sub_document FROM up WHERE parent IS NULL
  UNION ALL SELECT u.d, u.n, u.depth, u.title, CASE WHEN u.title LIKE '%.PDF' THEN u.title ELSE t.breadcrumb || ' > ' || u.title END, CASE WHEN u.title LIKE '%.PDF' THEN u.title ELSE t.sub_document END FROM up u JOIN t ON u.d = t.d AND u.parent = t.n)
SELECT d AS document, n, CAST(depth AS INTEGER) AS depth, title, breadcrumb, sub_document FROM t""", long="n")
def q_section_paths(spark, sf_dir):
    title = F.when(F.col("l_suppkey") % 5 == 0, F.concat(F.lit("File"), F.col("l_suppkey").cast("string"), F.lit(".PDF "))).otherwise(F.concat(F.lit(" S"), F.col("l_suppkey").cast("string")))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    o = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document"), F.row_number().over(w).alias("n"), (F.col("l_partkey") % 3).alias("depth"), title.alias("title"))
    return C.section_paths(o, "document", "n", "depth", "title")


@query("""WITH p AS (SELECT conv_id AS document, turn AS page, any_value(coalesce(text, '')) AS text FROM conversations GROUP BY ALL), s AS (SELECT document, page AS section, page AS first, page + 1 + page % 3 AS until FROM p)
SELECT s.document, section, regexp_replace(string_agg(p.text, chr(10) ORDER BY p.page), '^\\s+|\\s+$', '', 'g') AS text FROM s JOIN p ON s.document = p.document AND p.page >= first AND p.page < until GROUP BY 1, 2""")
def q_section_text(spark, sf_dir):
    """Conversations as documents, turns as their pages; every turn opens a section of one to three."""
    p = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("document"), F.col("turn").alias("page")).agg(F.first("text").alias("text"))
    s = p.select("document", F.col("page").alias("section"), F.col("page").alias("first"), (F.col("page") + 1 + F.col("page") % 3).alias("until"))
    return C.section_texts(s, p, "document", "section", "first", "until", "page", "text").select("document", "section", "text")
