"""Scalar functions, scans and projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions import values as V

from .registry import query, read

_CELL = "'  ' || replace(p_name, ' ', chr(160) || chr(9)) || CASE WHEN p_size % 7 = 0 THEN ' N/A' ELSE '' END || chr(10)"


def _cell():
    return F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \t")), F.when(F.col("p_size") % 7 == 0, F.lit(" N/A")).otherwise(F.lit("")), F.lit("\n"))


def parts(spark, sf_dir):
    return read(spark, sf_dir, "part")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def q_scan_project(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")


@query("SELECT DISTINCT source AS filename, 0 AS page_count FROM documents")
def q_list_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.col("source").alias("filename"), F.lit(0).alias("page_count")).distinct()


@query(rf"SELECT p_partkey, nullif(trim(regexp_replace({_CELL}, '[\t\n\r\f\x0B \x{{00A0}}]+', ' ', 'g')), '') AS cleaned, nullif(trim(regexp_replace(CASE WHEN p_size % 5 = 0 THEN '   ' ELSE 'x ' END, '[\t\n\r\f\x0B \x{{00A0}}]+', ' ', 'g')), '') AS blank FROM part")
def q_clean_text(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", T.clean(_cell()).alias("cleaned"), T.clean(F.when(F.col("p_size") % 5 == 0, F.lit("   ")).otherwise(F.lit("x "))).alias("blank"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE p_brand END AS value FROM part")
def q_na_normalize(spark, sf_dir):
    raw = F.when(F.col("p_size") % 4 == 0, F.lit(" n/a ")).when(F.col("p_size") % 4 == 1, F.lit("Not  Applicable")).otherwise(F.col("p_brand"))
    return parts(spark, sf_dir).select("p_partkey", T.na_to_null(raw).alias("value"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 > 0 THEN p_brand END AS value, CASE WHEN p_size % 4 > 0 THEN 'reported' ELSE 'blank_in_source' END AS status FROM part")
def q_value_status_pair(spark, sf_dir):
    v, s = T.value_and_status(F.col("p_brand"), F.col("p_size") % 4 == 0, "blank_in_source")
    return parts(spark, sf_dir).select("p_partkey", v.alias("value"), s.alias("status"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Fulfilled' WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Partial' END AS status FROM orders")
def q_domain_map(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", T.mapped(F.col("o_orderstatus"), {"F": "Fulfilled", "O": "Open", "P": "Partial"}, strict=True).alias("status"))


@query(r"SELECT p_partkey, CAST(nullif(regexp_extract('Tier ' || CAST(p_size % 3 + 1 AS VARCHAR) || ' ' || p_type, '^Tier ([0-9]) (.*)$', 1), '') AS INTEGER) AS tier, regexp_extract('Tier ' || CAST(p_size % 3 + 1 AS VARCHAR) || ' ' || p_type, '^Tier ([0-9]) (.*)$', 2) AS line FROM part")
def q_compound_split(spark, sf_dir):
    x = F.concat(F.lit("Tier "), (F.col("p_size") % 3 + 1).cast("string"), F.lit(" "), F.col("p_type"))
    return parts(spark, sf_dir).select("p_partkey", F.nullif(F.regexp_extract(x, "^Tier ([0-9]) (.*)$", 1), F.lit("")).cast("int").alias("tier"), F.regexp_extract(x, "^Tier ([0-9]) (.*)$", 2).alias("line"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'Not yet known' WHEN l_returnflag = 'N' THEN 'No return' ELSE 'Return ' || l_returnflag END AS label FROM lineitem")
def q_context_label(spark, sf_dir):
    label = F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), F.lit("Not yet known")).when(F.col("l_returnflag") == "N", F.lit("No return")).otherwise(F.concat(F.lit("Return "), "l_returnflag"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", label.alias("label"))


_NUM = "CASE p_size % 6 WHEN 0 THEN '-' WHEN 1 THEN '$ ' || CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) WHEN 2 THEN CAST(p_size AS VARCHAR) || ' %' WHEN 3 THEN 'about 3' WHEN 4 THEN '1,' || CAST(100 + p_size AS VARCHAR) || '.50' ELSE CAST(p_size AS VARCHAR) END"


def _num():
    m, size = F.col("p_size") % 6, F.col("p_size").cast("string")
    return (
        F.when(m == 0, F.lit("-")).when(m == 1, F.concat(F.lit("$ "), F.col("p_retailprice").cast("decimal(18,2)").cast("string"))).when(m == 2, F.concat(size, F.lit(" %")))
        .when(m == 3, F.lit("about 3")).when(m == 4, F.concat(F.lit("1,"), (F.col("p_size") + 100).cast("string"), F.lit(".50"))).otherwise(size)
    )


@query(rf"""WITH r AS (SELECT p_partkey, {_NUM} AS raw FROM part), b AS (SELECT p_partkey, regexp_replace(regexp_replace(raw, '[,$\s]', '', 'g'), '%$', '') AS s FROM r)
SELECT p_partkey, TRY_CAST(CASE WHEN s NOT IN ('', '-', '+', '.') THEN s END AS DECIMAL(38,18))::DOUBLE AS number, CAST(trunc(TRY_CAST(CASE WHEN s NOT IN ('', '-', '+', '.') THEN s END AS DECIMAL(38,18))::DOUBLE) AS INTEGER) AS whole FROM b""")
def q_parse_numeric(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", V.parse_decimal(_num()).cast("double").alias("number"), V.parse_int(_num()).alias("whole"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS parsed, DATE '1899-12-30' + CAST(40000 + o_custkey % 5000 AS INTEGER) AS serial_date FROM orders")
def q_parse_date(spark, sf_dir):
    m, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = F.when(m == 0, F.date_format(d, "yyyy-MM-dd")).when(m == 1, F.date_format(d, "MM/dd/yyyy")).when(m == 2, F.date_format(d, "yyyy/MM/dd")).otherwise(F.lit("#"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.to_date(d).alias("d"), V.parse_date(raw).alias("parsed"), V.excel_date(40000 + F.col("o_custkey") % 5000).alias("serial_date"))


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS identifier, CASE WHEN p_size % 2 = 0 THEN 'WMP.' || CAST(p_partkey AS VARCHAR) END AS tracking FROM part")
def q_identifier(spark, sf_dir):
    raw = F.concat(F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, F.lit(".0")).otherwise(F.lit("")))
    track = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("wmp."), F.lpad(F.col("p_partkey").cast("string"), 8, "0"))).otherwise(F.col("p_name"))
    return parts(spark, sf_dir).select("p_partkey", V.identifier(raw).alias("identifier"), V.tracking_id(track).alias("tracking"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct([p_brand, 'A' || CAST(p_size AS VARCHAR)])), ',') AS ids FROM part")
def q_split_ids(spark, sf_dir):
    raw = F.concat(F.col("p_brand"), F.lit("; A"), F.col("p_size").cast("string"), F.lit(";;  "), F.col("p_brand"))
    return parts(spark, sf_dir).select("p_partkey", F.array_join(V.split_ids(raw), ",").alias("ids"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size / 24 WHEN 1 THEN p_size * 1000.0 WHEN 2 THEN p_size / 10 * (CASE WHEN p_size / 10 <= 1 THEN 100 ELSE 1 END) ELSE p_size END::DOUBLE AS value,
CASE p_size % 4 WHEN 0 THEN 'days' WHEN 1 THEN 'dollars' WHEN 2 THEN 'percent' ELSE 'miles' END AS unit FROM part""")
def q_unit_convert(spark, sf_dir):
    m = F.col("p_size") % 4
    unit = F.when(m == 0, F.lit("hours")).when(m == 1, F.lit("$1,000")).when(m == 2, F.lit("fraction")).otherwise(F.lit("miles"))
    value = F.when(m == 2, F.col("p_size") / 10).otherwise(F.col("p_size").cast("double"))
    v, u = V.convert(value, unit)
    return parts(spark, sf_dir).select("p_partkey", v.alias("value"), u.alias("unit"))


@query("SELECT p_partkey, 'cmp-' || substr(sha1(p_brand || '|' || p_type || '|' || CAST(p_size AS VARCHAR)), 1, 12) AS key FROM part")
def q_stable_hash(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", V.stable_hash("cmp-", 12, F.col("p_brand"), F.col("p_type"), F.col("p_size").cast("string")).alias("key"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN 'T7-R-' || substr(sha1(p_brand || '|' || p_type), 1, 16) ELSE 'T7-N-' || CAST(p_partkey AS VARCHAR) END AS record_id FROM part")
def q_identity(spark, sf_dir):
    m = F.col("p_size") % 3
    own, part = F.when(m == 0, F.col("p_name")), lambda c: F.when(m == 1, F.col(c))
    return parts(spark, sf_dir).select("p_partkey", V.identity(own, "7", [part("p_brand"), part("p_type")], F.col("p_partkey")).alias("record_id"))


@query(r"""WITH x AS (SELECT p_partkey, CAST(p_size AS VARCHAR) || '.2. ' || p_type || ' / ' || p_brand AS l, CASE WHEN p_size % 3 > 0 THEN p_brand END AS b FROM part)
SELECT p_partkey, regexp_replace(substr(regexp_replace(regexp_replace(lower(regexp_replace(l, '^[0-9]+(\.[0-9]+)*[.)]?\s+', '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80), '_+$', '') AS key,
regexp_replace(l, '^[0-9]+(\.[0-9]+)*[.)]?\s+', '') AS label, coalesce(b, 'Unspecified') AS joined FROM x""")
def q_semantic_key(spark, sf_dir):
    label = F.concat(F.col("p_size").cast("string"), F.lit(".2. "), "p_type", F.lit(" / "), "p_brand")
    return parts(spark, sf_dir).select("p_partkey", T.semantic_key(label).alias("key"), T.display_label(label).alias("label"), T.semantic_label(F.when(F.col("p_size") % 3 > 0, F.col("p_brand"))).alias("joined"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS label, last_day(make_date(year(o_orderdate), 3 * quarter(o_orderdate), 1)) AS ends FROM orders")
def q_period(spark, sf_dir):
    y, q = F.year("o_orderdate"), F.quarter("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", V.period_label(y, q).alias("label"), V.period_end(y, q).alias("ends"))


@query("""WITH p AS (SELECT o_orderstatus AS status, CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS l FROM orders)
SELECT status, CASE WHEN min(l) = max(l) THEN min(l) ELSE min(l) || ' through ' || max(l) END AS span FROM p GROUP BY status""")
def q_period_span(spark, sf_dir):
    label = V.period_label(F.year("o_orderdate"), F.quarter("o_orderdate"))
    out = read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.min(label).alias("a"), F.max(label).alias("b"))
    return out.select("status", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat("a", F.lit(" through "), "b")).alias("span"))


@query("""SELECT p_partkey, concat_ws(';', 'brand=' || p_brand, CASE WHEN p_size % 2 = 0 THEN 'type=' || p_type END) AS dims FROM part""")
def q_json_dims(spark, sf_dir):
    kept = F.map_filter(F.create_map(F.lit("brand"), T.clean(F.col("p_brand")), F.lit("type"), F.when(F.col("p_size") % 2 == 0, F.col("p_type"))), lambda k, v: v.isNotNull())
    return parts(spark, sf_dir).select("p_partkey", F.array_join(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("dims"))


@query(r"""SELECT doc_id, CASE WHEN length(text) <= 60 THEN text WHEN regexp_extract(text, '(?s)^(.{0,59})[ \t\r\n]', 1) <> '' THEN rtrim(regexp_extract(text, '(?s)^(.{0,59})[ \t\r\n]', 1)) || '…' ELSE substr(text, 1, 59) || '…' END AS short FROM documents""")
def q_truncate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.truncate_at_word(F.col("text"), 60).alias("short"))


@query(r"""SELECT p_partkey, coalesce(regexp_replace(regexp_replace(CAST(CASE WHEN p_size % 9 > 0 THEN CAST(p_retailprice AS DECIMAL(18,4)) END AS VARCHAR), '0+$', ''), '\.$', ''), '—') AS shown FROM part""")
def q_fmt(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", V.plain(F.when(F.col("p_size") % 9 > 0, F.col("p_retailprice").cast("decimal(18,4)"))).alias("shown"))


@query(r"""WITH d AS (SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[\t\n\r\f\x0B \x{00A0}]+', ' ', 'g')))) AS h FROM documents) SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS twin, count(*) OVER (PARTITION BY h) AS n FROM d""")
def q_twin_match(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.lower(F.trim(F.regexp_replace("text", T.SPACE, " "))).cast("binary"), 256).alias("h"))
    groups = d.groupBy("h").agg(F.min("doc_id").alias("twin"), F.count(F.lit(1)).alias("n"))
    return d.join(groups, "h").select("doc_id", "twin", "n")


@query("""SELECT p_partkey, '| Name | Type |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || replace(p_name, '|', '\\|') || ' | ' || p_type || ' |' || chr(10) || '| ' || p_brand || ' |  |' AS grid FROM part""")
def q_grid_markdown(spark, sf_dir):
    rows = F.array(F.array(F.lit("Name"), F.lit("Type")), F.array("p_name", F.concat(F.col("p_type"), F.lit("....."))), F.array("p_brand"))
    return parts(spark, sf_dir).select("p_partkey", T.grid_to_markdown(rows).alias("grid"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || '.3' AS number FROM part")
def q_section_number(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", T.section_number(F.concat(F.col("p_size").cast("string"), F.lit(".3. "), "p_name")).alias("number"))


@query("""WITH d AS (SELECT doc_id, text, array_to_string(list_slice(string_split(text, ' '), 3, 5), ' ') AS title FROM documents)
SELECT doc_id, CASE WHEN length(title) >= 8 AND len(string_split_regex(trim(title), ' +')) >= 2 AND instr(lower(text), lower(title)) > 0 THEN substr(text, instr(lower(text), lower(title))) ELSE text END AS trimmed FROM d""")
def q_heading_trim(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text", F.array_join(F.slice(F.split("text", " "), 3, 3), " ").alias("title"))
    return d.select("doc_id", T.trim_to_heading(F.col("text"), F.col("title")).alias("trimmed"))


@query("""WITH d AS (SELECT doc_id, 'Document: ' || source || chr(10) || 'Section: ' || lang || chr(10) || 'Chunk: ' || text AS a, 'Section: ' || lang || chr(10) || 'Chunk: ' || text AS b FROM documents)
SELECT doc_id, CASE WHEN ceil(length(a) / 4) <= 400 THEN a WHEN ceil(length(b) / 4) <= 400 THEN b END AS embedded FROM d""")
def q_contextual_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.contextual_text(F.col("source"), F.col("lang"), F.col("text"), 400).alias("embedded"))


@query("""SELECT doc_id, 'Section: ' || source || chr(10) || CASE WHEN lang <> 'en' THEN 'Element: ' || lang || chr(10) ELSE '' END || text AS candidate FROM documents""")
def q_candidate_text(spark, sf_dir):
    c = F.concat_ws("\n", F.concat(F.lit("Section: "), "source"), F.when(F.col("lang") != "en", F.concat(F.lit("Element: "), "lang")), "text")
    return read(spark, sf_dir, "documents").select("doc_id", c.alias("candidate"))


_STOP = ",".join(f"'{w}'" for w in T.STOPWORDS)


@query(f"""WITH b AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda t: length(t) >= 3 AND NOT list_contains([{_STOP}], t)) AS w FROM benchmark),
a AS (SELECT item_id, unnest(regexp_extract_all(text, '\\b[A-Z][A-Za-z]+(?:\\s+[A-Z][A-Za-z]+){{2,}}\\b')) AS phrase FROM benchmark),
u AS (SELECT item_id, unnest(w) AS t FROM b), s AS (SELECT item_id, CASE WHEN length(t) > 4 THEN regexp_replace(t, 's$', '') ELSE t END AS t FROM u
 UNION ALL SELECT item_id, lower(array_to_string(list_transform(regexp_split_to_array(phrase, '\\s+'), lambda x: x[1]), '')) FROM a)
SELECT item_id, string_agg(DISTINCT t, ' ' ORDER BY t) AS terms FROM s GROUP BY item_id""")
def q_lexical_terms(spark, sf_dir):
    out = read(spark, sf_dir, "benchmark").select("item_id", T.lexical_terms(F.col("text")).alias("t"))
    return out.where(F.size("t") > 0).select("item_id", F.array_join(F.array_sort("t"), " ").alias("terms"))


@query(f"""WITH x AS (SELECT p_partkey, 'What does the Wildfire Mitigation Plan say about ' || p_name || '?' AS q FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(lower(q), '([a-z0-9]+)', 1), lambda t: length(t) >= 3 AND NOT list_contains([{_STOP}], t)), ['wmp']))), ' ') AS terms FROM x""")
def q_lexical_query(spark, sf_dir):
    q = F.concat(F.lit("What does the Wildfire Mitigation Plan say about "), "p_name", F.lit("?"))
    return parts(spark, sf_dir).select("p_partkey", F.array_join(F.array_sort(T.lexical_query(q)), " ").alias("terms"))


@query("SELECT DISTINCT source, regexp_replace(regexp_replace(lower(source || ' / A&B'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def q_slug(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("source", T.slug(F.concat("source", F.lit(" / A&B"))).alias("slug")).distinct()


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'multiple_questions' WHEN 1 THEN 'independent_interrogative_clauses' END AS reason FROM part""")
def q_decompose_reason(spark, sf_dir):
    m = F.col("p_size") % 3
    q = F.concat(F.lit("What is the size of "), "p_name", F.when(m == 0, F.lit("? And the price?")).when(m == 1, F.lit(" and how much is it?")).otherwise(F.lit("?")))
    return parts(spark, sf_dir).select("p_partkey", T.decomposition_reason(q).alias("reason"))


@query("""SELECT page_id, round((length(html) - length(replace(html, '.', '')))::DOUBLE / length(html), 6) AS ratio, (length(html) - length(replace(html, '.', '')))::DOUBLE / length(html) > 0.02 AS noisy, length(html) < 1000 AS small FROM pages""")
def q_noise_filter(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.round(T.dot_ratio(F.col("html")), 6).alias("ratio"), (T.dot_ratio(F.col("html")) > 0.02).alias("noisy"), (F.length("html") < 1000).alias("small"))


def variants_sql(value: str) -> str:
    """All forms of a non-negative DECIMAL(18,2) ``value``, whole numbers apart, as a list."""
    cents = f"CAST(({value}) * 100 AS BIGINT)"
    tenths = f"({cents} // 10 + CASE WHEN {cents} % 10 > 5 OR ({cents} % 10 = 5 AND ({cents} // 10) % 2 = 1) THEN 1 ELSE 0 END)"
    grouped = lambda whole: f"format('{{:,}}', {whole})"
    two, one = f"'.' || lpad(CAST({cents} % 100 AS VARCHAR), 2, '0')", f"'.' || CAST({tenths} % 10 AS VARCHAR)"
    whole = f"[CAST({cents} // 100 AS VARCHAR) || '.00', CAST({cents} // 100 AS VARCHAR), {grouped(f'{cents} // 100')}]"
    parts = ", ".join(f"{w} || {t}{z}" for t, n, z in ((one, f"{tenths} // 10", ""), (two, f"{cents} // 100", ""), (two, f"{cents} // 100", " || '0'")) for w in (grouped(n), f"CAST({n} AS VARCHAR)"))
    trimmed = f"regexp_replace(CAST({cents} // 100 AS VARCHAR) || {two}, '[.]?0+$', '')"
    return f"list_distinct(CASE WHEN {cents} % 100 = 0 THEN {whole} ELSE [{trimmed}, {parts}] END)"


@query(f"""SELECT p_partkey, array_to_string(list_sort({variants_sql("p")}), ';') AS variants FROM (SELECT p_partkey, CAST(p_retailprice * (1 + p_partkey % 9) AS DECIMAL(18,2)) AS p FROM part)""")
def q_numeric_variants(spark, sf_dir):
    price = (F.col("p_retailprice") * (1 + F.col("p_partkey") % 9)).cast("decimal(18,2)")
    return parts(spark, sf_dir).select("p_partkey", F.array_join(F.array_sort(V.numeric_variants(price)), ";").alias("variants"))


@query("""WITH d AS (SELECT p_partkey, CAST(p_partkey % 18278 AS INTEGER) AS i FROM part)
SELECT p_partkey, i, i AS back, CASE WHEN i < 26 THEN chr(65 + i) WHEN i < 702 THEN chr(65 + (i - 26) // 26) || chr(65 + i % 26) ELSE chr(65 + (i - 702) // 676) || chr(65 + (i - 702) // 26 % 26) || chr(65 + (i - 702) % 26) END AS letters FROM d""")
def q_col_letter(spark, sf_dir):
    i = (F.col("p_partkey") % 18278).cast("int")
    return parts(spark, sf_dir).select("p_partkey", i.alias("i"), V.column_index(V.column_letters(i)).alias("back"), V.column_letters(i).alias("letters"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def q_content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('fr', 'de')")
def q_content_type_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(F.col("lang").isin("fr", "de")).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%license%'")
def q_ilike(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(F.col("text").ilike("%license%")).select("doc_id")


@query("SELECT count(*) AS stale FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 1")
def q_stale_probe(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return d.where(~F.col("quality").eqNullSafe(1)).agg(F.count(F.lit(1)).alias("stale"))


@query("SELECT doc_id FROM documents WHERE text ILIKE '%@mail%'")
def q_leak_scan(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.where(F.to_json(F.struct("doc_id", "text", "source")).ilike("%@mail%")).select("doc_id")


@query("""SELECT conv_id, turn, 'Answer ' || CAST(turn AS VARCHAR) AS answer, CASE WHEN turn % 3 = 0 THEN true ELSE false END AS insufficient FROM conversations""")
def q_parse_answer(spark, sf_dir):
    body = F.concat(F.lit('```json\n{"answer": "Answer '), F.col("turn").cast("string"), F.lit('", "insufficient": '), (F.col("turn") % 3 == 0).cast("string"), F.lit("}\n```"))
    parsed = F.from_json(T.strip_fence(body), "answer string, insufficient boolean")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", parsed["answer"].alias("answer"), parsed["insufficient"].alias("insufficient"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'net change in ' || p_name WHEN 1 THEN p_name || 's in HFTD' WHEN 2 THEN '95th percentile other equipments of SAIDI' WHEN 3 THEN 'overhead circuit miles upgraded'
 ELSE 'cold-end cotter keys, vegetation-related conductor, WMP' END AS label FROM part""")
def q_question_label(spark, sf_dir):
    m = F.col("p_size") % 5
    raw = (
        F.when(m == 0, F.concat(F.col("p_size").cast("string"), F.lit(". Net addition (or removal) - "), "p_name"))
        .when(m == 1, F.concat("p_name", F.lit("(S) \t in hftd ")))
        .when(m == 2, F.lit("95 Percentile  other (specify)s of Saidi"))
        .when(m == 3, F.lit("12. Number of overhead circuit miles upgraded"))
        .otherwise(F.lit("Cold end cotter keys, Conductor - Veg, wmp"))
    )
    return parts(spark, sf_dir).select("p_partkey", T.question_label(raw).alias("label"))
