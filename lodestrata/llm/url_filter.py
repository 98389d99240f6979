"""URL filter: explicit rules first, then a per-host tree of path templates.

Only DataFrame functions run here, and no step depends on how deep paths are: a template's
segments are rows (host, path, level, segment), and a branch is known by its host, its level and a
hash of the segments down to it.

1. Segments that are evidently variable (numbers, hex, dates) become typed wildcards. Values that
   hold under 1 / ``max_children`` of a branch's pages at a position are rare; if all rare values
   hold at least that share together, however many they are, those become ``*`` whose labels do not
   differ from the rest. Branches are told apart by segments
   generalised in the same way over the whole position of the host.
2. Labelled pages are summed over every branch up to the host. A branch stands for itself if its
   share of bad pages differs from that of its siblings (two-proportion z of at least
   ``merge_z``; few labels are allowed for once, in 3); all others merge with their similar siblings into
   the nearest branch above that stands, at last the host.
3. A pool is what merged into one standing branch, without what stands below it. Its purity is
   its share of bad pages smoothed by that of the pool above, and so on up to the share of all
   labels. A template is rejected when this reaches ``reject_at``.

Defined cases: a null url, or one without ``://``, has empty host and path, takes part in the
tree as the empty template of the empty host and is allowed unless its labels say otherwise;
without labels every url is allowed but by rule; labels that are null or of other values than 0
and 1 are ignored; paths of any length take part whole; values with equally many pages are
treated alike; of rules of equal length the greater text wins; repeated rows, and rows with a null
page_id, each get a verdict; an empty table gives an empty result; extra columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str  # starts with /
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    host, _, path = text.partition("/")
    return Rule(host, "/" + path, verdict)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, or null. The rule list is a parameter
    and part of the plan: rules are tried from the longest to the shortest."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the last one wrapped is tried first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def typed_segments(path: Column) -> Column:
    """Path segments with evident variables as wildcards."""
    raw = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(
        raw,
        lambda s: F.when(s.rlike(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$"), F.lit("{num}")).when(s.rlike(r"^[0-9a-fA-F-]{16,}$"), F.lit("{hex}")).when(s.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), F.lit("{date}")).otherwise(s),
    )


def _differs(n: Column, b: Column, all_n: Column, all_b: Column, prior: float, merge_z: float) -> Column:
    """Whether a branch with ``b`` bad of ``n`` labelled differs from the rest of its parent's."""
    rest_n, rest_b = all_n - n, all_b - b
    p = (all_b + prior) / (all_n + 1)
    z = F.abs(F.try_divide(b, n) - F.try_divide(rest_b, rest_n)) / F.sqrt(p * (1 - p) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), rest_n)))
    return F.coalesce(z >= merge_z, F.lit(False))


def _branches(rows: DataFrame, segment: str, branch: str) -> DataFrame:
    """``rows`` (host, typed, level, ...) with a hash of the segments of a path down to each level.
    Exclusive or of hashes that hold their level; the window runs over one path only."""
    down = Window.partitionBy("host", "typed").orderBy("level").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(branch, F.bit_xor(F.xxhash64("level", segment)).over(down))


def _generalised(rows: DataFrame, above: list[str], segment: str, name: str, max_children: int, differs: Column | None) -> DataFrame:
    """``rows`` with the segment, or ``*`` where it is one of many rare values under ``above``."""
    values = rows.groupBy("host", *above, segment).agg(*(F.sum(c).alias(c) for c in ("pages", "labelled", "bad")))
    all_of = values.groupBy("host", *above).agg(*(F.sum(c).alias(f"all_{c}") for c in ("pages", "labelled", "bad")))
    rare = values.join(all_of, ["host", *above]).where(F.col("pages") * max_children < F.col("all_pages"))
    together = rare.groupBy("host", *above).agg(F.sum("pages").alias("rare_pages"))
    stars = rare.join(together, ["host", *above]).where(F.col("rare_pages") * max_children >= F.col("all_pages"))
    stars = (stars if differs is None else stars.where(~differs)).select("host", *above, segment, F.lit("*").alias(name))
    return rows.join(stars, ["host", *above, segment], "left").withColumn(name, F.coalesce(name, segment))


def template_tree(urls: DataFrame, labelled: DataFrame, max_children: int = 50, merge_z: float = 2.0, prior_weight: float = 5.0) -> DataFrame:
    """host, typed (the typed segments, joined), template, pages, labelled, bad (of its pool) and
    purity: one row per typed template of a host.

    ``urls``: (host, segments), one row per page; ``labelled``: (host, segments, bad). Both are
    reduced map-side to one row per template before anything else sees them.
    """
    key = F.concat_ws("/", "segments")
    seen = urls.groupBy("host", key.alias("typed")).agg(F.count(F.lit(1)).alias("pages"))
    judged = labelled.where("bad in (0, 1)").groupBy("host", key.alias("typed")).agg(F.count(F.lit(1)).alias("labelled"), F.sum(F.col("bad").cast("long")).alias("bad"))
    leaves = materialize(seen.join(judged, ["host", "typed"], "left").na.fill(0, ["labelled", "bad"]), "leaves")
    totals = leaves.agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")).first()
    prior = (totals.b + 1) / (totals.n + 2) if totals.n else 0.0
    differs = _differs(F.col("labelled"), F.col("bad"), F.col("all_labelled"), F.col("all_bad"), prior, merge_z)
    # level 0 is the host; an empty path has only that
    segments = F.concat(F.array(F.lit("")), F.when(F.col("typed") == "", F.array().cast("array<string>")).otherwise(F.split("typed", "/")))
    rows = leaves.select("host", "typed", "pages", "labelled", "bad", F.posexplode(segments).alias("level", "segment"))
    rows = _branches(_generalised(rows, ["level"], "segment", "loose", max_children, None), "loose", "branch")
    rows = rows.withColumn("above", F.col("branch").bitwiseXOR(F.xxhash64("level", "loose")))
    rows = materialize(_generalised(rows, ["level", "above"], "segment", "general", max_children, differs).drop("branch", "above"), "segments")
    rows = materialize(_branches(rows, "general", "branch").withColumn("above", F.col("branch").bitwiseXOR(F.xxhash64("level", "general"))), "tree")
    sums = rows.groupBy("host", "level", "branch", "above").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    parents = sums.groupBy("host", "level", "above").agg(F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    standing = sums.join(parents, ["host", "level", "above"]).where((F.col("level") == 0) | differs).select("host", "level", "branch")
    # of every path the branches that stand, the deepest of which its template merges into
    lasting = materialize(rows.join(standing, ["host", "level", "branch"]).select("host", "typed", "level", "branch", "labelled", "bad"), "standing")
    chain = lasting.groupBy("host", "typed").agg(F.array_sort(F.collect_list(F.struct("level", "branch"))).alias("chain"), F.first("labelled").alias("labelled"), F.first("bad").alias("bad"))  # as long as the path at most
    chain = materialize(chain.withColumn("pool", F.element_at("chain", -1)), "chain")
    pools = materialize(chain.groupBy("host", F.col("pool.level").alias("level"), F.col("pool.branch").alias("branch")).agg(F.sum("labelled").alias("n"), F.sum("bad").alias("b")), "pools")
    # the pools above a pool are those of any path in it
    path = chain.groupBy("host", "pool").agg(F.first("chain").alias("chain")).select("host", "pool", F.explode("chain").alias("of"))
    counted = path.join(pools.select("host", F.struct("level", "branch").alias("of"), "n", "b"), ["host", "of"], "left").na.fill(0, ["n", "b"])
    smooth = F.aggregate(F.array_sort("steps"), F.lit(prior), lambda p, x: (x["b"] + prior_weight * p) / (x["n"] + prior_weight))
    purity = counted.groupBy("host", "pool").agg(F.collect_list(F.struct(F.col("of.level").alias("level"), "n", "b")).alias("steps"), F.max_by("n", "of.level").alias("labelled"), F.max_by("b", "of.level").alias("bad"))
    purity = purity.select("host", "pool", "labelled", "bad", smooth.alias("purity"))
    template = rows.where("level > 0").groupBy("host", "typed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "general"))), lambda x: x["general"]), "/").alias("template"))
    out = leaves.select("host", "typed", "pages").join(template, ["host", "typed"], "left").na.fill("", ["template"])
    return out.join(chain.select("host", "typed", "pool"), ["host", "typed"]).join(purity, ["host", "pool"]).drop("pool")


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: list[Rule], reject_at: float = 0.5, max_children: int = 50) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule, verdict, template, purity.

    ``labelled``: (url, bad). The tree has one row per typed template; it joins the pages by
    host and template, where AQE splits a host that holds a large share of all pages.
    """
    at = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    at = at.withColumn("segments", typed_segments(F.col("path")))
    known = labelled.select(host_of(F.col("url")).alias("host"), typed_segments(path_of(F.col("url"))).alias("segments"), "bad")
    tree = materialize(template_tree(at.select("host", "segments"), known, max_children), "templates")
    out = at.withColumn("typed", F.concat_ws("/", "segments")).withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules)).join(tree.select("host", "typed", "template", "purity"), ["host", "typed"], "left")
    learned = F.when(F.col("purity") >= reject_at, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("by_rule.rule").alias("rule"), F.coalesce(F.col("by_rule.verdict"), learned).alias("verdict"), "template", F.round("purity", 6).alias("purity"))
