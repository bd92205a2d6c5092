"""URL filter: rules first, then a path-template tree whose templates are rejected by labelled purity.

Every path becomes a list of segment shapes, one for each segment (runs of digits and slugs are variable at once).
Per depth, a shape stays literal if ``Tree.support`` pages of all hosts together have it, whatever a host's size; the
others become the wildcard ``{*}``.  From the deepest level that has literals up, a small job each, a literal branch whose labelled block rate is
compatible (Hoeffding) with that of all its siblings together is merged into their wildcard; a branch
without labels gives no ground to merge it and stays.  A template is
rejected if its block rate, smoothed by the rate of the same template over all hosts, which is smoothed by
``Tree.base``, reaches ``Tree.reject``; so one without labels anywhere is not.  Labels are the verdicts of the rules on the pages that they fit.

All of it is DataFrame operations; what a host adds is first summed by (host, shapes), so a host with a
third of all pages is no larger than its distinct shapes.  Literals are joined as rows and branches are summed before
they meet their siblings, so their number has no bound.  The list of rules becomes one expression and
should stay in the hundreds.

Defined results: a null url, or one without ``://``, has empty host and path; very long urls are judged whole, by all their segments;
of rules of one length that fit the last in text order holds; repeated rows and ids are judged each; extra columns are ignored; without any label every template has the base rate, which is below ``reject``; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import write_shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD = "{*}"


@dataclass(frozen=True)
class Tree:
    support: int = 5  # pages, of all hosts, that a literal segment must have
    alpha: float = 0.5  # of the Hoeffding test: a small bound, as purity backs off to all hosts anyway
    smoothing: float = 4.0
    reject: float = 0.5
    base: float = 0.25  # block rate that is assumed before any label is seen


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_column(rules: list[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, both null if none does.  rules: (verdict, rule)."""
    rule = said = F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is tried first
        name, _, prefix = text.partition("/")
        fits = ((host == name.lower()) | F.endswith(host, F.lit(f".{name.lower()}"))) & F.startswith(path, F.lit(f"/{prefix}"))
        rule, said = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(said)
    return rule, said


def shapes(path: Column) -> Column:
    """The segments with their variable parts generalised."""
    one = lambda s: F.when((F.length(s) > 40) | s.rlike("(-[^-]*){3}"), F.lit("{slug}")).otherwise(F.regexp_replace(s, "[0-9]+", "{n}"))
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), one)


def _wild_at(column: str, k: int) -> Column:
    return F.transform(column, lambda s, i: F.when(i == k, F.lit(WILD)).otherwise(s))


def parsed(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, said (the rule's verdict), shapes."""
    base = pages.select(pages[id_col].alias("id"), F.coalesce(pages[url_col], F.lit("")).alias("u"))
    host, path = host_and_path(F.col("u"))
    cut = base.select("id", host.alias("host"), path.alias("path"))
    rule, said = rule_column(rules, F.col("host"), F.col("path"))
    return cut.select("*", rule.alias("rule"), said.alias("said"), shapes(F.col("path")).alias("shapes"))


def templates(urls: DataFrame, how: Tree = Tree()) -> DataFrame:
    """(host, shapes) -> template, rate and verdict, from all parsed pages."""
    seen = urls.groupBy("host", "shapes").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("said") == "block", 1)).alias("blocked"), F.count("said").alias("labelled")
    )
    # Literals: how many pages have the shape at the level
    forms = seen.groupBy("shapes").agg(F.sum("n").alias("n")).select("shapes", "n", F.posexplode("shapes").alias("level", "shape"))
    literal = forms.groupBy("level", "shape").agg(F.sum("n").alias("all")).where(F.col("all") >= how.support).select("level", "shape", F.lit(True).alias("literal"))
    segment = F.struct("level", F.when(F.col("literal"), F.col("shape")).otherwise(F.lit(WILD)).alias("segment"))
    general = forms.join(literal, ["level", "shape"], "left").groupBy("shapes").agg(F.sort_array(F.collect_list(segment)).alias("s")).select("shapes", F.col("s.segment").alias("template"))
    deepest = literal.agg(F.max("level")).first()[0]
    tree = write_shared(seen.join(general, "shapes").select("host", "shapes", "template", "n", "blocked", "labelled"), "url-tree")
    # Branches alike: deepest level first
    bound = math.sqrt(math.log(2 / how.alpha) / 2)
    rate = lambda b, n: b / F.greatest(n, F.lit(1))
    sums = [F.sum(c).alias(c) for c in ("blocked", "labelled")]
    counts = write_shared(tree.groupBy("host", "template").agg(*sums), "url-branches")
    branch, own = counts.withColumn("merged", F.col("template")), counts.withColumnRenamed("template", "merged")
    for k in range(-1 if deepest is None else deepest, -1, -1):
        own = own.withColumn("parent", _wild_at("merged", k))
        family = own.groupBy("host", "parent").agg(F.sum("blocked").alias("all_b"), F.sum("labelled").alias("all_n"))
        far = bound * (1 / F.sqrt(F.greatest(F.col("labelled"), F.lit(1))) + 1 / F.sqrt(F.greatest(F.col("all_n"), F.lit(1))))
        alike = (F.col("labelled") > 0) & (F.abs(rate(F.col("blocked"), F.col("labelled")) - rate(F.col("all_b"), F.col("all_n"))) <= far)
        moved = own.join(family, ["host", "parent"]).select("host", "merged", F.when(alike, F.col("parent")).otherwise(F.col("merged")).alias("new"), "blocked", "labelled")
        moved = write_shared(moved, "url-merged")
        branch = branch.join(moved.select("host", "merged", "new"), ["host", "merged"]).select("host", "template", "blocked", "labelled", F.col("new").alias("merged"))
        own = moved.groupBy("host", F.col("new").alias("merged")).agg(*sums)
    branch = write_shared(branch, "url-branches")
    # Purity: host's template, the template everywhere, the base rate
    m = how.smoothing
    final = branch.groupBy("host", "merged").agg(*sums)
    everywhere = branch.groupBy("template").agg(F.sum("blocked").alias("every_b"), F.sum("labelled").alias("every_n"))
    shared = (F.col("every_b") + m * how.base) / (F.col("every_n") + m)
    purity = (F.col("blocked") + m * shared) / (F.col("labelled") + m)
    judged = (
        branch.select("host", "template", "merged").join(final, ["host", "merged"]).join(everywhere, "template")
        .select("host", "template", F.array_join("merged", "/").alias("branch"), purity.alias("purity"))
    )
    return tree.select("host", "shapes", "template").join(judged, ["host", "template"]).select(
        "host", "shapes", "branch", "purity", F.when(F.col("purity") >= how.reject, F.lit("block")).otherwise(F.lit("allow")).alias("learned")
    )


def judge(pages: DataFrame, rules: list[tuple[str, str]], how: Tree = Tree(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict; and template and purity of the method."""
    urls = parsed(pages, rules, id_col, url_col)
    said = urls.join(templates(urls, how), ["host", "shapes"], "left")
    return said.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("said", "learned", F.lit("allow")).alias("verdict"),
        F.col("branch").alias("template"), "purity",
    )


def rules_of(text: str) -> list[tuple[str, str]]:
    """'allow org/, block example.org/es/' as (verdict, rule) pairs."""
    return reduce(lambda out, part: [*out, tuple(part.split())], filter(None, (p.strip() for p in text.split(","))), [])
