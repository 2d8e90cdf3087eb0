"""URL filters by a path-template tree, in DataFrame functions only.

Rules on hosts and paths give verdicts, and so labels. Per host, paths form a
tree of segments: digits and hexadecimal names become wildcards, and, level by
level down to the end of each path, the segments below a node become one wildcard
where they are many with fewer than four pages each on average. Branches of a
host (first segments) whose children are distributed alike are merged: branches
with the same commonest child are pooled, and one belongs to the pool unless a
chi-squared test of homogeneity, over all its children, tells it apart at the
level of one in twenty.
A template's purity is the share of blocked pages among its labelled ones,
smoothed towards a prior, and unlabelled pages count half as evidence that the
template is not blocked as a whole; pages that no rule fits are blocked where the
purity exceeds a threshold.

Scale: pages are folded to counts of (host, path of generalised segments) at
once, with partial aggregation, so a hot page is one row. A level of the tree is
one aggregation and one join, whose rows are dealt to parts by their path, so
that a node with very many children is no one task. Nodes of few paths need no
further level, so rounds end where no more than ``many`` paths share a node, not
with the longest path. Verdicts return by one equality join with a row a key.

Cases: null urls and those without ``://`` have empty host and path and fit no
rule; so has an empty path, which starts with no rule's path. Very long urls are
read whole and are rows like others. Repeated rows get equal verdicts. Other
columns, whatever their names, are ignored. An empty table gives no rows; without
any labelled page nothing but rules blocks. A purity equal to the threshold
allows; of equally common children the first in order leads a branch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.llm.common import durable

#: The host rules, (verdict, rule).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lowered, and path without query and fragment; both empty where there is no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return host, path


def by_rules(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits a page, null where none does."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _segment(s: Column) -> Column:
    """A segment with its variable characters generalised."""
    hexed = s.rlike("^[0-9a-fA-F-]{8,}$") & s.rlike("[0-9]") & s.rlike("[a-fA-F]")
    return F.when(hexed, F.lit("<x>")).otherwise(F.regexp_replace(s, "[0-9]+", "<n>"))


@dataclass(frozen=True)
class Tree:
    """When segments are variable, and how purity is smoothed and judged."""

    many: int = 12
    z: float = 1.645  # of the normal distribution, for the level of the test
    smooth: float = 4.0
    prior: float = 0.25
    unlabelled: float = 0.5
    threshold: float = 0.5


PARTS = 1024


def _walked(nodes: DataFrame, many: int) -> DataFrame:
    """Paths (host, path, n, labelled, blocked) with ``t``, their segments with variable ones as *."""
    # Segments yet to come are in ``rest``; a path is done when its node holds too few paths for a wildcard.
    open_ = nodes.withColumns({"t": F.array().cast("array<string>"), "rest": F.filter(F.split("path", "/"), lambda s: s != "")})
    done = None
    while True:
        part = F.pmod(F.xxhash64("path"), F.lit(PARTS)).cast("int")
        open_ = open_.withColumns({"s": F.get("rest", F.lit(0)), "part": part})
        seen = open_.groupBy("host", "t", "part").agg(F.count("*").alias("paths"))
        held = seen.groupBy("host", "t").agg(F.sum("paths").alias("paths"))
        kids = open_.where("s is not null").groupBy("host", "t", "s").agg(F.sum("n").alias("k")).groupBy("host", "t").agg(F.count("*").alias("kids"), F.sum("k").alias("total"))
        told = seen.select("host", "t", "part").join(held.join(kids, ["host", "t"], "left"), ["host", "t"])  # PARTS rows a node at most
        level = open_.join(told, ["host", "t", "part"])
        over = F.col("s").isNull() | (F.col("paths") <= many)
        ended = level.where(over).select("host", "path", "n", "labelled", "blocked", F.concat("t", "rest").alias("t"))
        done = ended if done is None else done.unionByName(ended)
        varied = (F.col("kids") > many) & (4 * F.col("kids") > F.col("total"))
        step = F.concat("t", F.array(F.when(varied, F.lit("*")).otherwise(F.col("s"))))
        left = level.where(~over).select("host", "path", "n", "labelled", "blocked", step.alias("t"), F.slice("rest", F.lit(2), F.size("rest")).alias("rest"))
        open_ = durable(left)
        if open_.isEmpty():
            return durable(done)


def templates(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """The verdict ``learnt`` for each (host, path) of pages (host, path, verdict), where ``path`` is of generalised segments."""
    tree = tree or Tree()
    counts = (F.count("*").alias("n"), F.count("verdict").alias("labelled"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    leaves = _walked(durable(pages.groupBy("host", "path").agg(*counts)), tree.many)
    at = lambda i: F.coalesce(F.get("t", F.lit(i)), F.lit(""))
    leaves = leaves.select("host", "path", "n", "labelled", "blocked", at(0).alias("t1"), at(1).alias("t2"), F.array_join(F.slice("t", F.lit(3), F.greatest(F.size("t"), F.lit(1))), "/").alias("rest"))
    kids = durable(leaves.groupBy("host", "t1", "t2").agg(F.sum("n").alias("o")))
    branches = kids.groupBy("host", "t1").agg(F.sum("o").alias("n"), F.min(F.struct((-F.col("o")).alias("o"), "t2"))["t2"].alias("lead"))
    mine = durable(kids.join(branches, ["host", "t1"]))
    pool = mine.groupBy("host", "lead", "t2").agg(F.sum("o").alias("p"))
    whole = pool.groupBy("host", "lead").agg(F.sum("p").alias("total"), F.count("*").alias("kinds"))
    each = mine.join(pool, ["host", "lead", "t2"]).groupBy("host", "t1", "lead", "n").agg(F.sum(F.col("o") * F.col("o") / F.col("p")).alias("q"))
    tested = each.join(whole, ["host", "lead"])
    freedom = (F.col("kinds") - 1).cast("double")
    # The critical value by the cubes of Wilson and Hilferty.
    ninth = 2 / (9 * freedom)
    critical = F.when(freedom > 0, freedom * F.pow(1 - ninth + tree.z * F.sqrt(ninth), F.lit(3.0))).otherwise(F.lit(0.0))
    alike = F.col("total") / F.col("n") * F.col("q") - F.col("n") <= critical + 1e-9
    named = tested.select("host", "t1", F.when(alike, F.concat(F.lit("~"), "lead")).otherwise(F.col("t1")).alias("branch"))
    placed = durable(leaves.groupBy("host", "t1", "t2", "rest").agg(*(F.sum(c).alias(c) for c in ("n", "labelled", "blocked"))).join(named, ["host", "t1"]))
    purity = placed.groupBy("host", "branch", "t2", "rest").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    a = float(tree.smooth)
    weight = F.col("l") + tree.unlabelled * (F.col("n") - F.col("l")) + a
    bad = (F.col("b") + a * tree.prior) / weight > tree.threshold
    judged = purity.select("host", "branch", "t2", "rest", F.when(bad, F.lit("block")).otherwise(F.lit("allow")).alias("learnt"))
    of_template = durable(placed.join(judged, ["host", "branch", "t2", "rest"]).select("host", "t1", "t2", "rest", "learnt"))
    return leaves.join(of_template, ["host", "t1", "t2", "rest"]).select("host", "path", "learnt")


def filtered(pages: DataFrame, rules=RULES, tree: Tree | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("whole"))
    general = F.array_join(F.transform(F.filter(F.split("whole", "/"), lambda s: s != ""), _segment), "/")
    rows = rows.withColumn("by", by_rules(F.col("host"), F.col("whole"), rules)).withColumn("path", general)
    rows = rows.select("page_id", "host", "whole", "path", F.col("by.rule").alias("rule"), F.col("by.verdict").alias("verdict"))
    learnt = durable(templates(rows.select("host", "path", "verdict"), tree))
    return rows.join(learnt, ["host", "path"], "left").select("page_id", "host", F.col("whole").alias("path"), "rule", F.coalesce("verdict", "learnt").alias("verdict"))


ORACLE = r"""
WITH RECURSIVE u AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
                     WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
                     WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
                     WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
             list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM u),
v AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict,
             list_transform(parts, lambda x: CASE WHEN regexp_matches(x, '^[0-9a-fA-F-]{8,}$') AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-fA-F]')
                                             THEN '<x>' ELSE regexp_replace(x, '[0-9]+', '<n>', 'g') END) AS g FROM r),
n0 AS (SELECT host, g, count(*) AS n, count(verdict) AS l, count(*) FILTER (verdict = 'block') AS b FROM v GROUP BY ALL),
walk AS (SELECT host, g, n, l, b, []::VARCHAR[] AS t, 0 AS d FROM n0 UNION ALL
         SELECT host, g, n, l, b, list_append(t, CASE WHEN kids > 12 AND 4 * kids > total THEN '*' ELSE g[d + 1] END), d + 1
         FROM (SELECT *, count(DISTINCT g[d + 1]) OVER (PARTITION BY host, t) AS kids, sum(n) OVER (PARTITION BY host, t) AS total FROM walk WHERE len(g) > d)),
leaf AS (SELECT host, g, n, l, b, coalesce(t[1], '') AS t1, coalesce(t[2], '') AS t2, array_to_string(t[3:], '/') AS rest FROM walk WHERE len(g) = d),
k AS (SELECT host, t1, t2, sum(n) AS o FROM leaf GROUP BY ALL),
br AS (SELECT host, t1, sum(o) AS n, arg_min(t2, (-o, t2)) AS lead FROM k GROUP BY ALL),
po AS (SELECT host, lead, t2, sum(o) AS p FROM k JOIN br USING (host, t1) GROUP BY ALL),
wh AS (SELECT host, lead, sum(p) AS total, count(*) - 1.0::DOUBLE AS f FROM po GROUP BY ALL),
ch AS (SELECT host, t1, lead, br.n, sum((o * o)::DOUBLE / p) AS q FROM k JOIN br USING (host, t1) JOIN po USING (host, lead, t2) GROUP BY ALL),
nm AS (SELECT host, t1, CASE WHEN total::DOUBLE / n * q - n <= CASE WHEN f > 0 THEN f * pow(1 - 2 / (9 * f) + 1.645 * sqrt(2 / (9 * f)), 3) ELSE 0 END + 1e-9 THEN '~' || lead ELSE t1 END AS branch
       FROM ch JOIN wh USING (host, lead)),
p AS (SELECT host, branch, t2, rest, sum(n) AS n, sum(l) AS l, sum(b) AS b FROM leaf JOIN nm USING (host, t1) GROUP BY ALL),
j AS (SELECT host, branch, t2, rest, CASE WHEN (b::DOUBLE + 1.0) / (l::DOUBLE + 0.5 * (n - l)::DOUBLE + 4.0) > 0.5 THEN 'block' ELSE 'allow' END AS learnt FROM p),
q AS (SELECT host, g, learnt FROM leaf JOIN nm USING (host, t1) JOIN j USING (host, branch, t2, rest))
SELECT page_id, host, path, rule, coalesce(verdict, learnt) AS verdict FROM v JOIN q USING (host, g)
"""
