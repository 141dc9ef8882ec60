"""URL filter: rules first, then a tree of path templates with labelled purity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str  # block or allow
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; '' where there is none."""
    raw = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(raw, _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name of the longest rule that fits host (or a parent domain) and path; else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.name)).otherwise(found)
    return found


@dataclass(frozen=True)
class Tree:
    """How templates are made; every test is a share, so more pages of the same urls change nothing."""

    depth: int = 8  # segments; what follows is part of the last one
    hot: int = 16  # a child with 1/hot of its parent's pages keeps its name
    variety: int = 16  # the other children become ``*`` from this effective number on
    evidence: int = 5  # pages a branch needs to be merged
    distance: float = 0.05  # largest Jensen-Shannon divergence, in bits, of a merged branch from its pool
    smoothing: float = 10.0  # pages a node's parent counts for


def _spread(rows: DataFrame, fewer: DataFrame, on: list[str], by: str, salts: int, how: str = "inner") -> DataFrame:
    """Join on ``on``; the rows of one key are dealt over ``salts`` by ``by`` and ``fewer`` is repeated for each."""
    fewer = fewer.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return rows.join(fewer, [*on, "_salt"], how).drop("_salt")


def _named(nodes: DataFrame, tree: Tree, salts: int) -> DataFrame:
    """``name`` for every (prefix, seg): ``*`` where the segments that are not hot are variable, else its own.

    The effective number of children is the inverse Simpson index: it equals their
    number where all have the same pages, and one dominant child does not hide the rest.
    """
    wide = F.col("n").cast("decimal(18,0)")
    totals = nodes.groupBy("prefix").agg(F.sum("n").alias("total"))
    nodes = _spread(nodes, totals, ["prefix"], "seg", salts).withColumn("own", F.col("n") * tree.hot >= F.col("total"))
    rest = nodes.filter(~F.col("own")).groupBy("prefix").agg(
        F.sum("n").cast("decimal(18,0)").alias("rest"), F.sum(wide * wide).alias("squares"))
    rest = rest.select("prefix", (F.col("rest") * F.col("rest") >= F.col("squares") * tree.variety).alias("variable"))
    literal = F.when(F.col("seg").rlike(r"^[*{\\]"), F.concat(F.lit("\\"), "seg")).otherwise(F.col("seg"))
    return _spread(nodes, rest, ["prefix"], "seg", salts, "left").withColumn(
        "name", F.when(~F.col("own") & F.col("variable"), "*").otherwise(literal)).drop("own", "variable", "total")


def _merged(nodes: DataFrame, cells: DataFrame, tree: Tree, salts: int) -> DataFrame:
    """Siblings whose pages spread over the next segments alike get one name, ``{least name}``.

    Siblings with the same commonest next segment form a pool; a branch joins it if
    its whole distribution is within ``distance`` of the pool's. No pair of siblings
    is formed. Branches with few pages, or that mostly end here, stay as they are.
    """
    able = nodes.filter(
        (F.col("name") != "*") & (F.col("n") >= tree.evidence) & (F.col("top") != "")
    ).select("prefix", "seg", "name", "top", F.col("n").alias("of"))
    pools = able.groupBy("prefix", "top").agg(F.sum("of").alias("pool"), F.count("*").alias("m")).filter("m > 1").drop("m")
    able = able.join(pools, ["prefix", "top"])
    parts = _spread(cells.select("prefix", "seg", "next", "n"), able, ["prefix", "seg"], "next", salts)
    pooled = parts.groupBy("prefix", "top", "next").agg(F.sum("n").alias("pn"))
    p, q = F.col("n") / F.col("of"), F.col("pn") / F.col("pool")
    bits = (p * F.log2(2 * p / (p + q)) + q * F.log2(2 * q / (p + q)) - q) / 2
    near = (
        parts.join(pooled, ["prefix", "top", "next"]).groupBy("prefix", "seg", "name", "top")
        .agg(F.round(F.sum(bits) + 0.5, 9).alias("js")).filter(F.col("js") <= tree.distance)
    )
    groups = near.groupBy("prefix", "top").agg(F.min("name").alias("least"), F.count("*").alias("m")).filter("m > 1")
    labels = near.join(groups, ["prefix", "top"]).select(
        "prefix", "seg", F.concat(F.lit("{"), "least", F.lit("}")).alias("group"))
    return nodes.join(labels, ["prefix", "seg"], "left").withColumn("name", F.coalesce("group", "name")).drop("group")


def template_purity(pages: DataFrame, tree: Tree = Tree(), *, salts: int = 16) -> DataFrame:
    """Template and smoothed share of bad pages for every distinct (host, shape).

    ``pages`` has ``host``, ``shape`` (path with numbers masked) and ``bad``. Equal
    shapes are counted first, so what follows handles a row per shape, not per page.
    Each host is a tree of path segments, worked level by level from the root, all
    hosts at once: variable segments become ``*`` (`_named`), siblings that spread
    alike are merged (`_merged`), and the next level sees the subtrees so joined.
    Purity is the labelled share of bad pages of a node, smoothed by its parent's,
    a host's by that of all pages; unlabelled pages count as not bad.
    """
    leaves = pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    leaves = written(leaves.withColumn(
        "parts", F.split(F.regexp_replace("shape", "^/", ""), "/", tree.depth)), "url-leaves")
    whole = leaves.agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.max(F.size("parts")).alias("depth")).first()
    prior = F.lit((whole.bad or 0) / (whole.n or 1))

    def smooth(parent: Column) -> Column:
        return (F.col("bad") + tree.smoothing * parent) / (F.col("n") + tree.smoothing)

    hosts = leaves.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = hosts.select("host", F.col("host").alias("prefix"), smooth(prior).alias("purity"))
    leaves = _spread(leaves, hosts, ["host"], "shape", salts)
    for level in range(whole.depth or 0):
        leaves = leaves.withColumns({
            "seg": F.get("parts", F.lit(level)), "next": F.coalesce(F.get("parts", F.lit(level + 1)), F.lit(""))})
        leaves = written(leaves, "url-level")
        sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.max("purity").alias("purity")]
        cells = leaves.filter("seg is not null").groupBy("prefix", "seg", "next").agg(*sums)
        nodes = cells.groupBy("prefix", "seg").agg(
            F.max(F.struct("n", "next")).getField("next").alias("top"), *sums)
        nodes = written(_merged(written(_named(nodes, tree, salts), "url-names"), cells, tree, salts), "url-nodes")
        joined = nodes.groupBy("prefix", "name").agg(*sums).select("prefix", "name", smooth(F.col("purity")).alias("pure"))
        steps = _spread(nodes.select("prefix", "seg", "name"), joined, ["prefix", "name"], "seg", salts)
        leaves = _spread(leaves, steps, ["prefix", "seg"], "shape", salts, "left").select(
            "host", "shape", "n", "bad", "parts",
            F.concat("prefix", F.coalesce(F.concat(F.lit("/"), "name"), F.lit(""))).alias("prefix"),
            F.coalesce("pure", "purity").alias("purity"))
    return written(leaves.select("host", "shape", F.col("prefix").alias("template"), "purity"), "url-templates")


def filter_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, tree: Tree = Tree(), *, reject_at: float = 0.5, salts: int = 16
) -> DataFrame:
    """Verdict on every url: the longest fitting rule's, else its template's.

    Templates learn from the pages that a rule blocks. Null urls and urls without
    ``://`` have an empty host and path and form a template of their own. Repeated
    rows are judged alike, ids are not used, an empty table gives no rows, other
    columns are ignored. Templates are joined back by host and shape; each is
    repeated over ``salts``, so a shape with a third of all pages spreads out.
    """
    action = {r.name: r.action for r in rules}
    parsed = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    parsed = parsed.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    blocked = F.coalesce(F.col("rule").isin([n for n, a in action.items() if a == "block"]), F.lit(False))
    shape = F.regexp_replace(F.regexp_replace("path", r"[0-9a-f]*[0-9][0-9a-f]{11,}", "<id>"), r"[0-9]+", "<n>")
    shaped = parsed.withColumns({"bad": blocked, "shape": shape})
    judged = _spread(shaped, template_purity(shaped, tree, salts=salts), ["host", "shape"], "page_id", salts)
    by_rule = F.when(F.col("bad"), "block").when(F.col("rule").isNotNull(), "allow")
    by_tree = F.when(F.col("purity") >= reject_at, "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", "rule", F.coalesce(by_rule, by_tree).alias("verdict"),
        "template",
    )


_PARSED = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    regexp_replace(regexp_replace(path, '[0-9a-f]*[0-9][0-9a-f]{11,}', '<id>', 'g'), '[0-9]+', '<n>', 'g') AS shape FROM parts
), shaped AS MATERIALIZED (SELECT *, coalesce(rule IN ('net/', 'example.com/de/'), false) AS bad FROM ruled),
counted AS MATERIALIZED (
  SELECT host, shape, count(*) AS n, sum(bad::INT)::BIGINT AS bad, string_split(regexp_replace(shape, '^/', ''), '/') AS p
  FROM shaped GROUP BY host, shape
), prior AS (SELECT sum(bad)::DOUBLE / sum(n) AS prior FROM counted),
hosts AS (SELECT host, (sum(bad) + 10.0::DOUBLE * any_value(prior)) / (sum(n) + 10.0::DOUBLE) AS purity FROM counted, prior GROUP BY host),
l0 AS MATERIALIZED (
  SELECT c.* EXCLUDE (p), CASE WHEN len(p) > 8 THEN list_append(p[1:7], array_to_string(p[8:], '/')) ELSE p END AS p, host AS prefix, purity
  FROM counted c JOIN hosts USING (host)
)"""

#: One level of the tree; ``@`` is the level, ``#`` the next.
_LEVEL = r""",
c@ AS MATERIALIZED (
  SELECT prefix, p[#] AS seg, coalesce(p[# + 1], '') AS next, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, max(purity) AS purity
  FROM l@ WHERE len(p) >= # GROUP BY ALL
), n@ AS MATERIALIZED (
  SELECT prefix, seg, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, max(purity) AS purity,
    max(struct_pack(n := n, next := next)).next AS top FROM c@ GROUP BY ALL
), o@ AS (SELECT n.*, n * 16 >= total AS own FROM n@ n JOIN (SELECT prefix, sum(n) AS total FROM n@ GROUP BY ALL) USING (prefix)),
v@ AS (SELECT prefix, sum(n)::HUGEINT * sum(n)::HUGEINT >= 16 * sum(n::HUGEINT * n::HUGEINT) AS variable FROM o@ WHERE NOT own GROUP BY ALL),
w@ AS MATERIALIZED (
  SELECT o.*, CASE WHEN NOT own AND variable THEN '*' WHEN regexp_matches(seg, '^[*{\\]') THEN '\' || seg ELSE seg END AS name
  FROM o@ o LEFT JOIN v@ USING (prefix)
), a@ AS MATERIALIZED (
  SELECT prefix, seg, name, top, n AS tot, sum(n) OVER (PARTITION BY prefix, top) AS pool FROM w@
  WHERE name <> '*' AND n >= 5 AND top <> '' QUALIFY count(*) OVER (PARTITION BY prefix, top) > 1
), x@ AS MATERIALIZED (SELECT a.*, c.next, c.n FROM c@ c JOIN a@ a USING (prefix, seg)),
y@ AS (SELECT *, n / tot AS pp, sum(n) OVER (PARTITION BY prefix, top, next) / pool AS qq FROM x@),
z@ AS (
  SELECT prefix, seg, name, top FROM y@ GROUP BY ALL
  HAVING round(sum((pp * log2(2 * pp / (pp + qq)) + qq * log2(2 * qq / (pp + qq)) - qq) / 2) + 0.5, 9) <= 0.05
), g@ AS (
  SELECT prefix, seg, '{' || min(name) OVER (PARTITION BY prefix, top) || '}' AS grp FROM z@
  QUALIFY count(*) OVER (PARTITION BY prefix, top) > 1
), d@ AS MATERIALIZED (SELECT w.* REPLACE (coalesce(grp, name) AS name) FROM w@ w LEFT JOIN g@ USING (prefix, seg)),
s@ AS (SELECT prefix, name, (sum(bad) + 10.0::DOUBLE * max(purity)) / (sum(n) + 10.0::DOUBLE) AS pure FROM d@ GROUP BY ALL),
l# AS MATERIALIZED (
  SELECT host, shape, l.n, l.bad, p, l.prefix || coalesce('/' || name, '') AS prefix, coalesce(pure, l.purity) AS purity
  FROM l@ l LEFT JOIN (SELECT prefix, seg, name, pure FROM d@ JOIN s@ USING (prefix, name)) t ON l.prefix = t.prefix AND p[#] = t.seg
)"""

SQL = _PARSED + "".join(
    _LEVEL.replace("@", str(level)).replace("#", str(level + 1)) for level in range(8)
) + """
SELECT page_id, host, path, rule, CASE WHEN s.bad THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN purity >= 0.5 THEN 'block' ELSE 'allow' END AS verdict, prefix AS template
FROM shaped s JOIN l8 USING (host, shape)
"""
