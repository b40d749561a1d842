"""URL filters by a path-template tree.

Fixed rules judge the urls they fit.  For all others each host has a tree of path templates: segments with digits
or identifiers, and places with too many different values for their pages, become the wildcard *.  Values are
counted under the generalised path above them, in rounds, until no place becomes a wildcard any more; so what varies below
a wildcard is seen as one place.  The pages that rules judge are the labelled ones.  Siblings whose shares of blocked pages
differ from their parent's to the same side, or don't differ (z-tests), are merged if their own shares agree
with the pooled one, and then count as one branch.  Shares are smoothed down the tree, and a template whose
smoothed share reaches the limit is rejected.

All steps are DataFrame operations.  A path's prefix is the exclusive or of the hashes of its segments with their places, so
what is made for a path grows in proportion to its length.  Pages are aggregated to templates before any exchange but the last, the join of
pages with their template's verdict, whose hot keys (one host, one template) AQE splits or a broadcast avoids,
by the measured size of the verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import durable, forget, loose, table

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A segment is a wildcard if its place has more than so many values, with fewer pages each than PAGES_EACH.
VALUES, PAGES_EACH = 32, 4
#: Strength of what a branch has from above, in pages; z under which it is merged; share at which it is rejected.
STRENGTH, SIMILAR, REJECT = 8.0, 1.96, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Digits, long hexadecimal runs and UUIDs within a segment.
VARIABLE = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[0-9a-fA-F]{12,}|[0-9]+"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; of equally long ones, the first."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1]), reverse=True)[::-1]:
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _cell(place: str, segment: Column) -> Column:
    return F.xxhash64(F.col(place), segment)


def _split(path: Column) -> Column:
    return F.split(path, "/", -1)


def wildcards(leaves: DataFrame) -> DataFrame:
    """key and flags (place, wide; in order) of leaves(key, host, segments, n): which places of a path are wildcards.

    A place is wide if it has more than VALUES values under one generalised path, with fewer than PAGES_EACH pages each.  Each round
    takes the wildcards of those before into account; rounds are as many as wildcards nest, and one.
    """
    star = F.xxhash64(F.lit("*"))
    places = leaves.select("key", F.xxhash64("host").alias("h"), "n", F.posexplode(F.transform("segments", lambda s: F.xxhash64(s))).alias("place", "segment"), F.lit(False).alias("wide"))
    places, found = durable(places), 0
    above = Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        now = places.withColumn("above", F.coalesce(F.bit_xor(_cell("place", F.when(F.col("wide"), star).otherwise(F.col("segment")))).over(above), F.lit(0)))
        values = now.groupBy("h", "place", "above", "segment").agg(F.sum("n").alias("n"))
        crowded = values.groupBy("h", "place", "above").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("pages"))
        crowded = crowded.where((F.col("values") > VALUES) & (F.col("pages") < PAGES_EACH * F.col("values"))).select("h", "place", "above", F.lit(True).alias("hit"))
        after = now.join(loose(crowded, "h", "above"), ["h", "place", "above"], "left").select("key", "h", "n", "place", "segment", (F.col("wide") | F.coalesce("hit", F.lit(False))).alias("wide"))
        before, places = places, durable(after)
        forget(before)
        wide = places.where("wide").count()
        if wide == found:
            return places.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "wide"))).alias("flags"))
        found = wide


def _differs(bad: Column, n: Column, share: Column) -> Column:
    return F.abs(bad - n * share) > SIMILAR * F.sqrt(n * share * (1 - share))


def merged_siblings(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """h, place, node, labelled, bad (those of the merged branch), branch (+, - or = if it is one, else null) of nodes(h, place, node, above, labelled, bad)."""
    parents = nodes.select("h", (F.col("place") + 1).alias("place"), F.col("node").alias("above"), F.col("labelled").alias("up_n"), F.col("bad").alias("up_bad"))
    parents = parents.unionByName(roots.select("h", F.lit(0).alias("place"), F.lit(0).cast("long").alias("above"), F.col("labelled").alias("up_n"), F.col("bad").alias("up_bad")))
    own = nodes.join(loose(parents, "h", "above"), ["h", "place", "above"])
    share = F.col("up_bad") / F.col("up_n")
    side = F.when(~_differs(F.col("bad"), F.col("labelled"), share), "=").when(F.col("bad") > F.col("labelled") * share, "+").otherwise("-")
    own = own.withColumn("side", F.when(F.col("labelled") > 0, side)).drop("up_n", "up_bad")
    by = ["h", "place", "above", "side"]
    pools = own.where("side is not null").groupBy(*by).agg(F.sum("labelled").alias("pool_n"), F.sum("bad").alias("pool_bad"))
    own = own.join(loose(pools, "h", "above", "side"), by, "left")
    own = own.withColumn("alike", ~_differs(F.col("bad"), F.col("labelled"), F.col("pool_bad") / F.col("pool_n"))).drop("pool_n", "pool_bad")
    joint = own.where("alike").groupBy(*by).agg(F.count(F.lit(1)).alias("members"), F.sum("labelled").alias("all_n"), F.sum("bad").alias("all_bad")).where("members > 1")
    own = own.join(loose(joint, "h", "above", "side"), by, "left")
    is_one = F.col("alike") & F.col("members").isNotNull()
    return own.select("h", "place", "node", F.when(is_one, F.col("all_n")).otherwise(F.col("labelled")).alias("labelled"), F.when(is_one, F.col("all_bad")).otherwise(F.col("bad")).alias("bad"), F.when(is_one, F.col("side")).alias("branch"))


def template_tree(parsed: DataFrame) -> DataFrame:
    """key (of a host and a lexically generalised path), template, branch (the template with merged siblings) and share (smoothed share of blocked pages).

    parsed has key, host, raw and blocked (1, 0, or null for pages that no rule judges).
    """
    leaves = parsed.groupBy("key", "host", "raw").agg(F.count(F.lit(1)).alias("n"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("bad"))
    leaves = durable(leaves.withColumn("segments", _split(F.substring("raw", 2, 1 << 30))).drop("raw"))
    flags = wildcards(leaves.select("key", "host", "segments", "n"))
    template = F.array_join(F.transform("segments", lambda s, i: F.when(F.get("flags", i)["wide"], F.lit("*")).otherwise(s)), "/")
    named = leaves.join(flags, "key").select("key", "host", "labelled", "bad", template.alias("template"))
    named = durable(named.withColumn("tkey", F.md5(F.concat_ws("\n", "host", "template"))))
    templates = durable(named.groupBy("tkey", "host", "template").agg(F.sum("labelled").cast("double").alias("labelled"), F.sum("bad").cast("double").alias("bad")).withColumn("h", F.xxhash64("host")))
    up_to = Window.partitionBy("tkey").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    places = templates.select("tkey", "h", "labelled", "bad", F.posexplode(_split(F.col("template"))).alias("place", "segment")).withColumn("cell", _cell("place", F.col("segment"))).drop("segment")
    places = places.withColumn("node", F.bit_xor("cell").over(up_to))
    nodes = places.groupBy("h", "place", "node").agg(F.first(F.col("node").bitwiseXOR(F.col("cell"))).alias("above"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    roots = templates.groupBy("h").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    pooled = merged_siblings(nodes, roots)
    chains = places.select("tkey", "h", "place", "node").join(loose(pooled, "h", "node"), ["h", "place", "node"]).groupBy("tkey").agg(F.array_sort(F.collect_list(F.struct("place", "labelled", "bad", "branch"))).alias("chain"))
    prior = templates.agg(((F.coalesce(F.sum("bad"), F.lit(0.0)) + 1.0) / (F.coalesce(F.sum("labelled"), F.lit(0.0)) + 2.0)).alias("prior"))
    tops = roots.crossJoin(F.broadcast(prior)).select("h", _smooth(F.col("prior"), F.struct("labelled", "bad")).alias("top"))  # one row: the share over all hosts
    shares = templates.select("tkey", "h", "template").join(loose(tops, "h"), "h").join(chains, "tkey")
    branch = F.array_join(F.transform(_split(F.col("template")), lambda s, i: F.coalesce(F.concat(F.lit("{"), F.get("chain", i)["branch"], F.lit("}")), s)), "/")
    shares = shares.select("tkey", branch.alias("branch"), F.aggregate("chain", F.col("top"), _smooth).alias("share"))
    return named.select("key", "tkey", "template").join(loose(shares, "tkey"), "tkey").select("key", "template", "branch", "share")


def _smooth(above: Column, node: Column) -> Column:
    n, bad = node["labelled"], node["bad"]
    own = (bad + STRENGTH * above) / (n + STRENGTH)
    return F.when((n > 0) & _differs(bad, n, above), own).otherwise(above)


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, branch and share, a row for each of pages.

    A null url or one without :// has an empty host and path; such pages share a template.  Ports and
    user names count as part of the host.  Repeated rows give repeated rows and count as so many pages; urls may be of any length; other columns are left out.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("ruled"), F.regexp_replace("path", VARIABLE, "*").alias("raw"))
    rows = rows.withColumn("key", F.md5(F.concat_ws("\n", "host", "raw")))
    tree = template_tree(rows.select("key", "host", "raw", (F.col("ruled") == "block").cast("int").alias("blocked")))
    out = rows.join(tree, "key", "left")
    final = F.coalesce("ruled", F.when(F.col("share") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", final.alias("verdict"), "template", "branch", F.round("share", 9).alias("share"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    fits = []
    for kind, rule in sorted(RULES, key=lambda r: len(r[1]), reverse=True):
        own, slash, rest = rule.partition("/")
        fits.append((f"(host = '{own}' OR host LIKE '%.{own}') AND starts_with(path, '{slash + rest}')", rule, kind))
    name = " ".join(f"WHEN {w} THEN '{r}'" for w, r, _ in fits)
    ruled = " ".join(f"WHEN {w} THEN '{k}'" for w, _, k in fits)
    return f"""
WITH RECURSIVE cut AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
),
p AS (SELECT *, CASE {name} END AS rule, CASE {ruled} END AS ruled, regexp_replace(path, '{VARIABLE}', '*', 'g') AS raw FROM cut),
leaves AS (SELECT host, raw, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS bad, string_split(substr(raw, 2), '/') AS segs FROM p GROUP BY host, raw),
rounds AS (
  SELECT 0 AS round, host, raw, n, i - 1 AS place, segs[i] AS segment, false AS wide, true AS changed FROM (SELECT *, unnest(range(1, len(segs) + 1)) AS i FROM leaves)
  UNION ALL
  SELECT round + 1, host, raw, n, place, segment, wide OR hit, bool_or(hit AND NOT wide) OVER ()
  FROM (
    SELECT *, count(DISTINCT segment) OVER g > {VALUES} AND sum(n) OVER g < {PAGES_EACH} * count(DISTINCT segment) OVER g AS hit
    FROM (
      SELECT *, coalesce(string_agg(CASE WHEN wide THEN '*' ELSE segment END, '/') OVER (PARTITION BY host, raw ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS above
      FROM rounds WHERE changed
    ) WINDOW g AS (PARTITION BY host, place, above)
  )
),
named AS (
  SELECT host, raw, string_agg(CASE WHEN wide THEN '*' ELSE segment END, '/' ORDER BY place) AS template
  FROM rounds WHERE round = (SELECT max(round) FROM rounds) GROUP BY host, raw
),
templates AS (SELECT host, template, string_split(template, '/') AS parts, sum(labelled)::DOUBLE AS labelled, sum(bad)::DOUBLE AS bad FROM leaves JOIN named USING (host, raw) GROUP BY ALL),
places AS (SELECT host, template, labelled, bad, i AS depth, parts[i] AS segment, array_to_string(parts[1:i], '/') AS node, array_to_string(parts[1:i - 1], '/') AS above FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM templates)),
nodes AS (
  SELECT host, depth, node, above, sum(labelled) AS n, sum(bad) AS bad FROM places GROUP BY ALL
  UNION ALL SELECT host, 0, '', NULL, sum(labelled), sum(bad) FROM templates GROUP BY host
),
sided AS (
  SELECT c.*, CASE WHEN c.n > 0 THEN CASE WHEN NOT abs(c.bad - c.n * (u.bad / u.n)) > {SIMILAR}::DOUBLE * sqrt(c.n * (u.bad / u.n) * (1 - u.bad / u.n)) THEN '=' WHEN c.bad > c.n * (u.bad / u.n) THEN '+' ELSE '-' END END AS side
  FROM nodes c JOIN nodes u ON u.host = c.host AND u.depth = c.depth - 1 AND u.node = c.above
),
pools AS (SELECT host, depth, above, side, sum(bad) / sum(n) AS share FROM sided WHERE side IS NOT NULL GROUP BY ALL),
alike AS (SELECT s.*, NOT abs(s.bad - s.n * q.share) > {SIMILAR}::DOUBLE * sqrt(s.n * q.share * (1 - q.share)) AS fits FROM sided s LEFT JOIN pools q USING (host, depth, above, side)),
joint AS (SELECT host, depth, above, side, sum(n) AS n, sum(bad) AS bad FROM alike WHERE fits GROUP BY ALL HAVING count(*) > 1),
pooled AS (
  SELECT a.host, a.depth, a.node, CASE WHEN fits AND j.n IS NOT NULL THEN j.n ELSE a.n END AS n, CASE WHEN fits AND j.n IS NOT NULL THEN j.bad ELSE a.bad END AS bad,
    CASE WHEN fits AND j.n IS NOT NULL THEN a.side END AS branch
  FROM alike a LEFT JOIN joint j USING (host, depth, above, side)
),
walk AS (
  SELECT host, template, depth, segment, s.n, s.bad, branch FROM places JOIN pooled s USING (host, depth, node)
  UNION ALL SELECT t.host, template, 0, NULL, s.n, s.bad, NULL FROM templates t JOIN nodes s ON s.host = t.host AND s.depth = 0
),
shares AS (
  SELECT host, template, -1 AS depth, (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(labelled), 0) + 2.0::DOUBLE) FROM templates) AS share FROM templates
  UNION ALL
  SELECT w.host, w.template, w.depth, CASE WHEN w.n > 0 AND abs(w.bad - w.n * s.share) > {SIMILAR}::DOUBLE * sqrt(w.n * s.share * (1 - s.share))
    THEN (w.bad + {STRENGTH}::DOUBLE * s.share) / (w.n + {STRENGTH}::DOUBLE) ELSE s.share END
  FROM shares s JOIN walk w ON w.host = s.host AND w.template = s.template AND w.depth = s.depth + 1
),
final AS (SELECT host, template, arg_max(share, depth) AS share FROM shares GROUP BY ALL),
shown AS (SELECT host, template, string_agg(coalesce('{{' || branch || '}}', segment), '/' ORDER BY depth) AS branch FROM walk WHERE depth > 0 GROUP BY ALL)
SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN share >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, branch, round(share, 9) AS share
FROM p LEFT JOIN named USING (host, raw) LEFT JOIN final USING (host, template) LEFT JOIN shown USING (host, template)
"""


SQL = _sql()
