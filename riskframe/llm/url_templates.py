"""URL filters: rules by host and path, and a path-template tree learned for each host.

The tree is grown level by level. Under one parent template a path segment stays literal if
enough pages stand below it and its share of bad labelled pages differs from its siblings' by a
two-proportion test; all others, variable and statistically similar ones, become a wildcard.
A template's purity is its share of bad labelled pages, smoothed towards its host's and the
whole table's; templates at ``REJECT`` or more are blocked where no rule decides.

Pages are labelled through the number in the last part of their path, the document they show.
A page is bad if that document is labelled of low quality or toxic.

Levels work on distinct (host, path) rows with counts, by partial aggregates; each level is a
table in the shared folder. Paths deeper than ``DEPTH`` end in ``**``.

Defined results: a null url or one without ``://`` has empty host and path and is judged by that
template; without labels everything that no rule blocks is allowed; repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.llm.stage import staged

# Action, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))
DEPTH = 6
SUPPORT, APART = 20, 1.96
SMOOTH, REJECT = 10.0, 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def address(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    empty = F.lit("")
    host = F.coalesce(F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER), empty)
    return host, F.coalesce(F.regexp_extract(url, pattern, 2), empty)


def judged(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; null if none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):     # later ones, longer, win
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def addressed(pages: DataFrame) -> DataFrame:
    host, path = address(F.col("url"))
    return pages.select("page_id", host.alias("host"), path.alias("path"))


def templates(places: DataFrame) -> DataFrame:
    """(host, path, template, purity) of distinct (host, path, n, labelled, bad) rows."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = places.select("*", parts.alias("parts"), F.lit("").alias("prefix"))
    for level in range(1, DEPTH + 1):
        seg = F.when(F.size("parts") >= level, F.get("parts", F.lit(level - 1)))
        rows = staged(rows.withColumn("seg", seg), "level")
        below = (rows.where("seg IS NOT NULL").groupBy("host", "prefix", "seg")
                 .agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b")))
        below = staged(below, "branches")
        parent = below.groupBy("host", "prefix").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb"))
        other_l, other_b = F.col("pl") - F.col("l"), F.col("pb") - F.col("b")
        share = F.try_divide("pb", "pl")            # null, hence not apart, without labels
        spread = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), F.col("l")) + F.try_divide(F.lit(1.0), other_l)))
        z = F.try_divide(F.abs(F.try_divide("b", "l") - F.try_divide(other_b, other_l)), spread)
        apart = (F.col("l") > 0) & (other_l > 0) & (share > 0) & (share < 1)
        kept = (below.join(parent, ["host", "prefix"]).where((F.col("n") >= SUPPORT) & apart)
                .where(z >= APART).select("host", "prefix", "seg", F.lit(True).alias("literal")))
        rows = rows.join(kept, ["host", "prefix", "seg"], "left").select(
            "host", "path", "n", "labelled", "bad", "parts",
            F.when(F.col("seg").isNull(), F.col("prefix"))
            .otherwise(F.concat("prefix", F.lit("/"), F.when(F.col("literal"), F.col("seg")).otherwise(F.lit("*")))).alias("prefix"))
    rows = staged(rows.select("host", "path", "labelled", "bad", F.when(F.size("parts") > DEPTH, F.concat("prefix", F.lit("/**")))
                              .otherwise(F.col("prefix")).alias("template")), "templates")
    whole = rows.agg(F.sum("labelled").alias("wl"), F.sum("bad").alias("wb"))
    hosts = rows.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    prior = F.coalesce(F.col("wb") / F.when(F.col("wl") > 0, F.col("wl")), F.lit(0.0))
    hosts = hosts.join(F.broadcast(whole)).select(      # one row of totals
        "host", ((F.col("hb") + SMOOTH * prior) / (F.col("hl") + SMOOTH)).alias("host_purity"))
    sums = rows.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    pure = sums.join(hosts, "host").select(
        "host", "template", ((F.col("b") + SMOOTH * F.col("host_purity")) / (F.col("l") + SMOOTH)).alias("purity"))
    return rows.select("host", "path", "template").join(pure, ["host", "template"])


def filtered(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdict, rule, template and purity of every page."""
    placed = addressed(pages)
    number = F.regexp_extract("path", r"([0-9]{1,18})[^/0-9]*/?$", 1)
    bad = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("is_bad"))
    counted = (placed.groupBy("host", "path").agg(F.count("*").alias("n"))
               .withColumn("shown", F.when(number != "", number.cast("bigint")))
               .join(bad, F.col("shown") == F.col("doc_id"), "left")
               .select("host", "path", "n", F.when(F.col("is_bad").isNull(), 0).otherwise(F.col("n")).cast("bigint").alias("labelled"),
                       (F.coalesce("is_bad", F.lit(0)) * F.col("n")).cast("bigint").alias("bad")))
    learned = templates(staged(counted, "places"))
    rule, action = judged(F.col("host"), F.col("path"))
    method = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return placed.join(learned, ["host", "path"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"), "template", "purity")


def op8(spark, sf_dir: str) -> DataFrame:
    return filtered(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("purity")


def _sql() -> str:
    cases = {"rule": "", "act": ""}
    for act, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN "
        cases["rule"] += fits + f"'{h + p}' "
        cases["act"] += fits + f"'{act}' "
    levels = "r0 AS (SELECT *, '' AS prefix FROM places)"
    for k in range(1, DEPTH + 1):
        levels += f""",
s{k} AS (SELECT *, parts[{k}] AS seg FROM r{k - 1}),
b{k} AS (SELECT host, prefix, seg, sum(n) AS n, sum(labelled)::DOUBLE AS l, sum(bad)::DOUBLE AS b
         FROM s{k} WHERE seg IS NOT NULL GROUP BY ALL),
q{k} AS (SELECT *, sum(l) OVER g AS pl, sum(b) OVER g AS pb FROM b{k} WINDOW g AS (PARTITION BY host, prefix)),
k{k} AS (SELECT host, prefix, seg FROM q{k} WHERE n >= {SUPPORT} AND l > 0 AND pl - l > 0 AND pb > 0 AND pb < pl
         AND abs(b / l - (pb - b) / (pl - l)) / sqrt(pb / pl * (1 - pb / pl) * (1.0::DOUBLE / l + 1.0::DOUBLE / (pl - l))) >= {APART}),
r{k} AS (SELECT s.host, s.path, s.n, s.labelled, s.bad, s.parts,
         CASE WHEN s.seg IS NULL THEN s.prefix WHEN k.seg IS NULL THEN s.prefix || '/*' ELSE s.prefix || '/' || s.seg END AS prefix
         FROM s{k} s LEFT JOIN k{k} k USING (host, prefix, seg))"""
    return rf"""
WITH placed AS (
  SELECT page_id, url,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM placed),
counted AS (
  SELECT host, path, count(*) AS n, try_cast(nullif(regexp_extract(path, '([0-9]{{1,18}})[^/0-9]*/?$', 1), '') AS BIGINT) AS shown
  FROM split GROUP BY host, path),
judge AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS is_bad FROM labels GROUP BY doc_id),
places AS (
  SELECT host, path, n, CASE WHEN is_bad IS NULL THEN 0 ELSE n END AS labelled, coalesce(is_bad, 0) * n AS bad,
         list_filter(string_split(path, '/'), lambda x: x <> '') AS parts
  FROM counted LEFT JOIN judge ON shown = doc_id),
{levels},
t AS (SELECT host, path, labelled, bad, CASE WHEN len(parts) > {DEPTH} THEN prefix || '/**' ELSE prefix END AS template FROM r{DEPTH}),
w AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(labelled), 0), 0.0::DOUBLE) AS prior FROM t),
h AS (SELECT host, (sum(bad) + {SMOOTH}::DOUBLE * (SELECT prior FROM w)) / (sum(labelled) + {SMOOTH}::DOUBLE) AS hp FROM t GROUP BY host),
p AS (SELECT t.host, template, (sum(bad) + {SMOOTH}::DOUBLE * any_value(hp)) / (sum(labelled) + {SMOOTH}::DOUBLE) AS purity
      FROM t JOIN h USING (host) GROUP BY ALL)
SELECT page_id, s.host, s.path, CASE {cases['rule']} END AS rule,
       coalesce(CASE {cases['act']} END, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template
FROM split s JOIN t ON s.host = t.host AND s.path = t.path JOIN p USING (host, template)
"""


SQL = _sql().replace("SELECT page_id, s.host, s.path, CASE", "SELECT page_id, host, path, CASE").replace(
    "FROM split s JOIN t ON s.host = t.host AND s.path = t.path", "FROM split JOIN t USING (host, path)")
