"""URL filter: rules first, then a path-template tree for each host. DataFrame functions only.

1. A segment with a digit is variable: ``*``. Level by level, a parent with more than ``children`` different segments that
   are seen less than ``support`` times on average has ``*`` for all of them. A parent of at most ``children`` different
   paths can have no such descendant, so the tree goes down only below the others, until none is left.
2. Urls that a rule decides are labels. Branches (first segments) of a host whose share of blocked labels does not differ
   from the host's by ``z`` standard errors are merged; ``~`` stands for all of them. The others are put in order of their
   share, above and below the host's apart, and neighbours that do not differ either are merged: ``~1``, ``~-1`` and so on.
3. A template is rejected if the blocked share of its labels, smoothed with ``mass`` labels of its branch, which is
   smoothed by its domain (last two host labels) and that by all urls, is above a half.

Tables of templates are small beside the urls: equal templates are summed before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.shelf import Shelf

#: Rule and verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHILDREN, SUPPORT, Z2, MASS = 16, 4, 4, 5
#: Levels of the tree that one job makes.
LEVELS = 3


def _rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    out = None
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _smoothed(blocked: str, labels: str, prior: Column, mass: int) -> Column:
    return (F.col(blocked) + mass * prior) / (F.col(labels) + mass)


def _level(forms: DataFrame, k: int, children: int, support: int) -> DataFrame:
    """Templates with one more segment: ``*`` below a parent of many rare ones."""
    forms = forms.withColumn("part", F.coalesce(F.get("parts", F.lit(k)), F.lit("")))
    kids = forms.groupBy("host", "node", "part").agg(F.sum("n").alias("n"))
    kids = kids.groupBy("host", "node").agg(F.count(F.lit(1)).alias("kids"), F.sum("n").alias("seen"))
    wild = (F.col("kids") > children) & (F.col("seen") < F.col("kids") * support)
    step = F.concat(F.lit("/"), F.when(wild, F.lit("*")).otherwise(F.col("part")))
    grown = F.when(F.size("parts") > k, F.concat("node", step)).otherwise(F.col("node"))
    forms = forms.join(kids, ["host", "node"]).withColumn("node", grown).drop("kids", "seen", "part")
    return forms.withColumn("branch", F.col("node")) if k == 1 else forms


def _templates(forms: DataFrame, shelf: Shelf, children: int, support: int) -> DataFrame:
    """(host, form, domain, branch, rest, labels, blocked): each form with the segments of its template."""
    forms = forms.withColumns({"parts": F.split("form", "/"), "node": F.lit(""), "branch": F.lit("")})
    done, k = [], 1
    while True:
        for level in range(k, k + LEVELS):
            forms = _level(forms, level, children, support)
        k += LEVELS
        forms = shelf.put(forms)
        crowded = forms.where(F.size("parts") >= k).groupBy("host", "node").agg(F.count(F.lit(1)).alias("forms"))
        crowded = shelf.put(crowded.where(F.col("forms") > children).select("host", "node"))
        done.append(forms.join(crowded, ["host", "node"], "left_anti").withColumn("done_at", F.lit(k)))
        if crowded.isEmpty():
            break
        forms = forms.join(crowded, ["host", "node"], "left_semi")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    tail = F.when(F.size("parts") > F.col("done_at"), F.concat(F.lit("/"), F.array_join(F.expr("slice(parts, done_at + 1, size(parts))"), "/")))
    rest = F.concat(F.expr("substr(node, length(branch) + 1)"), F.coalesce(tail, F.lit("")))
    return out.select("host", "form", F.substring_index("host", ".", -2).alias("domain"), "branch", rest.alias("rest"), "labels", "blocked")


def _merged(branches: DataFrame, z2: int) -> DataFrame:
    """(host, branch, merged) of (host, branch, rn, rb, hn, hb, apart).

    Branches with equal counts are one before the order is made, so a host of many branches brings few rows to it.
    """
    side = F.when(F.col("rb") * F.col("hn") > F.col("rn") * F.col("hb"), 1).otherwise(-1)
    away = branches.where("apart").withColumn("side", side)
    kinds = away.groupBy("host", "side", "rn", "rb").agg(F.count(F.lit(1)).alias("many"), F.min("branch").alias("least"))
    line = Window.partitionBy("host", "side").orderBy(F.col("rb") / F.col("rn"), "rn")
    kinds = kinds.withColumns({"pn": F.lag("rn").over(line), "pb": F.lag("rb").over(line)})
    new = F.expr(f"(rb * pn - pb * rn) * (rb * pn - pb * rn) * (rn + pn) > {z2} * rn * pn * (rb + pb) * (rn + pn - rb - pb)")
    kinds = kinds.withColumn("no", F.sum(F.coalesce(new.cast("int"), F.lit(1))).over(line) * F.col("side"))
    groups = kinds.groupBy("host", "side", "no").agg(F.sum("many").alias("many"), F.min("least").alias("least"))
    alone = (F.col("many") == 1) & (F.col("least") != "/~")
    groups = groups.withColumn("merged", F.when(alone, F.col("least")).otherwise(F.concat(F.lit("/~"), F.col("no").cast("string"))))
    names = kinds.join(groups.select("host", "no", "merged"), ["host", "no"]).select("host", "rn", "rb", "merged")
    near = branches.where("not apart").select("host", "branch", F.lit("/~").alias("merged"))
    return near.unionByName(away.join(names, ["host", "rn", "rb"]).select("host", "branch", "merged"))


def url_verdicts(
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    children: int = CHILDREN,
    support: int = SUPPORT,
    z2: int = Z2,
    mass: int = MASS,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template) for each row of ``pages`` (page_id, url; other columns are ignored).

    A url that is null or without ``://`` has an empty host and path and is judged like any other: by the smoothed share
    of all urls if nothing nearer is labelled. ``rules`` is a short literal list; the longest that fits wins. Repeated
    rows count each; an empty table gives an empty one; without labels everything is allowed.
    """
    shelf = Shelf(pages.sparkSession, "urls")
    text = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host, path = F.translate(F.regexp_extract(text, URL, 1), UPPER, LOWER), F.regexp_extract(text, URL, 2)
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("hit", _rule(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", "hit.rule", F.col("hit.verdict").alias("ruled"), F.regexp_replace("path", "[^/]*[0-9][^/]*", "*").alias("form"))

    count = lambda rule: F.sum(F.expr(f"case when {rule} then 1 else 0 end"))
    forms = rows.groupBy("host", "form").agg(F.count(F.lit(1)).alias("n"), count("ruled is not null").alias("labels"), count("ruled = 'block'").alias("blocked"))
    forms = shelf.put(_templates(forms, shelf, children, support))
    sums = [F.sum("labels").cast("double").alias("n"), F.sum("blocked").cast("double").alias("b")]
    named = lambda x: [F.sum("labels").cast("double").alias(f"{x}n"), F.sum("blocked").cast("double").alias(f"{x}b")]
    branches = forms.groupBy("host", "branch").agg(*named("r")).join(forms.groupBy("host").agg(*named("h")), "host")
    apart = F.expr(f"(rb * hn - rn * hb) * (rb * hn - rn * hb) > {z2} * rn * hb * (hn - hb)")
    branches = shelf.put(_merged(branches.withColumn("apart", apart), z2))
    forms = shelf.put(forms.join(branches, ["host", "branch"]))
    every = forms.agg(*named("g"))
    domains = forms.groupBy("domain").agg(*sums).crossJoin(F.broadcast(every))  # `every` is one row
    domains = domains.select("domain", _smoothed("b", "n", (F.col("gb") + 0.0) / F.greatest(F.col("gn"), F.lit(1.0)), mass).alias("domain_share"))
    merged = forms.groupBy("host", "domain", "merged").agg(*sums).join(domains, "domain")
    merged = merged.select("host", "merged", _smoothed("b", "n", F.col("domain_share"), mass).alias("branch_share"))
    templates = forms.groupBy("host", "merged", "rest").agg(*sums).join(merged, ["host", "merged"])
    templates = templates.select("host", "merged", "rest", _smoothed("b", "n", F.col("branch_share"), mass).alias("share"))
    judged = forms.join(templates, ["host", "merged", "rest"]).select("host", "form", F.concat("merged", "rest").alias("template"), "share")
    verdict = F.coalesce("ruled", F.when(F.col("share") > 0.5, F.lit("block")).otherwise(F.lit("allow")))
    judged = shelf.put(judged)
    shelf.keep(judged)
    return rows.join(judged, ["host", "form"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template")


def oracle() -> str:
    """The same in DuckDB."""
    cases = {"rule": "", "ruled": ""}
    for rule, verdict in sorted(RULES, key=lambda r: -len(r[0])):
        own, slash, rest = rule.partition("/")
        fits = f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{slash + rest}')"
        cases["rule"] += f" WHEN {fits} THEN '{rule}'"
        cases["ruled"] += f" WHEN {fits} THEN '{verdict}'"
    sums = "CAST(sum(labels) AS DOUBLE) AS n, CAST(sum(blocked) AS DOUBLE) AS b"
    return f"""WITH RECURSIVE p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages),
    rows AS (SELECT *, CASE {cases["rule"]} END AS rule, CASE {cases["ruled"]} END AS ruled, regexp_replace(path, '[^/]*[0-9][^/]*', '*', 'g') AS form FROM p),
    f0 AS (SELECT host, form, count(*) AS n, count(ruled) AS labels, count(*) FILTER (ruled = 'block') AS blocked, string_split(form, '/') AS parts FROM rows GROUP BY host, form),
    tree AS (SELECT host, form, parts, n, labels, blocked, 1 AS k, '' AS node, '' AS branch FROM f0 UNION ALL
        SELECT host, form, parts, n, labels, blocked, k + 1, grown, CASE WHEN k = 1 THEN grown ELSE branch END FROM
            (SELECT *, node || '/' || CASE WHEN kids > {CHILDREN} AND seen < kids * {SUPPORT} THEN '*' ELSE parts[k + 1] END AS grown FROM
                (SELECT *, count(DISTINCT coalesce(parts[k + 1], '')) OVER (PARTITION BY host, node) AS kids, sum(n) OVER (PARTITION BY host, node) AS seen FROM tree))
        WHERE len(parts) > k),
    forms AS (SELECT host, form, array_to_string(string_split(host, '.')[-2:], '.') AS domain, branch, substr(node, length(branch) + 1) AS rest, labels, blocked
        FROM tree WHERE len(parts) = k),
    h AS (SELECT host, {sums} FROM forms GROUP BY host),
    r AS (SELECT host, branch, {sums} FROM forms GROUP BY host, branch),
    apart AS (SELECT r.*, CASE WHEN r.b * h.n > r.n * h.b THEN 1 ELSE -1 END AS side, (r.b * h.n - r.n * h.b) * (r.b * h.n - r.n * h.b) > {Z2} * r.n * h.b * (h.n - h.b) AS away
        FROM r JOIN h USING (host)),
    before AS (SELECT host, side, n, b, lag(n) OVER line AS pn, lag(b) OVER line AS pb FROM (SELECT DISTINCT host, side, n, b FROM apart WHERE away)
        WINDOW line AS (PARTITION BY host, side ORDER BY b / n, n)),
    kinds AS (SELECT host, side, n, b, side * sum(CASE WHEN (b * pn - pb * n) * (b * pn - pb * n) * (n + pn) > {Z2} * n * pn * (b + pb) * (n + pn - b - pb) OR pn IS NULL THEN 1 ELSE 0 END)
        OVER (PARTITION BY host, side ORDER BY b / n, n) AS no FROM before),
    merging AS (SELECT host, branch, CASE WHEN NOT away THEN '/~' WHEN count(*) OVER (PARTITION BY host, away, no) = 1 AND branch <> '/~' THEN branch ELSE '/~' || CAST(no AS BIGINT) END AS merged
        FROM apart LEFT JOIN kinds USING (host, side, n, b)),
    own AS (SELECT f.*, merged FROM forms f JOIN merging USING (host, branch)),
    g AS (SELECT CAST(sum(blocked) AS DOUBLE) / greatest(CAST(sum(labels) AS DOUBLE), 1.0) AS share FROM own),
    d AS (SELECT domain, (b + {MASS} * g.share) / (n + {MASS}) AS share FROM (SELECT domain, {sums} FROM own GROUP BY domain), g),
    m AS (SELECT host, merged, (b + {MASS} * d.share) / (n + {MASS}) AS share FROM (SELECT host, domain, merged, {sums} FROM own GROUP BY ALL) JOIN d USING (domain)),
    t AS (SELECT host, merged, rest, (b + {MASS} * m.share) / (n + {MASS}) AS share FROM (SELECT host, merged, rest, {sums} FROM own GROUP BY ALL) JOIN m USING (host, merged)),
    judged AS (SELECT host, form, merged || rest AS template, share FROM own JOIN t USING (host, merged, rest))
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN share > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template FROM rows JOIN judged USING (host, form)"""
