"""Secret scan with multipart credential linking. DataFrame functions only.

Each whole text is searched once for five kinds of parts. ``assign``, ``access`` and ``hex`` are reported as they are. A
``weak`` part (a mixed token without a name) and an ``endpoint`` (URL or IPv4 address) are reported only when they
overlap none of these and a complementary part stands within ``reach`` code points: an access identifier or endpoint
for a weak token, an access identifier or secret for an endpoint.

The interval join is a sweep: parts of a document in order of their start, each with the nearest end before it and
the nearest start after it of each role. A document with many parts is sorted, never joined with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The searched patterns.
PATTERNS = {
    "assign": r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "weak": r"[A-Za-z0-9+/]+",
    "endpoint": r"""https?://[^\x20\x09-\x0D"'<>]+|[0-9]{1,3}(?:\.[0-9]{1,3}){3}""",
}
#: A text without this holds no part of the kind that counts.
NEEDED = {
    "assign": PATTERNS["assign"][:-1].removesuffix("+") + "{8})",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
    "weak": r"[A-Za-z0-9+/]{20}",
    "endpoint": PATTERNS["endpoint"],
}
KINDS = list(PATTERNS)
REACH = 200


def _needed(kind: str, text: Column) -> Column:
    return text.rlike(NEEDED[kind])


def _found(kind: str, text: Column) -> Column:
    """The matches of a kind with the lengths between them; null where the text can't hold one that counts."""
    group = 2 if kind == "assign" else 0
    pattern = F.lit(PATTERNS[kind])
    return F.when(
        _needed(kind, text),
        F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            F.transform(F.split(text, PATTERNS[kind], -1), F.length).alias("gaps"),
            F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("lengths"),
            F.regexp_extract_all(text, pattern, F.lit(group)).alias("values"),
        ),
    )


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, raw, kind, start, end): the parts of each different (doc_id, text), with code point offsets."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kinds = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.md5(text).alias("raw"),
        F.explode(F.array_compact(F.array(*[_found(k, text) for k in KINDS]))).alias("found"),
    )
    each = kinds.select("doc_id", "raw", F.col("found.kind").alias("kind"), F.posexplode(F.arrays_zip("found.gaps", "found.lengths", "found.values")).alias("at", "part"))
    each = each.where("part.lengths is not null").dropDuplicates(["doc_id", "raw", "kind", "at"])
    line = Window.partitionBy("doc_id", "raw", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value, size = F.col("part.values"), F.col("part.lengths")
    mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]") & (size >= 20)
    long_enough = F.when(F.col("kind") == 0, F.length(value) >= 8).when(F.col("kind") == 1, size >= 16).when(F.col("kind") == 2, size >= 32)
    return (
        each.withColumn("end", F.sum(F.col("part.gaps") + size).over(line))
        .withColumn("start", F.col("end") - size)
        .where(long_enough.when(F.col("kind") == 3, mixed).otherwise(True))
        .select("doc_id", "raw", "kind", "start", "end")
    )


def linked(found: DataFrame, reach: int) -> DataFrame:
    """The parts to report: base parts, and weak ones with a complementary part in reach."""
    order = Window.partitionBy("doc_id", "raw").orderBy("start", "kind")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    roles = {"base": "kind <= 2", "access": "kind = 1", "secret": "kind in (0, 2)", "endpoint": "kind = 4"}
    for name, rule in roles.items():
        found = found.withColumn(f"{name}_end", F.max(F.expr(f"case when {rule} then end end")).over(before))
        found = found.withColumn(f"{name}_start", F.min(F.expr(f"case when {rule} then start end")).over(after))
    near = {r: F.expr(f"coalesce(start - {r}_end <= {reach}, false) or coalesce({r}_start - end <= {reach}, false)") for r in roles}
    clear = F.expr("coalesce(base_end <= start, true) and coalesce(base_start >= end, true)")
    weak = (F.col("kind") == 3) & clear & (near["access"] | near["endpoint"])
    endpoint = (F.col("kind") == 4) & clear & (near["access"] | near["secret"])
    return found.where((F.col("kind") <= 2) | weak | endpoint).select("doc_id", "raw", "kind", "start", "end")


def secret_scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans) for each row of ``docs`` (doc_id, text).

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind, comma-joined; ``base_sha256`` is the digest
    of those of the base kinds. A null text is empty; without spans the string is empty. Repeated rows get the same
    result each; a null doc_id stays null. Other columns are ignored; an empty table gives an empty one.
    """
    names = F.array(*[F.lit(k) for k in KINDS])
    own = linked(parts(docs), reach)
    span = F.struct("start", "kind", F.concat_ws(":", names[F.col("kind")], "start", "end").alias("name"))
    count = lambda rule: F.count(F.when(F.expr(rule), 1))
    joined = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: s["name"]), ",")
    by_doc = own.groupBy("doc_id", "raw").agg(
        *[count(f"kind = {i}").alias(f"n_{KINDS[i]}") for i in range(3)],
        count("kind > 2").alias("n_linked"),
        joined(F.collect_list(F.when(F.col("kind") <= 2, span))).alias("base"),
        joined(F.collect_list(span)).alias("spans"),
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    out = rows.join(by_doc, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("raw")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("id").alias("doc_id"),
        *[zero(c) for c in ("n_assign", "n_access", "n_hex", "n_linked")],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _kind_sql(kind: str) -> str:
    pattern, group = _literal(PATTERNS[kind]), 2 if kind == "assign" else 0
    return f"""SELECT doc_id, raw, {KINDS.index(kind)} AS kind, unnest(list_transform(string_split_regex(text, {pattern}), lambda x: length(x))) AS gap,
        unnest(list_transform(regexp_extract_all(text, {pattern}), lambda x: length(x))) AS size, unnest(regexp_extract_all(text, {pattern}, {group})) AS value,
        unnest(range(1, len(string_split_regex(text, {pattern})) + 1)) AS place FROM docs WHERE regexp_matches(text, {_literal(NEEDED[kind])})"""


def oracle(reach: int = REACH) -> str:
    """The same in DuckDB."""
    roles = {"base": "kind <= 2", "access": "kind = 1", "secret": "kind in (0, 2)", "endpoint": "kind = 4"}
    sides = ", ".join(f'max(CASE WHEN {r} THEN "end" END) OVER before AS {n}_end, min(CASE WHEN {r} THEN start END) OVER after AS {n}_start' for n, r in roles.items())
    near = {n: f'(coalesce(start - {n}_end <= {reach}, false) OR coalesce({n}_start - "end" <= {reach}, false))' for n in roles}
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END || ':' || start || ':' || \"end\""
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS raw FROM documents),
    found AS ({" UNION ".join(_kind_sql(k) for k in KINDS)}),
    placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY doc_id, raw, kind ORDER BY place ROWS UNBOUNDED PRECEDING) AS "end" FROM found WHERE size IS NOT NULL),
    parts AS (SELECT doc_id, raw, kind, CAST("end" - size AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM placed
        WHERE CASE kind WHEN 0 THEN length(value) >= 8 WHEN 1 THEN size >= 16 WHEN 2 THEN size >= 32
            WHEN 3 THEN size >= 20 AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]') ELSE true END),
    sides AS (SELECT *, {sides} FROM parts WINDOW before AS (PARTITION BY doc_id, raw ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        after AS (PARTITION BY doc_id, raw ORDER BY start, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
    kept AS (SELECT doc_id, raw, kind, start, {name} AS name FROM sides WHERE kind <= 2 OR
        (coalesce(base_end <= start, true) AND coalesce(base_start >= "end", true) AND
         CASE kind WHEN 3 THEN {near["access"]} OR {near["endpoint"]} ELSE {near["access"]} OR {near["secret"]} END)),
    by_doc AS (SELECT doc_id, raw, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        count(*) FILTER (kind > 2) AS n_linked, string_agg(name, ',' ORDER BY start, kind) FILTER (kind <= 2) AS base, string_agg(name, ',' ORDER BY start, kind) AS spans FROM kept GROUP BY ALL)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_linked, 0) AS n_linked,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs d LEFT JOIN by_doc b ON d.doc_id IS NOT DISTINCT FROM b.doc_id AND d.raw = b.raw"""
