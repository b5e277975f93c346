"""Mixing sources to target weights by a splitting tree over blocks. DataFrame functions only.

Targets are in words. A source's documents stand in the order of a hash; its blocks are equal ranges of the hash, about
``block_words`` words each and at most ``MOST_BLOCKS`` in all (plus one a source). A source is taken whole as
often as its target holds it, then its first documents once more up to the target; the last one by rounding, so a
source is off by half a document at most.

The drawn blocks are dealt to ``2 ** levels`` shards: a node of the tree puts its blocks in random order and gives the
first half to the left, so the sources of a half are a multivariate hypergeometric draw from the exact quotas of the node,
and no block is in two shards. Within a shard the ``place`` of a row is a hash, to sort by when it is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridweave.llm.shelf import Shelf

WORD = r"[^\x20\x09-\x0D]+"
MOST_BLOCKS = 32768
#: The weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)


def _draw(*parts: str | Column) -> Column:
    return F.md5(F.concat_ws("/", *parts))


def raw_of(text: str) -> Column:
    """The MD5 of a text, which with doc_id names a row."""
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, words, target): 150% of all words shared by weight, at most twice a source's own.

    Sources are taken in order of 2 * words / weight: those whose share reaches their limit come first, so running sums
    say where the limits end. ``sizes`` has one row a source.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    before = Window.orderBy(F.col("words").cast("double") / F.col("weight"), "no").rowsBetween(Window.unboundedPreceding, -1)
    d = lambda c: F.col(c).cast("double")
    full = (
        ranked.withColumn("weight", weight)
        .withColumn("all_words", F.sum("words").over(everything))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("rest", F.col("all_words") * 3 - 4 * F.coalesce(F.sum("words").over(before), F.lit(0)))
        .withColumn("rest_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", d("rest") * d("weight") >= d("words") * 4 * d("rest_weight"))
        .withColumn("open", F.min(F.when(~F.col("full"), F.struct(F.col("rest_weight") * -1, "rest", "rest_weight"))).over(everything))
    )
    share = F.col("open.rest").cast("double") * d("weight") / (F.col("open.rest_weight") * 2).cast("double")
    return full.select("source", "words", "all_words", F.when(F.col("full"), d("words") * 2).otherwise(share).alias("target"))


def mix(docs: DataFrame, levels: int = 6, seed: str = "mix", block_words: int = 100_000, by_text: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shard, again_shard, place) for each row of ``docs`` (doc_id, text, source).

    ``size`` counts the words of the whole text, 0 for a null; ``taken`` is size times how often the mix has the row, 0 to 2
    times. ``shard`` and ``again_shard`` are those of the first and second time, else null. A null source is a source
    of its own, in the last place. The draw depends on doc_id and ``seed`` only, so reruns agree; rows with the same
    doc_id stand side by side. Other columns are ignored; an empty table gives an empty one.

    With ``by_text`` the draw depends on the text as well, so rows with a null or repeated doc_id are spread like others, and
    the result has ``raw``, the MD5 of the text, and ``source``, to name the row.
    """
    shelf = Shelf(docs.sparkSession, "mix")
    name = ["raw"] if by_text else []
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = shelf.put(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), *[raw_of("text").alias(c) for c in name]))
    of_source = shelf.put(targets(rows.groupBy("source").agg(F.sum("size").alias("words"))))
    per_block = F.greatest(F.lit(block_words), F.expr(f"all_words div {MOST_BLOCKS} + 1"))
    of_source = (
        of_source.withColumn("blocks", F.expr("words div 1") / per_block)
        .withColumn("blocks", F.floor("blocks") + 1)
        .withColumn("times", F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0).cast("long"))
        .withColumn("more", F.col("target") - F.col("times") * F.col("words"))
        .select(F.col("source").alias("s"), "words", "target", "blocks", "times", "more")
    )
    order = _draw(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), *name)
    placed = rows.withColumn("place", order).join(of_source, F.col("source").eqNullSafe(F.col("s")))
    block = F.floor(F.conv(F.substring("place", 1, 8), 16, 10).cast("long") * F.col("blocks") / F.lit(1 << 32)).cast("long")
    placed = placed.withColumn("block", block)
    blocks = placed.groupBy("s", "block").agg(F.sum("size").alias("n"), F.first("times").alias("times"), F.first("more").alias("more"))
    running = Window.partitionBy("s").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = shelf.put(blocks.withColumn("from_word", F.coalesce(F.sum("n").over(running), F.lit(0))))

    # A block is drawn in full `times` times, and once more if the rest of the target begins before its end.
    drawn = blocks.select("s", "block", F.explode(F.sequence(F.lit(1), F.when(F.col("from_word") < F.col("more"), F.col("times") + 1).otherwise(F.greatest("times", F.lit(1))))).alias("time"))
    drawn = drawn.withColumn("node", F.lit(0).cast("long"))
    for level in range(levels):
        key = _draw(F.lit(seed), F.lit(str(level)), F.coalesce("s", F.lit("")), F.col("s").isNull().cast("int").cast("string"), F.col("block").cast("string"), F.col("time").cast("string"))
        node = Window.partitionBy("node")
        drawn = drawn.withColumn("key", key).withColumn("nth", F.row_number().over(node.orderBy("key"))).withColumn("all", F.count(F.lit(1)).over(node))
        drawn = drawn.withColumn("node", F.col("node") * 2 + (F.col("nth") * 2 > F.col("all") + 1).cast("long")).drop("key", "nth", "all")
    shards = drawn.groupBy("s", "block").agg(F.min(F.when(F.col("time") == 1, F.col("node"))).alias("first_shard"), F.min(F.when(F.col("time") == 2, F.col("node"))).alias("second_shard"))
    of_block = shelf.put(blocks.join(shards.withColumnsRenamed({"s": "s2", "block": "b2"}), F.col("s").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2"))).select(F.col("s").alias("s2"), F.col("block").alias("b2"), "from_word", "first_shard", "second_shard"))

    inside = Window.partitionBy("source", "block").orderBy("place", "doc_id", "size", *name).rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    own = own.join(of_block, F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")))
    more = ((F.col("from_word") + F.col("ahead")) * 2 + F.col("size") < F.col("more") * 2).cast("long")
    own = own.withColumn("copies", F.col("times") + more)
    return own.select(
        "doc_id",
        "size",
        F.col("words").alias("source_size"),
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
        F.when(F.col("copies") > 0, F.col("first_shard")).alias("shard"),
        F.when(F.col("copies") > 1, F.col("second_shard")).alias("again_shard"),
        "place",
        *name,
        *(["source"] if by_text else []),
    )


def oracle(levels: int = 6, seed: str = "mix", block_words: int = 100_000) -> str:
    """The same in DuckDB."""
    tree = ["t0 AS (SELECT *, CAST(0 AS BIGINT) AS node FROM drawn)"]
    for level in range(levels):
        key = f"md5('{seed}/{level}/' || coalesce(s, '') || '/' || CAST(s IS NULL AS INT) || '/' || block || '/' || time)"
        tree.append(f"""t{level + 1} AS (SELECT s, block, time, node * 2 + CAST(nth * 2 > n + 1 AS BIGINT) AS node FROM
            (SELECT *, row_number() OVER (PARTITION BY node ORDER BY {key}) AS nth, count(*) OVER (PARTITION BY node) AS n FROM t{level}))""")
    weight = "CASE no % 3 " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS)) + " END"
    return f"""WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5('{seed}/' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place FROM documents),
    s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM docs GROUP BY source),
    s1 AS (SELECT *, CAST({weight} AS BIGINT) AS weight FROM s0),
    s2 AS (SELECT *, CAST(sum(words) OVER () AS BIGINT) AS all_words, CAST(sum(words) OVER () AS BIGINT) * 3 - 4 * CAST(coalesce(sum(words) OVER before, 0) AS BIGINT) AS rest,
        CAST(sum(weight) OVER () AS BIGINT) - CAST(coalesce(sum(weight) OVER before, 0) AS BIGINT) AS rest_weight FROM s1
        WINDOW before AS (ORDER BY CAST(words AS DOUBLE) / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s3 AS (SELECT *, CAST(rest AS DOUBLE) * weight >= CAST(words AS DOUBLE) * 4 * rest_weight AS filled FROM s2),
    s4 AS (SELECT *, CASE WHEN filled THEN CAST(words AS DOUBLE) * 2 ELSE CAST(max_by(rest, rest_weight) FILTER (NOT filled) OVER () AS DOUBLE) * weight
        / CAST(2 * (max(rest_weight) FILTER (NOT filled) OVER ()) AS DOUBLE) END AS target FROM s3),
    s5 AS (SELECT source AS s, words, target, floor(CAST(words AS DOUBLE) / greatest({block_words}, all_words // {MOST_BLOCKS} + 1)) + 1 AS blocks,
        CASE WHEN words > 0 THEN CAST(floor(target / words) AS BIGINT) ELSE 0 END AS times FROM s4),
    s6 AS (SELECT *, target - times * words AS more FROM s5),
    placed AS (SELECT *, CAST(floor(CAST(('0x' || substr(place, 1, 8)) AS BIGINT) * blocks / 4294967296.0::DOUBLE) AS BIGINT) AS block FROM docs JOIN s6 ON source IS NOT DISTINCT FROM s),
    b0 AS (SELECT s, block, sum(size) AS n, any_value(times) AS times, any_value(more) AS more FROM placed GROUP BY s, block),
    b1 AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY s ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS from_word FROM b0),
    drawn AS (SELECT s, block, unnest(range(1, 1 + CASE WHEN from_word < more THEN times + 1 ELSE greatest(times, 1) END)) AS time FROM b1),
    {", ".join(tree)},
    shards AS (SELECT s, block, min(node) FILTER (time = 1) AS first_shard, min(node) FILTER (time = 2) AS second_shard FROM t{levels} GROUP BY s, block),
    own AS (SELECT p.*, b.from_word + coalesce(sum(size) OVER (PARTITION BY p.s, p.block ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, first_shard, second_shard
        FROM placed p JOIN b1 b ON p.s IS NOT DISTINCT FROM b.s AND p.block = b.block JOIN shards h ON p.s IS NOT DISTINCT FROM h.s AND p.block = h.block),
    copies AS (SELECT *, times + CAST(CAST(ahead AS DOUBLE) * 2 + size < more * 2 AS INT) AS copies FROM own)
    SELECT doc_id, size, words AS source_size, target, size * copies AS taken, CASE WHEN copies > 0 THEN first_shard END AS shard,
        CASE WHEN copies > 1 THEN second_shard END AS again_shard, place FROM copies"""
