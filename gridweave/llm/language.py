"""Language identification by Bayesian evidence fusion.

1. Text likelihood: byte trigrams (A-Z lower-cased, ``BUCKETS`` hash buckets) of the whole texts are counted by declared
   language over all rows. Every declared language with a trigram has a model, of the buckets it was seen in (``least_share`` of the
   declared rows is a bound for the caller to set). Each row gets its mean log likelihood by language, times at most ``weight`` trigrams.
2. Declared language and address suffix: how often texts of a language (by likelihood) carry each value.
3. Host prior: counts of languages by host, smoothed with ``mass`` rows of the domain's shares, and these of all rows'.
   All counts are grouped aggregations, so a host with a third of the rows is summed before the shuffle.
4. The posterior is the normalised product. Absent evidence (null) adds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridweave.llm.shelf import Shelf
from gridweave.llm.words import LOWER, Block, blocks, per_text

BUCKETS = 1 << 15


def _trigrams(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the trigram at each byte, whether it lies inside one text and has a letter)."""
    low = LOWER[block.data].astype(np.uint32)
    n = len(low)
    bucket = np.zeros(n, dtype=np.int64)
    inside = np.zeros(n, dtype=bool)
    if n >= 3:
        mixed = (low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
        bucket[:-2] = mixed >> np.uint32(17)
        letter = ((low >= 0x61) & (low <= 0x7A)) | (low >= 0x80)
        inside[:-2] = letter[:-2] | letter[1:-1] | letter[2:]
        ends = block.offsets[1:]
        for back in (1, 2):
            at = ends - back
            inside[at[at >= 0]] = False
    return bucket, inside


def _counted(rows: DataFrame, languages: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, trigrams in them) by declared language, in order of the buckets."""
    number = {x: i for i, x in enumerate(languages)}

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.array([number.get(x, -1) for x in batch["declared"].to_pylist()])
            for block in blocks(batch["text"]):
                bucket, inside = _trigrams(block)
                language = np.repeat(own[block.first : block.first + len(block.offsets) - 1], np.diff(block.offsets))
                inside &= language >= 0
                keys, n = np.unique(language[inside] * BUCKETS + bucket[inside], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    total = rows.select("declared", "text").mapInArrow(made, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = total["key"].to_numpy(), total["n"].to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    cuts = np.searchsorted(keys, np.arange(1, len(languages)) * BUCKETS)
    return [(k % BUCKETS, x) for k, x in zip(np.split(keys, cuts), np.split(n, cuts))]


def _model(counted: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(log likelihood of a bucket not seen, buckets seen, theirs) by language."""
    totals = [n.sum() + 0.5 * BUCKETS for _, n in counted]
    return [(float(np.log(0.5 / t)), k.astype(np.int32), np.log((n + 0.5) / t)) for (k, n), t in zip(counted, totals)]


def _dense(unseen: float, seen: np.ndarray, fits: np.ndarray) -> np.ndarray:
    out = np.full(BUCKETS, unseen)
    out[seen] = fits
    return out


def _likelihoods(rows: DataFrame, model: list[tuple[float, np.ndarray, np.ndarray]]) -> DataFrame:
    """Each row with its number of trigrams and its mean log likelihood by language, without its text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch["text"]):
                bucket, inside = _trigrams(block)
                n = len(block.offsets) - 1
                many = per_text(inside.astype(np.int64), block.offsets)
                scores = np.stack([per_text(np.where(inside, _dense(*m)[bucket], 0.0), block.offsets) / np.maximum(many, 1) for m in model], axis=1)
                rest = [batch[c].slice(block.first, n) for c in ("row_id", "raw", "declared", "suffix", "host", "domain")]
                lists = pa.ListArray.from_arrays(np.arange(0, scores.size + 1, len(model), dtype=np.int32), scores.ravel())
                yield pa.RecordBatch.from_arrays([*rest, pa.array(many), lists], ["row_id", "raw", "declared", "suffix", "host", "domain", "trigrams", "fit"])

    return rows.mapInArrow(made, "row_id long, raw string, declared string, suffix string, host string, domain string, trigrams long, fit array<double>")


def identify(
    rows: DataFrame,
    least_share: float = 0.0,
    weight: int = 100,
    mass: float = 20.0,
    least: float = 0.5,
) -> DataFrame:
    """(row_id, raw, language, posterior, text_language, declared, accepted) for each row.

    ``rows`` has row_id, text, declared (markup language), suffix (of the address), host and domain; all but row_id and
    text may be null in any row, other columns are ignored. A row is accepted if its text has a trigram with a letter and
    the posterior is ``least`` or more; without such a text it is not, and language is null. Without any declared language
    there is nothing to learn from: language is null, and rows with a letter are accepted. ``raw`` is the MD5 of the text, which with row_id names a row. Equal rows get equal results. An
    empty table gives an empty one.
    """
    spark = rows.sparkSession
    shelf = Shelf(spark, "language")
    text = F.col("text").cast("string")
    plain = lambda c: F.nullif(F.lower(F.trim(F.col(c).cast("string"))), F.lit(""))
    rows = rows.select(
        F.col("row_id").cast("long").alias("row_id"),
        F.md5(F.coalesce(text, F.lit(""))).alias("raw"),
        F.regexp_extract(F.coalesce(plain("declared"), F.lit("")), "^[a-z]{2,3}", 0).alias("declared"),
        *[plain(c).alias(c) for c in ("suffix", "host", "domain")],
        text.alias("text"),
    ).withColumn("declared", F.nullif("declared", F.lit("")))
    declared = rows.where("declared is not null").groupBy("declared").count()
    # Codes of two or three letters, so their number has a bound.
    counts = {r["declared"]: r["count"] for r in declared.collect()}
    languages = sorted(x for x, n in counts.items() if n >= least_share * sum(counts.values()))
    if not languages:
        null = F.lit(None)
        return rows.select("row_id", "raw", null.cast("string").alias("language"), null.cast("double").alias("posterior"), null.cast("string").alias("text_language"), "declared", F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("accepted"))
    # A language without a trigram has nothing to learn from.
    learnt = [(x, c) for x, c in zip(languages, _counted(rows, languages)) if len(c[0])] or [(x, (np.zeros(0, np.int64),) * 2) for x in languages]
    languages = [x for x, _ in learnt]
    own = shelf.put(_likelihoods(rows, _model([c for _, c in learnt])))

    names = F.split(F.lit(",".join(languages)), ",")
    best = F.when(F.col("trigrams") > 0, F.element_at(names, F.array_position("fit", F.array_max("fit")).cast("int")))
    own = own.withColumn("text_language", best)
    known = own.where("text_language is not null")

    def tallied(table: DataFrame, *keys: str) -> DataFrame:
        """(keys, n, rows): rows by language, and all."""
        each = table.groupBy(*keys, "text_language").agg(F.count(F.lit(1)).alias("m"))
        pairs = F.map_from_entries(F.collect_list(F.struct("text_language", F.col("m").cast("double"))))
        each = each.groupBy(*keys).agg(pairs.alias("of"), F.coalesce(F.sum("m"), F.lit(0)).alias("rows"))
        return each.select(*keys, F.transform(names, lambda x: F.coalesce(F.element_at("of", x), F.lit(0.0))).alias("n"), "rows")

    def smoothed(base: Column) -> Column:
        return F.zip_with("n", base, lambda n, b: (n + mass * b) / (F.col("rows") + mass))

    everywhere = tallied(known)
    everywhere = everywhere.select(smoothed(F.array_repeat(F.lit(1.0 / len(languages)), len(languages)))).first()[0]
    domains = tallied(known, "domain").select(F.col("domain").alias("of"), smoothed(F.array(*[F.lit(float(x)) for x in everywhere])).alias("base"))
    hosts = tallied(known, "host", "domain").join(domains, F.col("domain").eqNullSafe(F.col("of")))
    hosts = hosts.select("host", "domain", smoothed(F.col("base")).alias("share"))
    evidence = []
    for column in ("declared", "suffix"):
        # P(value | language): counts of value by language over those of the language, with one row of mass.
        each = known.where(F.col(column).isNotNull())
        by_value = tallied(each, column)
        total = tallied(each).first()["n"]
        total = F.array(*[F.lit(float(x)) for x in total])
        evidence.append((column, by_value.select(F.col(column).alias(f"{column}_value"), F.zip_with("n", total, lambda n, t: F.log((n + 0.1) / (t + 1.0))).alias(f"{column}_fit"))))

    out = own
    for column, table in evidence:
        out = out.join(table, F.col(column) == F.col(f"{column}_value"), "left")
    hosts = shelf.put(hosts.select(F.col("host").alias("h"), F.col("domain").alias("d"), F.transform("share", lambda x: F.log(x)).alias("prior")))
    out = out.join(hosts, F.col("host").eqNullSafe(F.col("h")) & F.col("domain").eqNullSafe(F.col("d")), "left")
    flat = F.array_repeat(F.lit(0.0), len(languages))
    plus = lambda a, b: F.zip_with(a, F.coalesce(b, flat), lambda x, y: x + y)
    score = F.transform("fit", lambda x: x * F.least(F.col("trigrams"), F.lit(weight)))
    for column in ("prior", "declared_fit", "suffix_fit"):
        score = plus(score, F.col(column))
    out = out.withColumn("score", score).withColumn("top", F.array_max("score"))
    out = out.withColumn("posterior", 1.0 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top"))))
    language = F.element_at(names, F.array_position("score", F.col("top")).cast("int"))
    some = F.col("trigrams") > 0
    return out.select(
        "row_id",
        "raw",
        F.when(some, language).alias("language"),
        F.when(some, F.col("posterior")).alias("posterior"),
        "text_language",
        "declared",
        (some & (F.col("posterior") >= least)).alias("accepted"),
    )


def document_languages(docs: DataFrame, **settings: float) -> DataFrame:
    """``identify`` for documents (doc_id, text, lang, source): the declared language is lang, the host is source."""
    null = F.lit(None).cast("string")
    return identify(docs.select(F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("declared"), null.alias("suffix"), F.col("source").alias("host"), null.alias("domain")), **settings)


def page_languages(pages: DataFrame, **settings: float) -> DataFrame:
    """``identify`` for pages (page_id, url, html): text outside tags, the lang attribute, the suffix and host of the url."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    return identify(
        pages.select(
            F.col("page_id").alias("row_id"),
            text.alias("text"),
            F.regexp_extract(html, r"(?is)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1).alias("declared"),
            F.substring_index(host, ".", -1).alias("suffix"),
            host.alias("host"),
            F.substring_index(host, ".", -2).alias("domain"),
        ),
        **settings,
    )
