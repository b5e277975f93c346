"""The training-data pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

A row is named by doc_id and the MD5 of its text, so null and repeated ids do no harm. A stage that keeps rows returns the
columns of its input, whatever else they are. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridweave.llm.exact import exact_duplicates
from gridweave.llm.language import document_languages
from gridweave.llm.leaks import leaks
from gridweave.llm.mixing import mix
from gridweave.llm.near import near_duplicates
from gridweave.llm.shelf import Shelf


def _raw() -> Column:
    return F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _same(docs: DataFrame, names: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(names["of"]) & (_raw() == names["raw"])


def _name(raw: Column | str) -> Column:
    """The MD5 of doc_id, text and source."""
    part = lambda c, kind: F.coalesce(F.concat(F.lit("="), F.col(c).cast(kind).cast("string")), F.lit(""))
    return F.md5(F.concat_ws("/", part("doc_id", "long"), raw, part("source", "string")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is accepted: a text with a letter, and one language likelier than all others together."""
    verdicts = document_languages(docs).where("not accepted").select(F.col("row_id").alias("of"), "raw").distinct()
    return docs.join(verdicts.hint("shuffle_hash"), _same(docs, verdicts), "left_anti")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id; of rows that repeat it, one."""
    kept = exact_duplicates(docs).where("kept").select(F.col("doc_id").alias("of"), "raw")
    found = docs.join(kept.hint("shuffle_hash"), _same(docs, kept), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", _raw()).orderBy("doc_id"))
    return found.withColumn("nth__", nth).where("nth__ = 1").drop("nth__")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at similarity 0.8 on five-word shingles: the smallest doc_id. Null ids stay."""
    gone = near_duplicates(docs, shingle=5, percent=80).where("not kept").select(F.col("doc_id").alias("of")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["of"], "left_anti")


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark."""
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(F.col("doc_id").alias("of"), "raw").distinct()
    return docs.join(found.hint("shuffle_hash"), _same(docs, found), "left_anti")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each drawn row once for each time it is taken, with its source's target and its shard and place in it.

    A column of the mix whose name ``docs`` has is named with ``mix_`` before it.
    """
    # Rows with the same doc_id, text and source are numbered on both sides, so each meets one draw.
    drawn = mix(docs, by_text=True).withColumn("name", _name("raw"))
    nth = Window.partitionBy("name")
    drawn = drawn.withColumn("nth", F.row_number().over(nth.orderBy(F.desc("taken"), "shard", "again_shard"))).where("taken > 0")
    shards = F.explode(F.filter(F.array("shard", "again_shard"), lambda x: x.isNotNull())).alias("shard")
    rows = Shelf(spark, "mixed").put(drawn.select("name", "nth", "size", "source_size", "target", "taken", "place", shards))
    named = docs.select(F.struct(*docs.columns).alias("doc"), _name(_raw()).alias("name"), "doc_id")
    named = named.withColumn("nth", F.row_number().over(nth.orderBy("doc_id"))).drop("doc_id")
    taken = {c.lower() for c in docs.columns}
    out = [F.col("doc")[c].alias(c) for c in docs.columns]
    for c in ("size", "source_size", "target", "taken", "place", "shard"):
        own = c
        while own in taken:
            own = f"mix_{own}"
        out.append(F.col(c).alias(own))
    return named.join(rows, ["name", "nth"]).select(*out)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("exact_duplicates", exact_stage),
    ("near_duplicates", near_stage),
    ("decontamination", leak_stage),
    ("source_mix", mix_stage),
]

#: Near duplicates, language models and the latent search have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    shelf = Shelf(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = shelf.put(stage(spark, docs, sf_dir))
        if last is not None:
            shelf.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
