"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridweave.llm import language, mixing, quality, secrets, toolcalls, units, urls
from gridweave.llm.align import align
from gridweave.llm.exact import exact_duplicates
from gridweave.llm.leaks import leaks
from gridweave.llm.near import near_duplicates
from gridweave.llm.registry import query
from gridweave.llm.suffixes import without_repeats
from gridweave.llm.whiten import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op5_near_duplicates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


@query(
    "op10_exact_duplicates",
    """WITH docs AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256 FROM docs WINDOW w AS (PARTITION BY text_sha256)""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).drop("raw")


@query("op1_latent_leaks")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("raw")


@query("op2_credential_links", secrets.oracle())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


@query("op4_source_mix", mixing.oracle())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op6_path_templates", urls.oracle())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"))


@query("op9_language_evidence")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.document_languages(table(spark, sf_dir, "documents"))
    return out.drop("raw").withColumnRenamed("row_id", "doc_id")


@query("llm_page_languages")
def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.page_languages(table(spark, sf_dir, "pages"))
    return out.drop("raw").withColumnRenamed("row_id", "page_id")


@query("op8_kernel_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_repeated_units")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.repeated_units(table(spark, sf_dir, "documents"))


@query("op7_tool_calls", toolcalls.oracle())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.tool_lines(table(spark, sf_dir, "conversations"))


@query("op11_whitened_embeddings")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return align(table(spark, sf_dir, "documents")).withColumn("groups_sha256", groups).drop("groups")


@query("op13_repeated_substrings")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
