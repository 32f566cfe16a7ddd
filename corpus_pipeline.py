"""From raw documents to a mixed training corpus: each stage works on what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from larkspur.llm import decontaminate, language_id, line_dedup, mixing, ngram_join, tokens
from larkspur.plans.session import drop_written, tables_written, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language is told with less than even odds, go.

    So null and empty texts go; a null id or lang is no reason to. Texts of any length are read whole, equal rows fare alike.
    """
    return language_id.in_known_language(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that has none left goes. Null texts and those without a word stay as they are, rows that share id and text fare alike."""
    renamed, back = tokens.set_aside(docs, line_dedup.ADDED)
    out = line_dedup.dedup_lines(renamed).where("n_dropped = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents one row stays, of the smallest id, of none only if no row has one.

    Rows are told apart by a hash of id and text; of rows that share both one stays. Documents without words stay.
    """
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    found = written(ngram_join.similar(keyed, width=5, percent=80, carry=["_row"]).where("root is not null"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first"))
    gone = found.join(first, "root").where("_row <> first._row").select("_row").distinct()
    again = F.row_number().over(Window.partitionBy("_row").orderBy(*(c for c in docs.columns if c not in ("doc_id", "text"))))
    rest = keyed.join(gone, "_row", "left_anti").withColumn("_again", again)
    return rest.where(F.expr(r"_again = 1 or not coalesce(text rlike '[^\\x20\\x09-\\x0D]', false)")).select(*docs.columns)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark go, and documents that are such for more than half. Null and empty texts stay, a null id is an id, texts of any length are read whole."""
    out = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each copy a row. A null source is a source, a null or empty text has no words and comes once at its place."""
    return mixing.mix(docs)


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", contamination), ("mixing", mixture)]
#: Language models, hashes and similarity classes can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage wrote on its way goes when its result is written."""
    docs, earlier = spark.read.parquet(f"{sf_dir}/documents.parquet"), tables_written()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
            drop_written(earlier, keep=[docs])
    return docs
