"""Sources and sinks over Spark's own readers and writers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Columns of the address base, read as text but for the coordinates. Fixed values.
ADDRESS_SCHEMA = "id string, nom_voie string, id_fantoir string, numero string, rep string, code_insee string, code_post string, alias string, nom_ld string, nom_afnor string, libelle_acheminement string, x double, y double, lon double, lat double, nom_commune string"


def read_addresses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ADDRESS_SCHEMA).option("sep", ";").option("header", True).csv(path)


def normal_addresses(raw: DataFrame) -> DataFrame:
    """number, street, postcode, inseeCode, locality_name, lon, lat; rows without a single postcode go."""
    street = F.coalesce(F.nullif("nom_ld", F.lit("")), F.nullif("nom_voie", F.lit("")), F.lit(""))
    out = raw.select(F.concat(F.coalesce("numero", F.lit("")), F.coalesce("rep", F.lit(""))).alias("number"), street.alias("street"), F.col("code_post").alias("postcode"), F.col("code_insee").alias("inseeCode"), F.col("nom_commune").alias("locality_name"), "lon", "lat")
    return out.where("postcode is null or postcode <> 'PLURI'")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(token, vector) of text lines `token v1 v2 ...`; lines of two parts or fewer go."""
    parts = F.split(F.col("value"), " ")
    return spark.read.text(path).where(F.size(parts) > 2).select(F.element_at(parts, 1).alias("token"), F.slice(parts, 2, F.size(parts)).cast("array<double>").alias("vector"))


def read_recursive_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all files below path; files whose names begin with _ are left out, as Spark does."""
    return spark.read.option("recursiveFileLookup", True).text(path)


def exclude_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").rlike(pattern))


def newest_file(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """(path, modificationTime) of the newest file whose name matches."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime")
    return files.where(F.regexp_extract("path", "([^/]*)$", 1).rlike(pattern)).agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"), F.max("modificationTime").alias("modificationTime"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of footprints (path and any stamps) that are not the same in before."""
    same = [now[c].eqNullSafe(before[c]) for c in now.columns]
    return now.join(before, same, "left_anti")


def escape_columns(df: DataFrame) -> DataFrame:
    """Characters that Parquet refuses in column names become >>code<<."""
    return df.toDF(*("".join(f">>{ord(c)}<<" if c in " ,;{}()\n\t=" else c for c in name) for name in df.columns))


def unescape_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*(re.sub(r">>(\d+)<<", lambda m: chr(int(m[1])), name) for name in df.columns))


def checkpoint(df: DataFrame, path: str, partition_by: list[str] | None = None, reuse: bool = False) -> DataFrame:
    """df written to path and read back; with reuse what is there is read if it can be."""
    if reuse and (old := restore(df.sparkSession, path)) is not None:
        return old
    writer = escape_columns(df).write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return unescape_columns(df.sparkSession.read.parquet(path))


def restore(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return unescape_columns(spark.read.parquet(path))
    except AnalysisException:
        return None


def links(pages: DataFrame, follow: str = ".*") -> DataFrame:
    """(page_id, link) of href values in html that match follow."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), 1)
    return pages.select("page_id", F.explode(F.array_distinct(found)).alias("link")).where(F.col("link").rlike(follow))


def crawl(pages: DataFrame, start: str, rounds: int = 3, follow: str = ".*") -> DataFrame:
    """(url, depth) reached from start over links between stored pages, breadth first."""
    from larkspur.plans.session import written

    edges = written(pages.select("url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), 1))).alias("to")).where(F.col("to").rlike(follow)))
    seen = pages.where(F.col("url") == start).select("url", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in range(1, rounds + 1):
        frontier = written(frontier.join(edges, "url").select(F.col("to").alias("url"), F.lit(depth).alias("depth")).distinct().join(seen, "url", "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


def write_hourly(df: DataFrame, ts: str, path: str) -> None:
    """Text lines in folders by hour, gzip, appended. df has ts and one text column."""
    text = next(c for c in df.columns if c != ts)
    df.select(F.date_format(ts, "yyyy-MM-dd-HH").alias("hour"), F.col(text).alias("value")).write.partitionBy("hour").mode("append").option("compression", "gzip").text(path)


def first_column(spark: SparkSession, path: str, name: str, sep: str = ";") -> DataFrame:
    """The first column of a CSV file, such as keywords to track."""
    rows = spark.read.option("sep", sep).csv(path)
    return rows.select(F.col(rows.columns[0]).alias(name))


def register_functions(spark: SparkSession) -> None:
    """Functions for SQL text: simplify_text(x), grammar_tags(code, auxiliary), by Arrow batches, and the table function numbered_words(text), which gives (i, w)."""
    from pyspark.sql.functions import pandas_udf, udtf

    from larkspur.functions.text import ACCENTS
    from larkspur.operators.lexicon import TAGS

    fold = str.maketrans(*ACCENTS) | str.maketrans("-'", "  ")

    @pandas_udf("string")
    def simplify_text(x: pd.Series) -> pd.Series:
        return x.map(lambda t: re.sub("[ld](?=')", " ", t.lower()).translate(fold), na_action="ignore")

    @pandas_udf("array<int>")
    def grammar_tags(code: pd.Series, auxiliary: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else [k for k, (*_, p) in TAGS.items() if (a if p is None else re.search(p, c))] for c, a in zip(code, auxiliary, strict=True)], dtype=object)

    @udtf(returnType="i int, w string")
    class NumberedWords:
        def eval(self, text: str):  # noqa: ANN202
            yield from enumerate((text or "").split())

    spark.udf.register("simplify_text", simplify_text)
    spark.udf.register("grammar_tags", grammar_tags)
    spark.udtf.register("numbered_words", NumberedWords)
