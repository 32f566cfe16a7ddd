"""Datasets, models and measures of reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Measures by name.
MEASURES = {"Sum": F.sum, "Count": F.count, "Distinct Count": F.countDistinct, "Average": F.avg, "Min": F.min, "Max": F.max}


def read_dataset(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """JSON arrays of records, one to a file, of them the columns asked for; those that they do not have are null. A task reads a file, so large datasets have many, as write_dataset() makes them."""
    df = spark.read.option("multiLine", True).json(path)
    return df if columns is None else df.select(*(F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def write_dataset(df: DataFrame, path: str, most: int = 100_000) -> None:
    """All records as JSON arrays of `most` at the most, each in a file of its own."""
    dealt = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_r"), F.floor(F.monotonically_increasing_id() / most).alias("_file"))
    arrays = dealt.groupBy("_file").agg(F.to_json(F.collect_list("_r")).alias("value")).select("value")
    none = df.sparkSession.sql("select '[]' as value")  # for a dataset without records
    arrays.unionByName(none).write.option("maxRecordsPerFile", 1).text(path)


def fields(df: DataFrame) -> list[dict]:
    """The fields of a model: name, type as reports know it, and the measure that they are summed up by."""
    kinds = {"string": "string", "boolean": "boolean", "date": "date", "timestamp": "date"}
    return [{"field": n, "type": kinds.get(k, "number" if k in ("tinyint", "smallint", "int", "bigint", "float", "double") or k.startswith("decimal") else "other"), "measure": "Sum" if k in ("int", "bigint", "float", "double") else "Count"} for n, k in df.dtypes]


def labelled(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Columns under their labels."""
    return df.toDF(*(labels.get(c, c) for c in df.columns))


def measured(df: DataFrame, axes: Sequence[str], measures: Mapping[str, tuple[str, str]], order: str | None = None) -> DataFrame:
    """A row for each group of axes, or one without axes, with measures: name to (measure, column); by the one named in order, descending."""
    out = df.groupBy(*axes).agg(*(MEASURES[m](c).alias(n) for n, (m, c) in measures.items()))
    return out.orderBy(F.desc(order), *axes) if order else out


def star(fact: DataFrame, dimensions: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """A fact table joined with dimensions: key column to (table, its key); rows without a dimension stay. Sizes decide how they are joined."""
    out = fact
    for i, (key, (table, own)) in enumerate(dimensions.items()):
        known = table.withColumnRenamed(own, f"_k{i}")
        out = out.join(known, F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
    return out


def series(df: DataFrame, category: str, legend: str, values: Sequence[str], measure: str) -> DataFrame:
    """A row for each category with the sum of measure for each value of legend; what is no number counts 0."""
    number = F.coalesce(F.col(measure).cast("string").try_cast("double"), F.lit(0.0))
    return df.withColumn("_m", number).groupBy(category).pivot(legend, list(values)).agg(F.sum("_m"))


def narrow_histogram(df: DataFrame, value: str, bins: int = 10, keep: int | None = None) -> DataFrame:
    """(bin, low, high, n) of equal bins over the range; of these the `keep` fullest, the first of equals. Nulls are left out."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    b = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / width)))
    out = rows.join(F.broadcast(b)).groupBy(at.cast("long").alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))  # one row
    out = out.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")
    return out.orderBy(F.desc("n"), "bin").limit(keep) if keep else out


def groups(tables: DataFrame, group: str, name: str) -> DataFrame:
    """(group, names): the names of each group, in order."""
    return tables.groupBy(group).agg(F.sort_array(F.collect_list(name)).alias("names"))
