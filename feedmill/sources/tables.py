"""Table scans and sinks.  Operators return DataFrames; writing is always a separate call, so a dry
run [S17] is simply not calling the sink."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedmill import schemas
from feedmill.operators.joins import without_feature


def scan(spark: SparkSession, table: str, path: str) -> DataFrame:
    """Scan one table from Parquet with its explicit schema [S9]."""
    return spark.read.schema(schemas.TABLES[table]).parquet(path)


def scan_jdbc(
    spark: SparkSession, table: str, url: str, key: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """Scan one table over JDBC, split by a numeric key so that many tasks read at once [S9]."""
    raw = spark.read.jdbc(
        url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=partitions, properties=options
    )
    return schemas.as_table(raw, table)


def read_channels(spark: SparkSession, path: str) -> DataFrame:
    """(name, channel_id, description) of the channel configuration; a missing file is empty and
    entries without an id are skipped [S8]."""
    layout = "channels array<struct<name: string, channel_id: string, description: string>>"
    try:
        config = spark.read.schema(layout).option("multiLine", True).json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        config = spark.createDataFrame([], layout)
    entries = config.select(F.explode("channels").alias("c")).select("c.name", "c.channel_id", "c.description")
    return entries.filter(F.coalesce("channel_id", F.lit("")) != "")


def append_articles(articles: DataFrame, path: str) -> None:
    """Append new articles partitioned by scrape date [S10].

    Tasks write the dates they hold, without a shuffle by date, so a day with most of the rows is
    written by all tasks that read it.
    """
    dated = articles.withColumn("scraped_date", F.to_date("scraped_at"))
    dated.write.mode("append").partitionBy("scraped_date").parquet(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """The partitioned article table, empty before the first run; a filter on ``scraped_date``
    prunes folders."""
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.ARTICLES.fields)
    layout = f"{columns}, scraped_date date"
    try:
        return spark.read.schema(layout).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], layout)


def append_features(features: DataFrame, existing: DataFrame, path: str, model: str | None = None) -> None:
    """Append feature rows for articles that lack the feature [S11, D6]."""
    keyed = features.withColumnRenamed("article_id", "id")
    fresh = without_feature(keyed, existing, model).withColumnRenamed("id", "article_id")
    fresh.write.mode("append").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append to an event, dead letter or run log [S12]; current state is derived from it."""
    rows.write.mode("append").parquet(path)


def as_json(*columns: str) -> Column:
    """One JSON text per record, NULL fields written out [S13]."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def export_json(rows: DataFrame, path: str) -> None:
    """Write records as JSON lines [S13]."""
    rows.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
