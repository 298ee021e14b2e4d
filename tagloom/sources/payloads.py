"""Captured payloads: what a crawl has stored of its answers, as a table; nothing here asks the network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "nick string, kind string, status int, reason string, body string"
OK = 200


def payloads(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """``nick, kind, status, body`` of a Parquet table of captured answers, of one kind if it is named."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    return answered(rows if kind is None else rows.where(F.col("kind") == kind))


def answered(rows: DataFrame) -> DataFrame:
    """The body of an answer, or its reason where the status is another than 200."""
    body = F.when(F.col("status") == OK, F.col("body")).otherwise(F.col("reason"))
    return rows.select("nick", "kind", "status", body.alias("body"))


def request_url(base: str, **arguments: Column) -> Column:
    """The address of a request with its arguments, each encoded; one that is null is left out."""
    pairs = [F.concat(F.lit(f"{name}="), F.url_encode(value)) for name, value in arguments.items()]
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *pairs))
