"""Measurement inputs: the request sample log and labelled metric series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

REQUEST_METRIC = "http_req_duration"
CLICK_REQUEST = "GET /click/{ad_id}"


def read_sample_log(spark: SparkSession, path: str) -> DataFrame:
    """A sample log in CSV (plain or gzip) with a header; every column is text."""
    return spark.read.option("header", True).csv(path)


def request_samples(
    log: DataFrame, metric: str = REQUEST_METRIC, name: str = CLICK_REQUEST
) -> DataFrame:
    """The samples of one request, with whole seconds and a numeric latency."""
    return log.where((F.col("metric_name") == metric) & (F.col("name") == name)).withColumns(
        {
            "timestamp": F.col("timestamp").cast("double").cast("long"),
            "metric_value": F.col("metric_value").cast("double"),
        }
    )


def select_series(series: DataFrame, metric: str, **labels: str) -> DataFrame:
    """Series of one metric whose labels equal those given."""
    found = series.where(F.col("metric") == metric)
    for label, wanted in labels.items():
        found = found.where(F.col("labels")[label] == wanted)
    return found
