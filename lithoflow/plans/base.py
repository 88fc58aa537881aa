"""What the modules of registered queries share: the registry and the tables that all of them begin with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoflow.session import read

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def last_deliveries(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """(record_id, doc_id, sample_idx[, more columns]): each record's last delivery."""
    kept = ("doc_id", "sample_idx", *more)
    r = read(spark, sf, "records")
    return r.groupBy("record_id").agg(F.max(F.struct("received_at", "delivery_id", *kept)).alias("m")).select("record_id", *[f"m.{c}" for c in kept])


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
