"""Registered queries of the subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoflow.llm import canonical, characters, leakage, names, packing, residue, sentences
from lithoflow.session import materialise, read, spread

Query = Callable[[SparkSession, str], DataFrame]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sentences.split(spread(docs), "doc_id", "text", sentences.fit(docs, "doc_id", "text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [("titles", read(spark, sf_dir, "titles"), "title_id", "title"), ("descriptions", read(spark, sf_dir, "descriptions"), "description_id", "description")]
    return residue.find(sources).select("source_table", "row_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = read(spark, sf_dir, "affiliations").select(F.col("affiliation_id").alias("row_id"), F.col("name").alias("value"))
    roles = read(spark, sf_dir, "contributors").select(F.col("agent_id").alias("row_id"), F.col("contributortype").alias("value"))
    a = canonical.find(typed, read(spark, sf_dir, "organisations"), "org_id").select(F.lit("affiliation").alias("field"), "row_id", "ref_id")
    b = canonical.find(roles, read(spark, sf_dir, "contributor_types"), "type_id").select(F.lit("contributor").alias("field"), "row_id", "ref_id")
    return a.unionByName(b)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [("titles", read(spark, sf_dir, "titles"), "title_id", "title"), ("subjects", read(spark, sf_dir, "subjects"), "subject_id", "subject"), ("creators", read(spark, sf_dir, "creators"), "agent_id", "familyname")]
    return characters.find(sources).select("source_table", "row_id")


def p5_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, name, cluster) of every agent with a name."""
    parts = [read(spark, sf_dir, t).select(F.col("agent_id").alias("row_id"), "name", F.transform("nameidentifiers", lambda x: x["nameidentifier"]).alias("identifiers")) for t in ("creators", "contributors")]
    return names.link(parts[0].unionByName(parts[1]))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.pairs(p5_links(spark, sf_dir))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(packing.curve(spread(read(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text"))


def p6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_placed(spark, sf_dir), read(spark, sf_dir, "capacities"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, capacities = _placed(spark, sf_dir), read(spark, sf_dir, "capacities")
    return packing.report(packing.pack(placed, capacities), capacities, placed)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return leakage.find(spread(docs), read(spark, sf_dir, "eval_items"))


def all_queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p5_links": p5_links, "p6_packing": p6_packing, "p6_report": p6_report, "p7_found": p7_found, "p8_found": p8_found}


def all_sql() -> dict[str, str]:
    return {}
