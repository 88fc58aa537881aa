"""The registered queries of the subpackage on whole test tables."""

import pytest
from pyspark.sql import functions as F

from lithoflow.llm import queries

KEYS = {"p1_found": ("source_table", "row_id"), "p2_found": ("field", "row_id"), "p4_found": ("source_table", "row_id"), "p5_found": ("first_id", "second_id"), "p5_links": ("row_id",), "p6_packing": ("capacity_id", "doc_id", "piece_no"), "p6_report": ("capacity_id",), "p7_found": ("doc_id", "item_id"), "p8_found": ("doc_id", "end_pos")}
COLUMNS = {"p1_found": KEYS["p1_found"], "p2_found": ("field", "row_id", "ref_id"), "p4_found": KEYS["p4_found"], "p5_found": KEYS["p5_found"], "p7_found": KEYS["p7_found"], "p8_found": KEYS["p8_found"]}


def test_all_are_covered():
    assert set(KEYS) == set(queries.all_queries())


@pytest.mark.parametrize("name", sorted(KEYS))
def test_keys_come_once(spark, sf, name):
    df = queries.all_queries()[name](spark, sf)
    if name in COLUMNS:
        assert tuple(df.columns) == COLUMNS[name]
    n, distinct, nulls = df.select(F.count("*"), F.count_distinct(*KEYS[name]), F.count_if(F.greatest(*[F.col(k).isNull().cast("int") for k in (*KEYS[name], KEYS[name][0])]) == 1)).first()
    assert n == distinct > 0 and nulls == 0


def test_every_document_is_cut_to_its_end(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where(r"text rlike '(?U)[^\\s]'").select("doc_id", F.length(F.regexp_replace("text", r"(?U)\s+$", "")).alias("n"))
    last = queries.p8_found(spark, sf).groupBy("doc_id").agg(F.max("end_pos").alias("last"))
    assert docs.join(last, "doc_id", "left").where("not (last <=> n)").count() == 0


def test_every_value_that_is_no_label_is_mapped(spark, sf):
    a, o = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("affiliations", "organisations"))
    want = a.where(r"name rlike '(?U)[^\\s]'").join(o.select(F.col("label").alias("name")), "name", "left_anti").select("affiliation_id").distinct().count()
    found = queries.p2_found(spark, sf).where("field = 'affiliation'")
    assert found.count() == want and found.where("ref_id = 0").count() < want / 2
