import json

from pyspark.sql import functions as F

from lithoflow.plans import queries


def test_nested_records_hold_agents_identifiers_and_affiliations(spark, sf):
    nested = queries.nested(spark, sf).select("record").collect()
    agents = [a for r in nested for a in (*r["record"]["creators"], *r["record"]["contributors"])]
    t = lambda name: spark.read.parquet(f"{sf}/{name}.parquet").distinct()
    known = t("records").select("record_id").distinct()
    flat = t("creators").unionByName(t("contributors").drop("contributortype"), allowMissingColumns=True).join(known, "record_id", "left_semi")
    assert len(agents) == flat.count()
    assert sum(len(a["nameIdentifiers"]) for a in agents) == flat.select(F.explode("nameidentifiers")).count() > 0
    assert sum(len(a["affiliation"]) for a in agents) == t("affiliations").join(flat, "agent_id", "left_semi").count() > 0


def test_records_are_enriched(spark, sf):
    before = {r["record_id"]: r["record"] for r in queries.nested(spark, sf).select("record_id", F.to_json("record").alias("record")).collect()}
    rows = queries.enriched_records(spark, sf).collect()
    assert len(rows) == len(before)
    after = {r["sample_idx"]: json.loads(r["record"]) for r in rows}
    changed = [k for k in before if json.loads(before[k]) != after[k]]
    rors = [p for r in after.values() for a in (*r["creators"], *r["contributors"]) for p in a["affiliation"] if p.get("affiliationIdentifierScheme") == "ROR"]
    assert changed and rors


def test_labels_beyond_3999(spark, tmp_path):
    spark.createDataFrame([(0,), (3999,), (4000,), (10_001,)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["s_suppkey"]: (r["roman"], r["letter"]) for r in queries.list_labels(spark, str(tmp_path)).collect()}
    assert got == {3999: ("MMMCMXCIX", "u"), 4000: ("MMMM", "v"), 10_001: ("MMMMMMMMMMI", "q")}
