import unicodedata

from pyspark.sql import functions as F

from lithoflow.llm import characters

PLAIN = ["Röntgenbeugung", "γ-Al₂O₃ support", "10 μm fibre", "Β-phase alloy", "5 Å sieve", "тонкая плёнка", "κεραμικά υλικά", "薄膜（試料）", "ガラス", "a–b ‘c’ “d”", "x² and 450 °C", "नम्क"]
ODD = {"Röntgen": "Röntgen", "ｇｌａｓｓ": "glass", "thin film": "thin film", "cera​mics": "ceramics", "ag­gregate": "aggregate", "pellеt": "pellet", "ΜnO₂ rod": "MnO₂ rod", "stiﬀness": "stiffness", "ﾅﾉ": "ナノ", "10 µm": "10 μm", "5 Å": "5 Å", "кeрамика": "керамика", "micro‑chip": "micro-chip", "ｶﾞ": "ガ", "q̣̇": "q̣̇", "q̣̇": "q̣̇"}


def plain(spark, values):
    df = spark.createDataFrame([(v, 1) for v in values], "value string, n bigint")
    return {r["value"]: r["plain"] for r in characters.plain_forms(df).collect()}


def test_forms(spark):
    got = plain(spark, PLAIN + list(ODD))
    assert {v: got.get(v, v) for v in PLAIN} == {v: v for v in PLAIN}
    assert {v: got[v] for v in ODD} == ODD
    again = plain(spark, set(got.values()))
    assert all(again.get(v, v) == v for v in got.values())


def test_canonical_equivalents_agree(spark):
    texts = ["Glühverlust é", "Ṩample ṩ", "한국 시료"]
    got = plain(spark, [unicodedata.normalize("NFD", t) for t in texts])
    assert set(got.values()) == set(texts)


def test_required_joiners(spark):
    good, bad = "نیم‌رسانا", "س‌رامیک"
    df = spark.createDataFrame([(good, 9), (good + "⁠", 1), (bad, 1), ("سرامیک", 8)], "value string, n bigint")
    got = {r["value"]: r["plain"] for r in characters.plain_forms(df).collect()}
    assert got[good] == good and got[good + "⁠"] == good and got[bad] == "سرامیک"


def test_table(spark):
    rows = [(1, "ceramics"), (2, "cerаmics"), (2, "cerаmics"), (3, None), (4, ""), (5, " "), (6, "x" * 3000 + "ﬁ"), (7, "cerаmics")]
    df = spark.createDataFrame(rows, "subject_id bigint, subject string").withColumn("value", F.lit("clash")).withColumn("n", F.lit(1))
    got = characters.find([("subjects", df, "subject_id", "subject")]).collect()
    assert sorted(r["row_id"] for r in got) == [2, 6, 7] and {r["plain"] for r in got if r["row_id"] != 6} == {"ceramics"}
    assert characters.find([("subjects", df.limit(0), "subject_id", "subject")]).count() == 0
