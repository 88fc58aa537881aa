"""Text functions against hand-derived values and plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lithoflow.functions import python as Y
from lithoflow.functions import text as X


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("r")).first()[0]


@pytest.mark.parametrize("value, want", [("a b c\u001cd", "abcd"), ("", ""), ("A\tB\n", "ab")])
def test_norm0(spark, value, want):
    assert one(spark, X.norm0(F.col("v")), v=value) == want
    assert one(spark, X.norm0(X.norm0(F.col("v"))), v=value) == want


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,)], "v string")
    assert df.select(X.norm0(F.col("v")), X.bare_doi(F.col("v")), X.loop_reason(F.col("v")), X.iso_date(F.col("v"))).first()[:] == (None,) * 4


def test_words_and_shingles(spark):
    text = "Co₃O₄ x² Öl_1 a-b"
    assert one(spark, X.words(F.col("v")), v=text) == re.findall(r"\w+", text.lower())
    assert one(spark, X.shingles(X.words(F.col("v"))), v="a b c") == []
    assert one(spark, X.shingles(X.words(F.col("v"))), v="a b c d a b c d") == ["a b c d", "b c d a", "c d a b", "d a b c"]


def test_identifiers(spark):
    text = "0000-0002-0000-001x no, 0000-0002-0000-001X and 10.1234/ABC.). 10.1234/abc"
    assert one(spark, X.identifiers(F.col("v")), v=text) == ["0000-0002-0000-001X", "10.1234/abc"]


def test_numbers(spark):
    assert one(spark, X.numbers(F.col("v")), v="1,000 and 1.0 and 1 H<sub>2</sub>O") == ["1.000", "1.0", "1", "2"]
    assert one(spark, X.numeric(F.col("v")), v="1,000 and 1.0 and 1") == [1.0]


@pytest.mark.parametrize("value, want", [
    ("5 May 2026", "2026-05-05"), ("05.05.2026", "2026-05-05"), ("5. Mai 2026", "2026-05-05"), ("5.5.2026", "2026-05-05"), ("May 5, 2026", "2026-05-05"), ("Sept. 5 2026", "2026-09-05"), ("3 märz 2024", "2024-03-03"),
    ("2026", "2026"), ("2026-05", "2026-05"), ("2026-13-45", "2026-13-45"), ("2026-01/2026-02", "2026-01/2026-02"), ("30.2.2026", None), ("soon 2026", None), ("5 Foo 2026", None), ("2026\n", "2026"),
])
def test_iso_date(spark, value, want):
    assert one(spark, X.iso_date(F.col("v")), v=value.strip() if value.endswith("\n") else value) == want


def test_date_forms(spark):
    assert one(spark, X.date_forms(F.col("v")), v="2026-05-03") == ["2026-05-03", "03.05.2026", "3.5.2026", "3 May 2026", "May 3, 2026", "3. May 2026", "03/05/2026"]
    assert one(spark, X.date_forms(F.col("v")), v="2026") == ["2026"]


@pytest.mark.parametrize("value, want", [("H<sub>2</sub>O", "H₂O"), ("x<sup>n</sup>", "xn"), ("10<sup>-3</sup> m<sup>2</sup>", "10⁻³ m²"), ("<sub>a1</sub>", "a1"), ("<sub>*</sub>", "*"), ("plain", "plain")])
def test_sub_super(spark, value, want):
    assert one(spark, X.sub_super(F.col("v")), v=value) == want


@pytest.mark.parametrize("value, want", [("Prof. Dr.-Ing. Anna", "Anna"), ("Dr Bert", "Bert"), ("Anna", "Anna"), ("Muster, Dr. rer. nat. Eva", "Muster, Eva")])
def test_strip_titles(spark, value, want):
    assert one(spark, X.strip_titles(F.col("v")), v=value) == want


@pytest.mark.parametrize("role, want", [("Data Curator", "DataCurator"), ("sample preparation", "Producer"), ("PI", "ContactPerson"), ("project leader", "ProjectLeader"), ("team leader", "ContactPerson"), ("driver", None)])
def test_contributor_type(spark, role, want):
    assert one(spark, X.contributor_type(F.col("v")), v=role) == want


def test_loops(spark):
    assert one(spark, X.loop_reason(F.col("v")), v="abcdefgh1" * 60) == "repeats: abcdefgh1"
    assert one(spark, X.loop_reason(F.col("v")), v="x" + " " * 300) == "endless whitespace"
    assert one(spark, X.loop_reason(F.col("v")), v="A plain sentence that does not repeat itself at all.") is None
    assert one(spark, X.loop_reason(F.col("v")), v="") is None


def test_loop_twin(spark):
    from lithoflow.streaming.loops import loop_reason

    texts = ["ab" * 500, "abcdefghij" * 39, "abcdefghij" * 41, "x", "", " " * 299, " " * 301, "0123456789" * 10 + "y", ("z" * 399 + "q") * 5]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert [r[0] for r in df.select(X.loop_reason(F.col("v"))).collect()] == [loop_reason(t) for t in texts]


def test_markdown_table(spark):
    df = spark.createDataFrame([([["a|b", "c\nd"], ["", ""], ["1"]],), ([],), ([["", None]],)], "rows array<array<string>>")
    got = [r[0] for r in df.select(X.markdown_table(F.col("rows"))).collect()]
    assert got == ["| a\\|b | c <br> d |\n| --- | --- |\n| 1 |  |", "", ""]


def test_near_name(spark):
    def brute(text, name, role, window=80):
        t = re.sub(r"\s+", " ", text).lower()
        return any(role.lower() in t[max(0, m.start() - window) : m.end() + window] for m in re.finditer(re.escape(name.lower()), t)) if name and role else False

    cases = [("Anna Example (Producer)", "Example", "producer"), ("Producer" + " x" * 60 + " Example", "Example", "Producer"), ("a.b a.b driver", "a.b", "driver"), ("", "x", "y"), ("x y", "", "y"), ("Example Example " + "z" * 100 + " owner", "Example", "owner")]
    df = spark.createDataFrame(cases, "t string, n string, r string")
    assert [r[0] for r in df.select(X.near_name(F.col("t"), F.col("n"), F.col("r"))).collect()] == [brute(*c) for c in cases]


def test_small_ones(spark):
    assert one(spark, X.publication_year(F.col("v"), 2026), v="x Additional information: to be published in 2027.") == "2027"
    assert one(spark, X.publication_year(F.col("v"), 2026), v="published 2001") == "2026"
    assert one(spark, X.bare_doi(F.col("v")), v="https://dx.doi.org/10.1/x ") == "10.1/x"
    assert one(spark, X.safe_name(F.col("v"), 5), v="a/b:c d-e") == "abc d"
    assert [one(spark, X.roman(F.lit(n))) for n in (4, 9, 1994, 3999)] == ["IV", "IX", "MCMXCIV", "MMMCMXCIX"]
    assert [one(spark, X.letter(F.lit(n))) for n in (1, 26, 27)] == ["a", "z", "a"]
    assert [one(spark, X.format_time(F.lit(float(n)))) for n in (1.5, 61, 3700)] == ["1.50s", "1m 1s", "1h 1m"]


def test_python_functions(spark):
    import difflib

    df = spark.createDataFrame([("ﬁ²", "fi2"), (None, "x"), ("abcabc" * 50, "abc" * 100)], "a string, b string")
    rows = df.select(Y.nfkc(F.col("a")), Y.sequence_ratio(F.col("a"), F.col("b")), F.sha2(F.coalesce("a", F.lit("")), 256)).collect()
    assert rows[0][0] == "fi2" and rows[1][0] is None and rows[1][1] == 0.0
    assert rows[2][1] == difflib.SequenceMatcher(None, "abcabc" * 50, "abc" * 100).ratio()
    assert rows[0][2] == hashlib.sha256("ﬁ²".encode()).hexdigest()
    assert Y.recase("O'BRIEN", "") == "O'Brien" and Y.recase("ANNA-LENA", "anna-lena") == "anna-lena" and Y.recase("Müller", "MULLER") == "Müller" and Y.recase(None, "x") is None
