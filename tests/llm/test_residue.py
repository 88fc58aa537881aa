import random

import pytest
from pyspark.sql import functions as F

from lithoflow.llm import residue

PROSE = ["The rod was cast at 459 °C for 31 h in nitrogen.", "Sample no. 3 is damp; no. 7 is coarse and was ground again.", "Cut by hand, the foil shows a dense rim and a porous core.", "A placeholder layer of titania was removed later.", "Not found in nature: synthetic quartz.", "The [001]-oriented disc was etched in steam.", "Filler-free olivine fibre mat, milled at 95 °C.", "Drying in the tube furnace went on until 7 p.m."]
CASES = ["[Insert title here]", "{{ sample.description }}", "Lorem ipsum dolor sit amet, consectetur adipiscing elit", "HTTP 404 - Not Found", "The page could not be found. Please check the address.", "Please enable JavaScript to view this page.", "Die Sitzung ist abgelaufen, bitte erneut anmelden.", "asdf asdf asdf", "__SAMPLE_CODE__", "Your session has expired. Please sign in again."]


def corpus():
    rng = random.Random(1)
    pick = lambda *xs: rng.choice(xs)
    name = lambda: "".join(rng.choice("BDFGKLMNPRST") if k == 0 else rng.choice("bdfgklmnprst") + rng.choice("aeiou") for k in range(4))
    return [" ".join(rng.sample(PROSE, 2)) + f" {name()} weighed {rng.randint(1, 99)} g of {pick('gypsum', 'titania', 'basalt', 'olivine')} in the {pick('ball mill', 'jaw crusher', 'spin coater')}." for _ in range(1500)]


@pytest.fixture(scope="module")
def models(spark):
    texts = spark.createDataFrame([(residue.fold(t),) for t in corpus() + PROSE + CASES], "t string")
    return residue.fit(texts.repartition(3))


def excluded(mark):
    ratio, coverage, words = mark
    return words >= residue.WORD_COVERAGE or ratio >= residue.LEAST_RATIO and coverage >= residue.LEAST_COVERAGE


def test_separation(models):
    found = residue.windows([residue.fold(t) for t in CASES + PROSE], models)
    assert all(map(excluded, found[: len(CASES)])) and not any(map(excluded, found[len(CASES) :]))


def test_windows_inside_long_text(models):
    text = " ".join(PROSE * 400)
    clean, mixed = residue.windows([residue.fold(text), residue.fold(text + " {{ sample.title }} " + text)], models)
    assert not excluded(clean) and excluded(mixed) and 0 < mixed[1] < 0.01


def test_letters_that_no_model_knows_are_no_residue(models):
    assert not any(map(excluded, residue.windows([residue.fold(t) for t in ("ジルコニアの薄膜", "花崗岩の試料", "Гранит, стержень", "ผงกราไฟต์")], models)))


def test_words_around_a_window_count(models):
    part, whole = residue.windows([residue.fold("The {{x-oriented}}-grown-in-steam-and-cast-in-nitrogen rod was cast"), residue.fold("The rod {{title}} was cast")], models)
    assert not excluded(part) and excluded(whole)


def test_table(spark):
    prose = corpus() + PROSE
    rows = [(i, t) for i, t in enumerate(prose + CASES)] + [(10_000, None), (10_001, ""), (10_002, " \n")]
    df = spark.createDataFrame(rows, "title_id bigint, title string").withColumn("text", F.lit("clash")).withColumn("ratio", F.lit(1))
    got = {r["row_id"] for r in residue.find([("titles", df.unionAll(df), "title_id", "title")]).collect()}
    want = set(range(len(prose), len(prose) + len(CASES)))
    assert want <= got and len(got - want) <= 0.01 * len(prose)
    assert residue.find([("titles", df.limit(0), "title_id", "title")]).count() == 0


def test_sample_takes_each_text_once(spark):
    rows = [("The same  text.",)] * 500 + [("the SAME text.",)] * 500 + [(f"text of sample {chr(97 + k)}",) for k in range(20)] + [("long " * 2000,), (None,), (" ",)]
    got = [r[0] for r in residue.sample(spark.createDataFrame(rows, "t string"), "t", 22).collect()]
    assert len(got) == len(set(got)) == 22 and got.count("the same text.") == 1
    assert max(map(len, got)) == residue.SAMPLE_CHARS


def test_models_are_fitted_on_all_texts_whole(spark, monkeypatch):
    texts = [f"Sample {chr(97 + k % 26)}{chr(97 + k // 26)} is coarse." for k in range(300)] + ["The same  text.", "the SAME text."] * 3 + ["A long text. " * 1000]
    seen, inner = [], residue.fit
    monkeypatch.setattr(residue, "fit", lambda t: (seen.extend(r["t"] for r in t.collect()), inner(t))[1])
    df = spark.createDataFrame(list(enumerate(texts)) + [(9000, None), (9001, " ")], "title_id bigint, title string")
    residue.find([("titles", df, "title_id", "title")]).count()
    assert sorted(seen) == sorted({residue.fold(t) for t in texts}) and max(map(len, seen)) > 10_000
