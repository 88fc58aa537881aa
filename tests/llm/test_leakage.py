import random

import numpy as np
from pyspark.sql import functions as F

from lithoflow.llm import leakage

WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "st", "lo")]


def test_fold():
    assert leakage.fold("Der  Fünf-Stab,\nläuft­; ｗｅｉｔ") == leakage.fold("der fünfstab läuft weit") == ["der", "funfstab", "lauft", "weit"]


def brute(a, b):
    """Some stretch of b of at least 12 words stands in a with at most an eighth of edits (Sellers)."""
    for start in range(len(b) - leakage.WINDOW + 1):
        costs = [0] * (len(a) + 1)
        for n, w in enumerate(b[start:], 1):
            row = [n]
            for j, v in enumerate(a, 1):
                row.append(min(costs[j] + 1, row[j - 1] + 1, costs[j - 1] + (v != w)))
            costs = row
            if n >= leakage.WINDOW and min(costs) * leakage.EIGHTH <= n:
                return True
    return False


def test_alignment_is_exact():
    rng = random.Random(5)
    pairs = []
    for k in range(150):
        b = [rng.randint(1, 30) for _ in range(rng.randint(5, 45))]
        a = b[rng.randint(0, 5) :][: rng.randint(9, 40)]
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(a))
            a[at : at + rng.randint(0, 1)] = rng.choice([[], [0], [99]])
        pairs.append((np.array([rng.randint(1, 30) for _ in range(5)] + a + [0, 0], np.int32), np.array(b, np.int32)))
    want = [brute(a.tolist(), b.tolist()) for a, b in pairs]
    assert leakage.align(pairs).tolist() == want and 20 < sum(want) < 130


def changed(rng, words):
    out = []
    for k, w in enumerate(words):
        if k % 8 == 5:
            how = rng.randint(0, 2)
            out += [] if how == 0 else [w, "zzz"] if how == 1 else ["qqq"]
        else:
            out.append(w)
    return out


def test_recall_against_planted_passages():
    rng = random.Random(9)
    items = [(i, rng.choices(WORDS, k=60)) for i in range(40)]
    index = leakage.Index(items)
    texts, want = [], []
    for _ in range(400):
        i, w = rng.choice(items)
        n = rng.randint(16, 40)
        at = rng.randint(0, 60 - n)
        texts.append(" ".join(rng.choices(WORDS, k=30) + changed(rng, w[at : at + n]) + rng.choices(WORDS, k=30)))
        want.append(i)
    got = leakage.leaks(texts, index)
    assert sum(i in g for i, g in zip(want, got)) >= 0.95 * len(want)
    short = [" ".join(rng.choices(WORDS, k=30) + w[5:13] + rng.choices(WORDS, k=30)) for _, w in items]
    assert not any(leakage.leaks(short, index))


def test_recall_by_length():
    """By the definition: passages of 12 to 24 words, one word in eight changed, missing or added anywhere."""
    rng = random.Random(11)
    items = [(i, rng.choices(WORDS, k=60)) for i in range(60)]
    index = leakage.Index(items)
    for n, edits in ((12, 0), (12, 1), (13, 1), (14, 1), (16, 2), (17, 2), (20, 2), (24, 3)):
        texts, want = [], []
        for _ in range(300):
            i, w = rng.choice(items)
            at = rng.randint(0, 60 - n)
            passage = [[x] for x in w[at : at + n]]
            for k in rng.sample(range(n), edits):
                passage[k] = rng.choice([["qqq"], [], [passage[k][0], "zzz"]])
            texts.append(" ".join(rng.choices(WORDS, k=30) + [x for p in passage for x in p] + rng.choices(WORDS, k=30)))
            want.append(i)
        got = leakage.leaks(texts, index)
        recall = sum(i in g for i, g in zip(want, got)) / len(want)
        assert recall >= 0.95, (n, edits, recall)


def test_table(spark):
    rng = random.Random(1)
    items = spark.createDataFrame([(1, " ".join(rng.choices(WORDS, k=30))), (2, "too short to leak"), (3, None), (4, "")], "item_id bigint, text string")
    passage = items.first()["text"]
    rows = [(1, passage.upper()), (2, "x " * 200_000 + passage), (3, None), (4, ""), (5, passage.replace(" ", ",  ​")), (6, passage), (7, "nothing here"), (8, " ".join(passage.split()[:8]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit(7))
    assert {tuple(r) for r in leakage.find(docs, items).collect()} == {(1, 1), (2, 1), (5, 1), (6, 1)}
    assert leakage.find(docs.limit(0), items).count() == 0


def test_blocks_of_items(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(WORDS, k=20)) for _ in range(5)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id bigint, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 25)
    assert {tuple(r) for r in leakage.find(docs, items).collect()} == {(i, i) for i in range(5)}
