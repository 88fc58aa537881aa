import random

import numpy as np
from pyspark.sql import functions as F

from lithoflow.llm import packing
from lithoflow.session import materialise


def test_curve_visits_neighbours():
    side = 1 << packing.BITS
    cells = np.array([[a, b, c, d] for a in range(4) for b in range(4) for c in range(4) for d in range(4)]) * (side // 4)
    order = np.argsort(packing.hilbert(cells))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == side // 4).all()


def test_packer():
    rng = random.Random(2)
    for capacity in (1, 7, 100):
        items = [(k, rng.randint(1, 250)) for k in range(400)]
        p = packing.Packer(capacity, 5)
        rows = [r for lo in range(0, 400, 50) for r in p.add(items[lo : lo + 50])]
        held: dict = {}
        for c, i, piece, begin, n in rows:
            held[c] = held.get(c, 0) + n
        assert max(held.values()) <= capacity and min(held) == 5
        for i, size in items:
            own = sorted((piece, begin, n) for _, k, piece, begin, n in rows if k == i)
            assert sum(n for _, _, n in own) == size and [b for _, b, _ in own] == [sum(n for _, _, n in own[:k]) for k in range(len(own))]
            assert len(own) == 1 or size > capacity


def test_table(spark):
    texts = ["a" * n for n in (0, 5, 50, 500, 20_000)] + ["ж" * 40] * 30 + [None, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("v0", F.lit("clash")).withColumn("id", F.lit(0))
    caps = spark.createDataFrame([(1, "s", 128), (2, "m", 1000), (3, "none", None), (4, "zero", 0)], "capacity_id bigint, label string, n_tokens bigint")
    packed = packing.pack(materialise(packing.curve(df, "doc_id", "text")), caps).collect()
    for cap, size in ((1, 128), (2, 1000)):
        rows = [r for r in packed if r["capacity_id"] == cap]
        for i, t in enumerate(texts):
            assert sum(r["n_tokens"] for r in rows if r["doc_id"] == i) == (len(t.encode()) + 1 if t is not None else 0)
        held: dict = {}
        for r in rows:
            held[r["container_id"]] = held.get(r["container_id"], 0) + r["n_tokens"]
        assert max(held.values()) <= size and (cap == 1 or sum(held.values()) / (len(held) * size) > 0.9)
    assert {r["capacity_id"] for r in packed} == {1, 2}
    empty = packing.pack(materialise(packing.curve(df.limit(0), "doc_id", "text")), caps)
    assert empty.count() == 0


def test_neighbours_share_containers(spark, monkeypatch):
    """Texts of eight kinds: packed along the curve, containers are more alike inside than at random, nearly
    full, and the same in every run, however many ranges and partitions there are."""
    rng = random.Random(4)
    kinds = [[f"{a}{b}{c}" for a in rng.sample("bcdfghjkl", 3) for b in rng.sample("aeiou", 2) for c in rng.sample("mnprst", 2)] for _ in range(8)]
    rows = [(k, " ".join(rng.choices(kinds[k % 8], k=rng.randint(5, 60)))) for k in range(4000)] + [(5000 + k, "the same text " * 5) for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    caps = spark.createDataFrame([(1, "s", 1024)], "capacity_id bigint, label string, n_tokens bigint")
    monkeypatch.setattr(packing, "PART_TOKENS", 100_000)
    placed = materialise(packing.curve(df, "doc_id", "text"))
    packed = materialise(packing.pack(placed, caps))
    r = packing.report(packed, caps, placed).first()
    assert r["filled"] > 0.97 and r["spread"] < 0.6
    shuffled = packed.withColumn("doc_id", F.pmod(F.col("doc_id") * 7919, F.lit(4000))).dropDuplicates(["doc_id"])
    assert 0.8 < packing.report(shuffled, caps, placed).first()["spread"] < 1.2
    other = materialise(packing.curve(df.repartition(5, "text"), "doc_id", "text"))
    assert packing.pack(other, caps).exceptAll(packed).count() == 0
    assert packing.report(packed, caps).first()["spread"] is None
