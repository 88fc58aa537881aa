"""Pairing of curated with generated records of a document by TF-IDF cosine and assignment.

records: (doc_id, side, idx, code, title, abstract) with side 'gold' or 'ours'. Weights and cosines
are joins on (doc_id, term) with the norms computed before; only the assignment itself, a sequential
choice, runs per document in Python on the scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoflow import policy as P
from lithoflow.functions import text as X
from lithoflow.session import materialise

#: Scored pairs of a group that may be one task's list.
LIST_PAIRS = 100_000

TERM = r"[a-z]+\d*|\d+(?:\.\d+)?"


def terms(text: Column) -> Column:
    return X.extract_all(X.norm(text), TERM)


def weights(records: DataFrame, group: str = "doc_id") -> DataFrame:
    """(group, side, idx, term, w): the title's terms twice and the abstract's, times ln(1 + N / df)."""
    r = records.select(group, "side", "idx", F.concat(terms(F.col("title")), terms(F.col("title")), terms(F.col("abstract"))).alias("ts"))
    counts = r.select(group, "side", "idx", F.explode("ts").alias("term")).groupBy(group, "side", "idx", "term").agg(F.count("*").alias("tf"))
    df = counts.groupBy(group, "term").agg(F.count("*").alias("df"))
    n = records.groupBy(group).agg(F.count("*").alias("n"))
    return counts.join(df, [group, "term"]).join(n, group).select(group, "side", "idx", "term", (F.col("tf") * F.log(1 + F.col("n") / F.col("df"))).alias("w"))


def scores(records: DataFrame, group: str = "doc_id") -> DataFrame:
    """(group, g, o, score) of every gold and our record of a group that share a term or a code.

    Pairs without either have score 0 and are left out; 1 where the codes are equal, else 0.9 cosine.
    """
    w = materialise(weights(records, group))  # read for the norms and for both sides
    norms = w.groupBy(group, "side", "idx").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    w = w.join(norms, [group, "side", "idx"]).where("norm > 0").select(group, "side", "idx", "term", (F.col("w") / F.col("norm")).alias("w"))
    a = w.where("side = 'gold'").select(group, "term", F.col("idx").alias("g"), F.col("w").alias("wg"))
    b = w.where("side = 'ours'").select(group, "term", F.col("idx").alias("o"), F.col("w").alias("wo"))
    cosine = a.join(b, [group, "term"]).groupBy(group, "g", "o").agg((0.9 * F.sum(F.col("wg") * F.col("wo"))).alias("score"))
    coded = records.select(group, "side", "idx", X.flat(F.col("code")).alias("c")).where("c <> ''")
    same = coded.where("side = 'gold'").select(group, "c", F.col("idx").alias("g")).join(coded.where("side = 'ours'").select(group, "c", F.col("idx").alias("o")), [group, "c"]).select(group, "g", "o", F.lit(1.0).alias("score"))
    return cosine.unionByName(same).groupBy(group, "g", "o").agg(F.max("score").alias("score"))


def exact(matrix: list[list[float]]) -> list[tuple[int, int]]:
    """Assignment of the largest total; of equal ones the first in lexicographic order of the longer side's choices."""
    rows, cols = len(matrix), len(matrix[0]) if matrix else 0
    flip = rows > cols
    m = [list(c) for c in zip(*matrix)] if flip else matrix
    n, k = len(m), len(m[0]) if m else 0
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for i in range(n):  # states by the set of columns in use
        nxt: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (total, chosen) in best.items():
            for j in range(k):
                if not used >> j & 1:
                    t, c, u = total + m[i][j], (*chosen, j), used | 1 << j
                    if u not in nxt or (t, [-x for x in c]) > (nxt[u][0], [-x for x in nxt[u][1]]):
                        nxt[u] = (t, c)
        best = nxt
    if not best:
        return []
    top = max(best.values(), key=lambda v: (v[0], [-x for x in v[1]]))
    return [(j, i) if flip else (i, j) for i, j in enumerate(top[1])]


def greedy(pairs: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """Highest scores first, each record once; ties by larger positions first."""
    out, gs, os_ = [], set(), set()
    for _, g, o in sorted(pairs, reverse=True):
        if g not in gs and o not in os_:
            out.append((g, o))
            gs.add(g)
            os_.add(o)
    return out


def dominant(s: DataFrame, group: str = "doc_id") -> DataFrame:
    """greedy() for groups of any size: in each round the pairs that are the best of both their records
    are taken and their records leave, which gives the pairs that one sorted pass would."""
    out, left = None, s
    while True:
        best = lambda side: left.groupBy(group, side).agg(F.max(F.struct("score", "g", "o")).alias("b")).select(group, "b.g", "b.o")
        part = materialise(best("g").join(best("o"), [group, "g", "o"]))
        out = part if out is None else out.unionByName(part)
        left = materialise(left.join(part.select(group, "g"), [group, "g"], "left_anti").join(part.select(group, "o"), [group, "o"], "left_anti"))
        if left.isEmpty():
            return out


def match(records: DataFrame, group: str = "doc_id") -> DataFrame:
    """(group, g, o, score, uncertain): exact for up to 2 * EXHAUSTIVE records together, greedy beyond."""
    records = records.select(group, "side", "idx", "code", "title", "abstract")
    s = scores(records, group)
    sizes = records.groupBy(group).agg(F.count_if(F.col("side") == "gold").alias("n_g"), F.count_if(F.col("side") == "ours").alias("n_o"))
    # Only groups of the exact bound are listed record by record.
    few = sizes.where(F.col("n_g") + F.col("n_o") <= 2 * P.EXHAUSTIVE).select(group)
    listed = records.select(group, "side", "idx").join(few, group, "left_semi").groupBy(group).agg(F.sort_array(F.collect_list(F.struct("side", "idx"))).alias("all"))
    # Only scores travel to Python, as one list per group; a group beyond the exact bound is matched greedily
    # there, or, where its list would be too long for one task, in rounds over the table.
    s = materialise(s)
    counts = s.groupBy(group).agg(F.count("*").alias("n"))
    large = materialise(counts.where(F.col("n") > LIST_PAIRS).join(sizes, group).where(F.col("n_g") + F.col("n_o") > 2 * P.EXHAUSTIVE).select(group))
    lists = s.join(large, group, "left_anti").groupBy(group).agg(F.collect_list(F.struct("g", "o", "score")).alias("ss"))
    small = F.col("n_g") + F.col("n_o") <= 2 * P.EXHAUSTIVE
    side = lambda name: F.when(small, F.transform(F.filter("all", lambda x: x["side"] == name), lambda x: x["idx"]))
    joined = lists.join(sizes, group).join(listed, group, "left").select(F.col(group).cast("bigint"), "ss", side("gold").alias("gs"), side("ours").alias("os"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int]] = []
            for doc, ss, gs, os_ in zip(*(batch.column(k).to_pylist() for k in range(4))):
                got = {(x["g"], x["o"]): x["score"] for x in ss}
                if gs is None:
                    pairs = greedy([(v, g, o) for (g, o), v in got.items()])
                else:
                    pairs = [(gs[i], os_[j]) for i, j in exact([[got.get((g, o), 0.0) for o in os_] for g in gs])]
                rows += [(doc, g, o) for g, o in sorted(pairs) if got.get((g, o), 0.0) >= P.LEAST_MATCH]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[group, "g", "o"])

    pairs = joined.mapInArrow(run, f"`{group}` bigint, g bigint, o bigint")
    if not large.isEmpty():
        pairs = pairs.unionByName(dominant(s.join(large, group, "left_semi").where(F.col("score") >= P.LEAST_MATCH), group))
    return uncertain(pairs.join(s, [group, "g", "o"]), s, sizes.select(group, "n_g", "n_o"), group)


def uncertain(pairs: DataFrame, s: DataFrame, sizes: DataFrame, group: str = "doc_id") -> DataFrame:
    """pairs with uncertain: the best competing score in the pair's row or column comes within the margin."""
    def top(side: str) -> DataFrame:
        w = Window.partitionBy(group, side).orderBy(F.desc("score"), "g", "o")
        return s.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy(group, side).agg(F.max("score").alias(f"{side}1"), F.min(F.when(F.col("r") == 2, F.col("score"))).alias(f"{side}2"), F.max(F.when(F.col("r") == 1, F.struct("g", "o"))).alias(f"{side}_at"))

    p = pairs.join(top("g"), [group, "g"]).join(top("o"), [group, "o"]).join(sizes, group)
    rival = lambda side: F.when(F.col(f"{side}_at") == F.struct("g", "o"), F.coalesce(f"{side}2", F.lit(0.0))).otherwise(F.col(f"{side}1"))
    has = (F.col("n_g") > 1) | (F.col("n_o") > 1)
    return p.select(group, "g", "o", "score", (has & (F.col("score") - F.greatest(F.when(F.col("n_o") > 1, rival("g")).otherwise(-1.0), F.when(F.col("n_g") > 1, rival("o")).otherwise(-1.0)) < P.UNCERTAIN_MARGIN)).alias("uncertain"))
