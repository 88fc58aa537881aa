"""Filling containers of fixed capacity with documents (problem 6).

A document's size is its number of tokens under the byte-level tokenizer ByT5: one per UTF-8 byte and
one end token. Each document gets a vector of hashed byte n-grams, projected to DIMENSIONS numbers at
random; the place of these on a Hilbert curve orders the documents so that neighbours are alike. The
curve is cut into ranges of about PART_TOKENS tokens; in each, blocks of BLOCK neighbours are packed one
after another, largest first, by best fit into the containers still open along the curve. Short blocks
keep a container's documents close on the curve, at a small cost of room (see report()).

A document is split only where it alone exceeds the capacity: into full containers and a rest, which
is packed like any other document. Tokens are split at exact offsets, so no room is lost.

Scale: texts are read where they lie and only ids, sizes and curve keys are shuffled, by range; the
ranges follow from the tokens of at most CUTS x SALTS stretches of the curve, over which equal keys (of
repeated documents) are spread by a hash of the id, so the same input always gives the same containers.
A task's memory holds one block and OPEN containers. Each range leaves at most the containers open at
its end partly filled.

Defined results: null texts are in no container; an empty text is one token; every other document is
in each capacity's packing exactly once, whole or as consecutive pieces that add up to it.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoflow.session import materialise

GRAM, CELLS, DIMENSIONS, BITS = 4, 512, 4, 10
BLOCK, OPEN = 256, 512
PART_TOKENS = 24_000_000
#: Stretches of the curve, as bits, that ranges are made of, and of equal keys.
CUTS, SALTS = 10, 64


def vector(data: bytes, matrix: np.ndarray) -> np.ndarray:
    """Projection of a text's hashed n-gram counts, damped and of unit length."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < GRAM:
        return np.zeros(DIMENSIONS)
    counts = np.zeros(CELLS)
    step = 1 << 22
    for lo in range(0, len(b) - GRAM + 1, step):  # long texts in slices
        part = b[lo : lo + step + GRAM - 1].astype(np.uint32)
        h = part[: len(part) - GRAM + 1].copy()
        for k in range(1, GRAM):
            h = h * np.uint32(0x01000193) ^ part[k : len(part) - GRAM + 1 + k]
        h = h * np.uint32(0x9E3779B1)
        counts += np.bincount(h >> np.uint32(23), minlength=CELLS)
    v = np.sqrt(counts)
    return v / np.linalg.norm(v) @ matrix


def hilbert(points: np.ndarray) -> np.ndarray:
    """Place on the Hilbert curve of rows of coordinates of BITS bits each (Skilling's transform)."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (BITS - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (BITS - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(BITS - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


class Packer:
    """Best fit into the open containers of one capacity, block by block along the curve."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.next = capacity, first
        self.room: list[tuple[int, int]] = []  # (room left, container), ascending

    def add(self, items: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
        """(container, id, piece, first token, tokens) of a block of (id, size)."""
        out, rest = [], []
        for i, size in items:
            piece = begin = 0
            while size - begin > self.capacity:
                out.append((self.next, i, piece, begin, self.capacity))
                self.next += 1
                piece += 1
                begin += self.capacity
            rest.append((size - begin, i, piece, begin))
        rest.sort(reverse=True)
        for size, i, piece, begin in rest:
            k = bisect_left(self.room, (size, -1))
            if k < len(self.room):
                left, container = self.room.pop(k)
            else:
                left, container = self.capacity, self.next
                self.next += 1
            out.append((container, i, piece, begin, size))
            if left > size:
                insort(self.room, (left - size, container))
        del self.room[: max(0, len(self.room) - OPEN)]  # the fullest are closed
        return out


def curve(docs: DataFrame, key: str, text: str, seed: int = 11) -> DataFrame:
    """(key, n_tokens, curve_key, place) of every document with a text; place: its standardised numbers."""
    rng = np.random.default_rng(seed)
    matrix = rng.standard_normal((CELLS, DIMENSIONS))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            v = np.stack([vector(t, matrix) for t in texts]) if texts else np.zeros((0, DIMENSIONS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) + 1 for t in texts], pa.int64()), *(pa.array(v[:, d]) for d in range(DIMENSIONS))], names=["id", "n_tokens", *(f"v{d}" for d in range(DIMENSIONS))])

    texts = docs.select(F.col(key).cast("bigint"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull())
    points = materialise(texts.mapInArrow(project, "id bigint, n_tokens bigint, " + ", ".join(f"v{d} double" for d in range(DIMENSIONS))))
    spread = points.agg(*[f(f"v{d}").alias(f"{n}{d}") for d in range(DIMENSIONS) for n, f in (("m", F.avg), ("s", F.stddev))]).first()
    mean = np.array([spread[f"m{d}"] or 0.0 for d in range(DIMENSIONS)])
    scale = np.array([spread[f"s{d}"] or 1.0 for d in range(DIMENSIONS)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = (np.stack([batch.column(2 + d).to_numpy() for d in range(DIMENSIONS)], axis=1) - mean) / scale
            cells = ((1 << BITS) / (1 + np.exp(-1.702 * z))).astype(np.int64).clip(0, (1 << BITS) - 1)
            places = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * DIMENSIONS), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert(cells), pa.int64()), places], names=[key, "n_tokens", "curve_key", "place"])

    return points.mapInArrow(place, f"`{key}` bigint, n_tokens bigint, curve_key bigint, place array<double>")


def pack(placed: DataFrame, capacities: DataFrame, key: str = "doc_id") -> DataFrame:
    """(capacity_id, container_id, key, piece_no, first_token, n_tokens) for each capacity.

    ``placed``: result of curve(), materialised. ``capacities``: (capacity_id, n_tokens), a short list
    of settings; null or non-positive capacities hold nothing.
    """
    sizes = [(r[0], r[1]) for r in capacities.select(F.col("capacity_id").cast("bigint"), F.col("n_tokens").cast("bigint")).dropDuplicates(["capacity_id"]).where("n_tokens > 0").orderBy("capacity_id").collect()]
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS))
    stretch = F.shiftright("curve_key", DIMENSIONS * BITS - CUTS) * SALTS + salt
    marked = placed.select(key, "n_tokens", "curve_key", F.xxhash64(key).alias("salt"), stretch.alias("stretch"))
    sums = marked.groupBy("stretch").agg(F.sum("n_tokens").alias("n")).orderBy("stretch").collect()  # at most 2^CUTS x SALTS
    ends = np.cumsum([r["n"] for r in sums]) if sums else np.zeros(0)
    parts = max(1, -(-int(ends[-1]) // PART_TOKENS)) if len(ends) else 1
    # Ranges of equal size, by where a stretch's middle lies.
    part_of = {r["stretch"]: int(min(parts - 1, (end - r["n"] / 2) * parts // ends[-1])) for r, end in zip(sums, ends)}
    borders = sorted({p: s for s, p in sorted(part_of.items(), reverse=True)}.items())  # the first stretch of each range
    firsts = F.array(*[F.lit(s).cast("bigint") for _, s in borders]) if borders else F.array(F.lit(0).cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packers, block = None, [], []

        def flush() -> pa.RecordBatch:
            rows = [(c, *r) for c, p in packers for r in p.add(block)]
            block.clear()
            cols = list(zip(*rows)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["capacity_id", "container_id", key, "piece_no", "first_token", "n_tokens"])

        for batch in batches:
            for part, i, n in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if part != now:
                    if block:
                        yield flush()
                    now, packers = part, [(c, Packer(size, part << 40)) for c, size in sizes]
                block.append((i, n))
                if len(block) >= BLOCK:
                    yield flush()
        if block:
            yield flush()

    part = F.size(F.filter(firsts, lambda s: s <= F.col("stretch")))
    ordered = marked.withColumn("part", part).repartition(parts, "part").sortWithinPartitions("part", "curve_key", "salt", key)
    return ordered.select("part", key, "n_tokens").mapInArrow(run, f"capacity_id bigint, container_id bigint, `{key}` bigint, piece_no bigint, first_token bigint, n_tokens bigint")


def report(packed: DataFrame, capacities: DataFrame, placed: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(capacity_id, n_containers, n_pieces, used_tokens, filled, spread): how full the containers are
    and how alike their documents.

    ``spread``: variance of the documents' places within containers as a share of that over all
    documents; about 1 where documents are packed in random order. Null without ``placed``, the result of
    curve(), or where no container holds two documents.
    """
    sizes = capacities.select("capacity_id", F.col("n_tokens").alias("size"))
    places = [F.lit(None).cast("double").alias(f"z{d}") for d in range(DIMENSIONS)]
    if placed is not None:
        places = [F.col("place")[d].alias(f"z{d}") for d in range(DIMENSIONS)]
        packed = packed.join(placed.select(key, "place").hint("merge"), key)
    held = packed.select("capacity_id", "container_id", "n_tokens", *places)
    deviations = [F.var_samp(f"z{d}") for d in range(DIMENSIONS)]
    within = sum((F.coalesce(v, F.lit(0.0)) for v in deviations), F.lit(0.0)) * (F.count("*") - 1)
    containers = held.groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"), within.alias("within"))
    counted = containers.groupBy("capacity_id").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("used").alias("used_tokens"), F.sum("within").alias("within"), F.sum(F.col("n") - 1).alias("free"))
    spread = F.when(F.col("free") > 0, F.col("within") / F.col("free") / DIMENSIONS) if placed is not None else F.lit(None).cast("double")
    return counted.join(F.broadcast(sizes), "capacity_id").select("capacity_id", "n_containers", "n_pieces", "used_tokens", (F.col("used_tokens") / (F.col("n_containers") * F.col("size"))).alias("filled"), spread.alias("spread"))
