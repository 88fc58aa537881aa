"""Passages of evaluation items in documents (problem 7).

Texts are folded to words without case, punctuation, accents, invisible characters or width
(``fold``). Every window of WINDOW words of an item is embedded by CGK random walks (Chakraborty,
Goldenberg, Koucký 2016): a walk copies the current word to the output and moves on to the next one
or not, as a random bit of (step, word) says, so that windows at a small edit distance become strings
at a small Hamming distance. Each of REPEATS walks is followed by bit sampling: the words at SAMPLE
random places of the output make a key. A document's windows get keys the same way and meet the
items' windows in an inverted index. Each meeting is verified by an exact alignment of the words by
edit distance: a passage is a stretch of at least WINDOW consecutive words of the item, changed and
missing ones counted, that stands in the document with at most one edit (a changed, missing or added
word) for every EIGHTH of its words. Longer passages with more than MOST_EDITS edits hold a stretch
with fewer that counts by itself.

A window in which more than a quarter of the words occur in no item at all can't lie in such a
passage with the allowed edits; these are passed over before they are embedded.

Scale: documents are read where they lie (a narrow input is spread over the cores first). The index of the items is broadcast in
blocks of at most BLOCK_WORDS words, so its size is bounded; further blocks take further passes.

Defined results: null, empty and blank texts match nothing, repeated documents each count, an item
of fewer than 12 words can't leak.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, REPEATS, SAMPLE = 12, 10, 5
EIGHTH, MOST_EDITS = 8, 3
BLOCK_WORDS = 400_000
#: Meetings within STEP words are verified together, over REACH more words on both sides.
STEP, REACH = 16, 20
#: Words of documents that are embedded together.
BATCH_WORDS = 400_000
_PUNCTUATION = re.compile(r"[^\w\s]+|_+")
_PAD = -1


def fold(text: str) -> list[str]:
    """A text's words in a form that case, punctuation, accents, widths and invisible signs don't change."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
    return _PUNCTUATION.sub("", text.casefold()).split()


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Well-mixed 64 bits of each number (the finaliser of splitmix64)."""
    z = x.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Index:
    """Keys of all windows of a block of items."""

    def __init__(self, items: list[tuple[int, list[str]]], seed: int = 7) -> None:
        self.items = [(i, w) for i, w in items if len(w) >= WINDOW]
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int32) for _, w in self.items]
        rng = np.random.default_rng(seed)
        steps = 3 * WINDOW
        # Bit r of walks[word] column j: does walk r move on at step j when it reads the word?
        n = len(self.vocabulary) + 2
        self.walks = np.stack([(_mix(np.arange(n), 1000 * seed + j) & np.uint64((1 << REPEATS) - 1)).astype(np.uint16) for j in range(steps)], axis=1)
        self.places = np.stack([np.sort(rng.choice(np.arange(1, 2 * WINDOW - 2), SAMPLE, replace=False)) for _ in range(REPEATS)])
        self.keys: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        if self.words:
            flat = np.concatenate([np.append(w, np.full(WINDOW, _PAD, np.int32)) for w in self.words])
            at, owner, first = 0, [], []
            for k, w in enumerate(self.words):
                starts = np.arange(len(w) - WINDOW + 1)
                first.append(at + starts)
                owner.append(np.stack([np.full(len(starts), k), starts], axis=1))
                at += len(w) + WINDOW
            first, owner = np.concatenate(first), np.concatenate(owner).astype(np.int32)
            for r, key in enumerate(self.embed(flat, first)):
                order = np.argsort(key, kind="stable")
                self.keys.append(key[order])
                self.owners.append(owner[order])

    def embed(self, flat: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        """For each walk the key of every window that begins at one of ``first``."""
        last = self.places.max() + 1
        for r in range(REPEATS):
            at = np.zeros(len(first), np.int64)
            key = np.full(len(first), r + 1, np.uint64)
            wanted = set(self.places[r].tolist())
            for j in range(last):
                word = np.where(at < WINDOW, flat[np.minimum(first + at, len(flat) - 1)], 0)
                if j in wanted:
                    key = _mix(key ^ (word.astype(np.uint64) << np.uint64(20)), j)
                at += (self.walks[word, j] >> r) & 1
            yield key

    def meetings(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (place in ids, item's place, offset in the item) of windows that share a key."""
        found = []
        for r, key in enumerate(self.embed(ids, first)):
            lo = np.searchsorted(self.keys[r], key, "left")
            n = np.searchsorted(self.keys[r], key, "right") - lo
            k = np.repeat(np.arange(len(first)), n)
            if len(k):
                ranks = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                found.append(np.column_stack([first[k], self.owners[r][ranks]]))
        return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


#: A passage with at most MOST_EDITS edits holds a run of so many equal words.
LEAST_RUN = min(-(-(max(WINDOW, EIGHTH * e) - e) // (e + 1)) for e in range(MOST_EDITS + 1))


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Does the first sequence of each pair hold a passage of the second? Exact, for many pairs at once.

    The longest run of equal words decides most pairs; only the others are aligned with edits.
    """
    runs = _in_lots(pairs, range(len(pairs)), _longest_runs, np.int16)
    holds = runs >= WINDOW
    rest = np.flatnonzero((runs >= LEAST_RUN) & ~holds).tolist()
    if rest:
        holds[rest] = _in_lots(pairs, rest, _aligned, bool)[rest]
    return holds


def _in_lots(pairs: list[tuple[np.ndarray, np.ndarray]], which, f, kind) -> np.ndarray:
    """f of padded lots of pairs of about one length: f(words of the first, words of the second), a column a pair."""
    out = np.zeros(len(pairs), kind)
    order = sorted(which, key=lambda k: len(pairs[k][0]))
    for lo in range(0, len(order), 512):
        part = order[lo : lo + 512]
        a = np.zeros((max(len(pairs[k][0]) for k in part), len(part)), np.int32)  # 0 and -2 match nothing
        b = np.full((max(len(pairs[k][1]) for k in part), len(part)), -2, np.int32)
        for k, p in enumerate(part):
            a[: len(pairs[p][0]), k] = pairs[p][0]
            b[: len(pairs[p][1]), k] = pairs[p][1]
        out[part] = f(a, b)
    return out


def _longest_runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    run, best = np.zeros(b.shape, np.int16), np.zeros(b.shape, np.int16)
    for word in a:
        now = (b == word).astype(np.int16)
        now[1:] += run[:-1] * now[1:]
        run = now
        np.maximum(best, run, out=best)
    return best.max(axis=0)


def _aligned(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """reach[e] holds, for each place of the second sequence, the most words of it that end there and stand
    in the first up to the current word with at most e edits."""
    inside = (b != -2).astype(np.int16)
    reach = np.zeros((MOST_EDITS + 1, b.shape[0] + 1, b.shape[1]), np.int16)
    most = np.zeros_like(reach)
    for word in a:
        now = np.zeros_like(reach)
        np.multiply(reach[:, :-1] + np.int16(1), b == word, out=now[:, 1:])
        np.maximum(now[1:], reach[:-1], out=now[1:])  # added
        for e in range(1, MOST_EDITS + 1):
            edit = (np.maximum(reach[e - 1, :-1], now[e - 1, :-1]) + np.int16(1)) * inside  # changed, missing
            np.maximum(now[e, 1:], edit, out=now[e, 1:])
        reach = now
        np.maximum(most, reach, out=most)
    least = [max(WINDOW, EIGHTH * e) for e in range(MOST_EDITS + 1)]
    return (most.max(axis=1) >= np.array(least)[:, None]).any(axis=0)


def leaks(texts: list[str | None], index: Index) -> list[list[int]]:
    """For each text the ids of the items of which it holds a passage."""
    out: list[list[int]] = [[] for _ in texts]
    if not index.keys:
        return out
    get = index.vocabulary.get
    parts, owners, held = [], [], 0
    for k, text in enumerate(texts):
        if text and not text.isspace():
            ids = np.fromiter((get(w, 0) for w in fold(text)), np.int32)
            if len(ids) >= WINDOW and np.count_nonzero(ids) >= WINDOW - WINDOW // 4:
                parts.append(ids)
                owners.append(k)
                held += len(ids)
        if parts and (held > BATCH_WORDS or k == len(texts) - 1):
            _leaks(parts, owners, index, out)
            parts, owners, held = [], [], 0
    if parts:
        _leaks(parts, owners, index, out)
    return out


def _leaks(parts: list[np.ndarray], owners: list[int], index: Index, out: list[list[int]]) -> None:
    gap = np.zeros(WINDOW, np.int32)  # no window reaches over it: none of its words is known
    flat = np.concatenate([x for p in parts for x in (p, gap)])
    begin = np.cumsum([0, *(len(p) + WINDOW for p in parts)])
    known = np.concatenate([[0], np.cumsum(flat > 0)])
    first = np.nonzero(known[WINDOW:] - known[:-WINDOW] >= WINDOW - WINDOW // 4)[0]
    if not len(first):
        return
    met = index.meetings(flat, first)
    if not len(met):
        return
    doc = np.searchsorted(begin, met[:, 0], "right") - 1
    # One region to verify for meetings that lie close together; of each document and item the region
    # with the most meetings comes first, the others only where that one fails.
    place, diagonal = met[:, 0] // STEP, (met[:, 0] - met[:, 2]) // STEP
    low = int(diagonal.min())
    n_place, n_diagonal = int(place.max()) + 1, int(diagonal.max()) - low + 1
    codes, meetings = np.unique(((doc * len(index.items) + met[:, 1]) * n_place + place) * n_diagonal + diagonal - low, return_counts=True)
    rest, d = np.divmod(codes, n_diagonal)
    rest, p = np.divmod(rest, n_place)
    spots = np.column_stack([*np.divmod(rest, len(index.items)), p, d + low])
    order = np.lexsort((-meetings, spots[:, 1], spots[:, 0]))
    spots = spots[order]
    head = np.ones(len(spots), bool)
    head[1:] = (spots[1:, :2] != spots[:-1, :2]).any(axis=1)
    hit: set[tuple[int, int]] = set()
    for turn in (spots[head], spots[~head]):
        tests = [t for t in turn.tolist() if (t[0], t[1]) not in hit]
        regions = []
        for d, item, place, diagonal in tests:
            w = index.words[item]
            at, q = place * STEP, (place - diagonal) * STEP
            regions.append((flat[max(begin[d], at - REACH) : min(begin[d + 1], at + STEP + WINDOW + REACH)], w[max(0, q - REACH - STEP) : max(0, q + STEP + WINDOW + REACH)]))
        if tests:
            for k in np.nonzero(align(regions))[0].tolist():
                hit.add((tests[k][0], tests[k][1]))
    for d, item in sorted(hit):
        out[owners[d]].append(index.items[item][0])


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK_WORDS words (one item may be larger), one at a time."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.select(F.col(key).cast("bigint"), F.col(text).cast("string")).dropDuplicates().orderBy(key).toLocalIterator():
        if row[1] is None:
            continue
        n = len(row[1].split())
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    yield block


def find(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_key, item_key): each document with every item of which it holds a passage."""
    sc = docs.sparkSession.sparkContext
    narrow = docs.select(F.col(doc_key).cast("bigint"), F.col(text).cast("string"))
    out = None
    for block in _blocks(items, item_key, text):
        shared = sc.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index([(i, fold(t)) for i, t in shared.value])
            for batch in batches:
                keys, found = [], []
                for k, items_of in zip(batch.column(0).to_pylist(), leaks(batch.column(1).to_pylist(), index)):
                    keys.extend([k] * len(items_of))
                    found.extend(items_of)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.int64())], names=[doc_key, item_key])

        part = narrow.mapInArrow(run, f"`{doc_key}` bigint, `{item_key}` bigint")
        out = part if out is None else out.unionByName(part)
    return out
