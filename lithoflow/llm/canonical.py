"""Mapping of freely typed values to the entries of a reference list (problem 2).

Distinct values are normalised and cut into parts at separators; every contiguous run of parts is a
reading of the value. The character n-grams of a reading retrieve entries from an inverted index over
labels and aliases by cosine, n-grams being weighted by their rarity in the whole list. All entries of
at least LEAST_COSINE, however many, are scored by the weighted cosine of the words: each word of the
entry must stand in the reading, up to typing errors and abbreviations, and words of the reading that
the entry lacks are in its vector if they tell entries apart. The best entry is accepted above
LEAST_SCORE and if no other entry comes within MARGIN; else 0. Values equal to an entry take the same way.

Scale: only distinct values are scored, with no shuffle but their own; the index of the reference list
is broadcast in blocks of at most BLOCK strings, further blocks take further passes. Weights are counted
over all blocks first, so a value's scores don't depend on how the list is cut.

Defined results: null and blank values are no cases; a value equal to a label, character for
character, is no case either; ties between entries give 0; with an empty list every value gives 0.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoflow.session import growing, materialise

BLOCK = 50_000
LEAST_COSINE, LEAST_SCORE, MARGIN = 0.15, 0.7, 0.03

# Words that don't tell entries apart, and abbreviations that aren't beginnings.
STOP = {"of", "the", "for", "in", "and", "at", "a", "an", "de", "des", "du", "der", "die", "das", "den", "fur", "f", "von", "im", "la", "le", "les", "el", "los", "y", "et", "und", "d", "l"}
ABBREVIATIONS = {"ctr": "centre", "center": "centre", "centr": "centre", "lab": "laboratory", "labs": "laboratory", "natl": "national", "dept": "department", "tech": "technology", "mgr": "manager"}
EXPANSIONS = {"tu": "technische universitat", "wp": "work package"}
#: Remarks around a value: they may stand beside an entry without changing it.
REMARKS = {"team", "study", "part", "time", "deputy", "2nd", "1st", "3rd", "group a", "project", "acting", "former", "formerly", "building", "room", "campus", "street", "str", "city", "germany", "main"}


@lru_cache(200_000)
def fold(text: str) -> str:
    """Lower case, words apart (also CamelCase), no accents or punctuation."""
    text = unicodedata.normalize("NFKC", text)
    text = re.sub(r"(?<=[a-zäöü])(?=[A-ZÄÖÜ][a-zäöü])", " ", text)
    text = text.casefold().replace("ø", "o").replace("ł", "l")
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    text = re.sub("([aou])e(?![aeiou])", r"\1", text)
    return " ".join(EXPANSIONS.get(w, w) for w in re.findall(r"[^\W_]+", text))


def grams(text: str) -> list[str]:
    return [f"{w}"[k : k + n] for w in (f"^{x}$" for x in text.split()) for n in (2, 3) for k in range(len(w) - n + 1)]


@lru_cache(500_000)
def edits(a: str, b: str) -> int:
    """Damerau-Levenshtein distance (transpositions of neighbours count once)."""
    if a == b:
        return 0
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, now[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            now.append(v)
        two, one = one, now
    return one[-1]


@lru_cache(500_000)
def word_similarity(typed: str, word: str) -> float:
    """How well a typed word stands for a word of an entry; 0 if it doesn't."""
    if typed == word:
        return 1.0
    n = len(word)
    if ABBREVIATIONS.get(typed) == word:
        return 0.97
    m = len(typed)
    if 2 < m < n and word.startswith(typed) and m <= max(4, n - 2):
        return 0.95
    if min(m, n) < 3 or n < 4:
        return 0.0
    if m < 6 <= n and typed[0] == word[0] and _within(typed, word) and (m == 3 or not set("aiou") & set(typed[1:])):
        return 0.85
    if _RUNS.sub(r"\1", typed) == _RUNS.sub(r"\1", word) or typed in (word + "s", word + "in") or typed + "s" == word:
        return 0.95
    most = 1 if n < 6 or m < 4 else 2 if n < 13 or typed[:2] != word[:2] else 3
    # An edit changes the length by one and the set of letters by two at most.
    near = abs(m - n) <= most and len(_chars(typed) ^ _chars(word)) <= 2 * most
    d = edits(typed, word) if near else most + 1
    if d > 1 and near and typed[0] == word[0] and sorted(typed) == sorted(word):
        d = 1
    if d <= most and (m > 3 or typed[0] == word[0]):
        return 1 - d / (n + 2)
    if 3 < m < 7 and n > m + 1 and typed[0] == word[0] and any(edits(typed, word[:k]) <= 1 for k in (m - 1, m, m + 1)):
        return 0.85  # an abbreviation with a typing error
    if 3 < m < 6 and any(w == word and edits(typed, k) <= 1 for k, w in ABBREVIATIONS.items()):
        return 0.85
    return 0.0


@lru_cache(200_000)
def _chars(word: str) -> frozenset[str]:
    return frozenset(word)


def _within(typed: str, word: str) -> bool:
    """The letters of ``typed`` stand in ``word`` in the same order."""
    rest = iter(word)
    return all(c in rest for c in typed)


_RUNS = re.compile(r"(.)\1+")


@lru_cache(50_000)
def small(word: str) -> bool:
    """A word that doesn't tell entries apart, or such a word with a typing error."""
    return word in STOP or len(word) < 5 and any(len(s) > 1 and edits(word, s) <= 1 for s in STOP)


def readings(value: str) -> list[str]:
    """The runs of parts of a value, folded; the whole first."""
    parts = [p for p in re.split(r"[,;:/()\[\]|\"]+|\s[-–—]+\s|\bc/o\b", value) if p and re.search(r"[^\W_]", p)]
    whole = fold(value)
    found = {whole: None}
    for n in range(len(parts), 0, -1):
        for k in range(len(parts) - n + 1):
            found.setdefault(fold(" ".join(parts[k : k + n])), None)
    return [r for r in found if r]


@lru_cache(20_000)
def letters(text: str) -> Counter[str]:
    return Counter(text)


class Weights:
    """Rarity of n-grams and words over a whole reference list, however many blocks it is read in."""

    def __init__(self) -> None:
        self.n = 0
        self.grams: Counter[str] = Counter()
        self.words: Counter[str] = Counter()

    def add(self, text: str) -> None:
        """Counts a string of the list."""
        folded = fold(text)
        self.n += 1
        self.grams.update(set(grams(folded)))
        self.words.update(set(telling(folded)))

    def gram(self, g: str) -> float:
        return math.log(1 + self.n / self.grams.get(g, 1))

    def word(self, w: str) -> float:
        return 1 + math.log(1 + self.n / self.words.get(w, 1))


def telling(text: str) -> list[str]:
    """The words of a folded text that tell entries apart, all if there is none."""
    words = text.split()
    return [w for w in words if w not in STOP] or words


class Index:
    """Inverted index of character n-grams over a block of the reference list's strings."""

    def __init__(self, entries: list[tuple[int, str]], weights: Weights) -> None:
        folded = {(i, fold(t)) for i, t in entries if t and fold(t)}
        self.entries = sorted(folded, key=lambda x: (x[1], x[0]))
        self.words = [telling(t) for _, t in self.entries]
        self.weights = weights
        # Of each entry its words with their squared weights, longest first, their sum, and all in one.
        self.parts = [[(w, weights.word(w) ** 2) for w in sorted(ws, key=len, reverse=True)] for ws in self.words]
        self.norms = [sum(x for _, x in part) for part in self.parts]
        self.joined = ["".join(ws) for ws in self.words]
        self.gram = {g: weights.gram(g) for g in weights.grams}
        self.rare = weights.gram("")
        norms = np.zeros(max(len(self.entries), 1))
        lists: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, (_, t) in enumerate(self.entries):
            counts = Counter(grams(t))
            norms[k] = math.sqrt(sum((c * self.gram[g]) ** 2 for g, c in counts.items()))
            for g, c in counts.items():
                lists[g].append((k, c * self.gram[g] ** 2))
        norms[norms == 0] = 1
        self.postings = {g: (np.array([k for k, _ in p], np.int64), np.array([w / norms[k] for k, w in p])) for g, p in lists.items()}

    def candidates(self, reading: str) -> list[int]:
        """Places of all entries of at least LEAST_COSINE."""
        counts = Counter(grams(reading))
        norm = math.sqrt(sum((c * self.gram.get(g, self.rare)) ** 2 for g, c in counts.items()))
        hits = [(self.postings[g], c) for g, c in counts.items() if g in self.postings]
        if not hits:
            return []
        cosine = np.bincount(np.concatenate([p[0] for p, _ in hits]), np.concatenate([p[1] * c for p, c in hits]), len(self.entries)) / norm
        return np.nonzero(cosine >= LEAST_COSINE)[0].tolist()

    def score(self, reading: str, k: int) -> float:
        """Weighted cosine of a reading and an entry over their words, a typed word standing for a word of
        the entry as far as word_similarity() says; 0 where a word of the entry is missing.

        Both vectors have a word's rarity as its weight. Words that the entry doesn't have are in the
        reading's vector unless they are numbers, remarks or small words, which tell no entries apart.
        """
        return self._score([w for w in reading.split() if w not in STOP], reading, k)

    def _score(self, typed: list[str], reading: str, k: int) -> float:
        words = self.words[k]
        if len(words) == 1 and len(words[0]) <= 8 and words[0] not in reading:  # short names and acronyms
            one = "".join(typed)
            s = word_similarity(one, words[0]) if len(words[0]) > 3 and one[:1] == words[0][:1] or len(words[0]) > 4 else 0.0
            if not any(c.isdigit() for c in one) and s and (len(typed) == 1 or len(one) > 4):
                return s * (1 if len(typed) == 1 else 0.95)
        product = 0.0
        free = typed.copy()
        for w, weight in self.parts[k]:
            best, at = 0.0, -1
            for j, v in enumerate(free):
                s = word_similarity(v, w)
                if s > best:
                    best, at = s, j
                    if s == 1.0:
                        break
            if at < 0:
                return self._squashed(typed, k)
            product += weight * best
            free.pop(at)
        other = 0.0
        for v in free:
            if v.isdigit() or v in REMARKS or len(v) == 1 or small(v) or any(word_similarity(v, w) for w in words):
                continue
            other += max((self.weights.word(w) for w in self.near_words(v)), default=self.weights.word("")) ** 2
        own = self.norms[k]
        return product / math.sqrt(own * (own + other)) if own else 0.0

    @lru_cache(100_000)
    def near_words(self, typed: str) -> tuple[str, ...]:
        if typed in self.weights.words:
            return (typed,)
        return tuple(w for w in self.weights.words if abs(len(w) - len(typed)) < 3 and word_similarity(typed, w))

    def _squashed(self, typed: list[str], k: int) -> float:
        """Similarity without the spaces, for words that ran together."""
        b = self.joined[k]
        if len(b) < 8 or len(typed) == len(self.words[k]) or abs(sum(map(len, typed)) - len(b)) > 3:
            return 0.0
        a = "".join(typed)
        most = max(1, len(b) // 5)
        if max(len(a), len(b)) - (letters(a) & letters(b)).total() > most:  # an edit changes one letter at most
            return 0.0
        d = edits(a, b)
        return 1 - d / len(b) if d <= most else 0.0

    def best(self, value: str) -> dict[int, float]:
        """Score of the verified entries of a value."""
        scores: dict[int, float] = {}
        for r in readings(value):
            typed = [w for w in r.split() if w not in STOP]
            for k in self.candidates(r):
                if s := self._score(typed, r, k):
                    i = self.entries[k][0]
                    scores[i] = max(scores.get(i, 0), s)
        return scores


_BUILT: dict[str, Index] = {}


def _index(name: str, block: list[tuple[int, str]], weights: Weights) -> Index:
    """The index of a block, built once in each Python worker, which holds the last one only."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Index(block, weights)
    return _BUILT[name]


def _texts(entries: DataFrame) -> Iterator[tuple[int, str]]:
    for row in entries.select("ref_id", "text").where("text is not null").dropDuplicates().orderBy("ref_id", "text").toLocalIterator():
        if fold(row[1]):
            yield row[0], row[1]


def _reference(entries: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The reference list in blocks of at most BLOCK strings."""
    texts = _texts(entries)
    while block := list(itertools.islice(texts, BLOCK)):
        yield block


def strings(reference: DataFrame, key: str, label: str = "label", aliases: str = "aliases") -> DataFrame:
    """(ref_id, text): labels and aliases of a reference list."""
    names = F.concat(F.array(F.col(label)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    return reference.select(F.col(key).cast("bigint").alias("ref_id"), F.explode(names).alias("text"))


def map_values(values: DataFrame, entries: DataFrame) -> DataFrame:
    """(value, ref_id, score) for distinct ``values`` (value); ref_id 0: none of the entries."""
    sc = values.sparkSession.sparkContext
    counted = Weights()
    for _, text in _texts(entries):
        counted.add(text)
    weights = sc.broadcast(counted)  # the list's n-grams and words
    scored = None
    for block in _reference(entries):
        shared = sc.broadcast((uuid.uuid4().hex, block))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = _index(*shared.value, weights.value)
            for batch in batches:
                rows = [(v, i, s) for v in batch.column(0).to_pylist() for i, s in index.best(v).items()]
                cols = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["value", "ref_id", "score"])

        part = values.select("value").mapInArrow(run, "value string, ref_id bigint, score double")
        scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        return values.select("value", F.lit(0).cast("bigint").alias("ref_id"), F.lit(0.0).alias("score"))
    ranked = scored.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("score", "ref_id")), asc=False).alias("r"))  # few entries are verified per value
    top, next_ = F.col("r")[0], F.get("r", F.lit(1))
    accepted = (top["score"] >= LEAST_SCORE) & (next_.isNull() | (top["score"] - next_["score"] >= MARGIN))
    best = ranked.select("value", F.when(accepted, top["ref_id"]).otherwise(F.lit(0)).cast("bigint").alias("ref_id"), top["score"].alias("score"))
    return values.select("value").join(best, "value", "left").select("value", F.coalesce("ref_id", F.lit(0).cast("bigint")).alias("ref_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def find(rows: DataFrame, reference: DataFrame, key: str, label: str = "label", aliases: str = "aliases") -> DataFrame:
    """(row_id, value, ref_id) of the rows (row_id, value) whose value is not a label itself."""
    rows = rows.select(F.col("row_id").cast("bigint").alias("row_id"), F.col("value").cast("string").alias("value"))
    labels = reference.select(F.col(label).alias("value")).distinct()
    kept = rows.where(F.col("value").rlike(r"(?U)[^\s\x1c-\x1f]")).join(labels, "value", "left_anti")
    distinct = kept.select("value").distinct()
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    # Written once: what a value means is costly to tell, and the join below may read it again.
    mapped = materialise(map_values(materialise(distinct.repartition(n)), strings(reference, key, label, aliases)))
    return kept.join(growing(mapped), "value").select("row_id", "value", "ref_id").dropDuplicates(["row_id"])
