"""Template residue, filler, error pages and script notices in text fields (problem 1).

Three character n-gram models share one form: counts of n-grams up to ORDER characters, hashed into
CELLS cells, with each order's estimate backing off to the next shorter one. Two are fitted on seed
phrases spelt out by rule below (template slots, filler and form instructions; error pages, session
messages and script notices), the third on natural prose: all distinct texts of the rows at hand, whole. As they hold residue too, they are cleaned: a
first fit, from which rare n-grams that the seeds hold too are left out, finds the clear cases; they
are left out and prose is fitted again, and so once more.

A row's characters get the log-likelihood ratios of the two residue models against prose. Windows of
residue are the maximal runs whose cumulated ratio reaches LEAST_RATIO and that cover WORD_COVERAGE of
the words they touch. A row is excluded by coverage: if its windows cover at least LEAST_COVERAGE of the
text, or, so that real content around it doesn't hide it, the words around a window of CERTAIN_RATIO.

Scale: counting and cleaning run in tasks over the distinct texts, whose counts are summed before they reach
the driver (at most CELLS numbers a table); rows are scored where they are read.

Defined results: null and blank texts have no windows and are never cases; a row repeated with the
same key counts once; texts of any length are scored whole.
"""

from __future__ import annotations

import http
import itertools
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoflow.session import drop, materialise, spread

ORDER, CELLS = 6, 1 << 21
#: Characters that are counted or scored at once.
AT_ONCE = 300_000
#: Counts over more texts are scaled down to so many: the seeds' counts and the models' smoothing don't grow with the table.
#: Of longer n-grams whole counts are taken, else strangers that share a cell would lend each other likelihood.
UNIT_ROWS = 30_000
#: Distinct texts of a bounded sample, for trials, and the most characters of each. find() takes none.
SAMPLE_ROWS, SAMPLE_CHARS = 30_000, 4_000
LEAST_RATIO, LEAST_COVERAGE = 7.0, 0.5
#: A window counts if it covers that share of the words it touches; one of this ratio excludes its row.
CERTAIN_RATIO, WORD_COVERAGE = 8.0, 0.7
#: Of n-grams that the residue seeds hold, the first fit takes a share RARE[0] of the texts off the
#: prose counts, later ones RARE[1]: residue is rarer. Each fit's rows with a window of the next of
#: CLEAN_RATIOS are left out.
RARE, CLEAN_RATIOS = (0.0014, 0.0005), (9.0, 7.0)
#: Bounds of one character's ratio; signs tell more than letters, which names spell in any order.
LOW, HIGH, SIGN_HIGH = -3.0, 3.0, 5.0
#: What single characters that a model hasn't seen get of it, whatever it was fitted on.
OPEN = 0.02
#: Taken off each character's ratio, so that long prose doesn't drift into a window.
DRIFT = 0.15

# What a template's slots are called, and how forms, pages and programs speak.
FIELDS = "title,subtitle,description,abstract,summary,name,sample name,sample code,sample_code,sample id,code,material,composition,method,mass,weight,temperature,pressure,project,project name,operator,author,creator,contributor,date,location,keyword,keywords,affiliation,institution,unit,value,number,text,content,content here,contact,email,licence,comment,notes,id,version,language,publisher,your name,first name,last name".split(",")
SLOTS = "[{f}]|[insert {f} here]|[{f} here]|[your {f}]|[TODO: {f}]|[TBD: {f}]|[enter {f}]|[bitte {f} eintragen]|[{f} einfügen]|[à compléter : {f}]|[insérer {f}]|[insertar {f}]|[completar: {f}]|[[{f}]]|<{f}>|<your {f}>|<your {f} here>|<enter {f}>|<insert {f}>|<<{f}>>|‹{f}›|{{{{{f}}}}}|{{{{ {f} }}}}|{{{{ sample.{f} }}}}|{{{{ record.{f} }}}}|{{% {f} %}}|{{%{f}%}}|{{{f}}}|{{{f}_here}}|${{{f}}}|$({f})|#{{{f}}}|%{f}%|%({f})s|@@{f}@@|@{f}@|__{f}__|##{f}##|{f}_placeholder|your_{f}_here|{f}_here|xxx_{f}_xxx|??? {f} ???|???{f}???|*** {f} ***|>>{f}<<|~{f}~|[%{f}%]|&{f};|\\{f}\\".split("|")
FILLER = "lorem ipsum dolor sit amet, consectetur adipiscing elit|sed do eiusmod tempor incididunt ut labore et dolore magna aliqua|ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat|duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur|excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum|asdf asdf asdf|asdfasdf|asdfghjkl|asdfgh|jklö jklö|fghj fghj|qwertz qwertz|qwertzuiop|qwerty qwerty|qwertyuiop|azerty azerty|azertyuiop|yxcvbnm|zxcvbnm|hjkl hjkl|sdfg sdfg|dfgh dfgh|uiop uiop|wxcv wxcv|test test test|test text|testtext|blah blah blah|bla bla bla|xxx xxx xxx|xxxxxxxx|xx-xx-xx|todo todo|todo-todo-todo|tbd tbd|to do|to be done|to be defined|to be determined|to follow|foo bar baz|foobar|abc abc abc|abcdefg|dummy text|dummy text dummy text|sample text|sample text sample text|blindtext|blindtext blindtext|blindtext, blindtext|mustertext|beispieltext|platzhaltertext|platzhalter|texte de remplissage|texte factice|faux texte|texto de relleno|texto de prueba|texto de ejemplo|exemple de texte|placeholder text|placeholder|filler text|text goes here|text here|your text here|aaaa aaaa|123123|000 000 000|-- -- --|[object object]|undefined undefined|nan nan|null null|none none".split("|")
INSTRUCTIONS = "please enter the {f} of the sample|please enter the {f}|please enter a {f}|please describe the {f} here|please describe the sample in 0 to 0 sentences|describe the {f} here in a few words|describe the {f} here in one sentence|please fill in the {f}|please insert {f}|enter {f} here|enter your {f} here|enter the {f} in this box|insert {f} (at most 0 words)|insert {f} here|here goes the {f}|{f} goes here|{f} to follow|{f} to be added|add the {f} here|type your {f} in this box|type {f} here|write the {f} here|to be filled in by the submitter|to be filled in by the curator|to be filled in by the operator|to be completed by the author|click or tap here to enter text|click here to enter {f}|click here to add {f}|max. 0 characters|maximum 0 words|e.g. “my {f}” (delete this hint)|delete this hint|remove this line before submitting|replace this text with the {f}|replace this text|choose an item|select an option|required field|hier {f} eingeben (max. 0 zeichen)|hier {f} eintragen|bitte {f} ergänzen|bitte {f} eingeben|bitte hier {f} eintragen|bitte hier eine kurze beschreibung der probe eintragen|bitte ausfüllen|klicken sie hier, um text einzugeben|wird noch ergänzt|wird nachgereicht|beschreibung folgt|vom einreicher auszufüllen|diesen hinweis löschen|veuillez saisir {f}|veuillez saisir ici le résumé de l’échantillon|saisissez ici {f}|saisir {f} ici|entrez {f} ici|cliquez ici pour entrer du texte|à remplir par le déposant|à compléter|décrivez ici {f}|description à venir|introduzca aquí: {f}|introduzca {f}|escriba aquí {f}|escriba aquí la descripción de la muestra|haga clic aquí para escribir texto|rellene este campo|por completar|a rellenar por el remitente|descripción pendiente|indiquez ici : {f}|indiquez {f}|indique aquí: {f}|{f} folgt|n.n. - {f} folgt|n.n.|{f} wird nachgereicht|{f} à venir|{f} pendiente|the {f} should state what was done, in 0 lines|the {f} should contain at least 0 words|{f}: see instructions|state the {f} in 0 lines|give the {f} of the sample|provide a short {f} of the sample|geben sie hier {f} ein|angaben zu {f} hier eintragen|use this field for the {f}".split("|")
KEYBOARDS = ("qwertyuiop", "qwertzuiopü", "azertyuiop", "asdfghjkl", "asdfghjklö", "poiuztrewq", "yxcvbnm", "zxcvbnm", "wxcvbn", "1234567890")
THINGS = "page|site|website|server|repository server|catalogue|our catalogue|catalogue entry|catalogue page|record|record page|record browser|sample page|document|file|resource|requested page|requested resource|service|application|viewer|form|database|link|address".split("|")
FAILS = "could not be found|could not be loaded|could not be shown|could not be displayed|could not be completed|could not be opened|could not be reached|cannot be found|cannot be shown|cannot be displayed|was not found|is not available right now|is no longer available|is temporarily unavailable|is down for maintenance|is under construction|does not exist|does not work|did not respond|did not respond in time|has been moved or deleted|has been removed|has expired|requires javascript|needs javascript to work|needs javascript|needs a browser with scripts enabled|does not work without scripts|does not work without javascript|cannot be shown while scripting is turned off|requires scripts; your browser blocks them|requires you to log in".split("|")
ERRORS = "access denied|access to this resource was denied|permission denied|you don't have permission to access this resource|you are not authorized to view this page|please log in to continue|please sign in again|please sign in|log in to view this record|your session has expired|session timed out|session expired, please log in again|please try again later|please check the address|go back to the start page|return to the home page|reload the page|refresh the page|contact the administrator|error establishing a database connection|connection refused|connection timed out|connection reset by peer|gateway time-out: the server did not respond|the server encountered an internal error|something went wrong|an unexpected error occurred|an error occurred while processing your request|too many requests|service unavailable|request timeout|request id 0|error code 0|traceback (most recent call last): keyerror: 'title'|traceback (most recent call last): valueerror: invalid literal|nullpointerexception|java.lang.nullpointerexception|fatal error: uncaught exception|undefined index|syntax error near unexpected token|sqlstate[0]: general error|warning: undefined variable|exception in thread main|segmentation fault|please enable javascript|please enable javascript to view this page|you need to enable javascript to run this app|enable javascript and cookies to continue|enable scripts to continue|enable scripts|javascript is disabled in your browser|javascript is required|your browser does not support scripting|your browser does not support javascript|please change your browser settings|this page requires javascript|this page requires javascript. please enable it|checking your browser before accessing|verify you are human|please accept cookies|zugriff verweigert|bitte melden sie sich an|bitte erneut anmelden|die sitzung ist abgelaufen, bitte erneut anmelden|ihre sitzung ist abgelaufen|seite nicht gefunden|seite nicht gefunden (fehler 0)|fehler 0: der datensatz wurde nicht gefunden|fehler 0: die seite wurde nicht gefunden|die angeforderte seite existiert nicht (0)|der server antwortet nicht|der dienst ist nicht verfügbar|interner serverfehler|bitte versuchen sie es später erneut|bitte prüfen sie die adresse|diese seite benötigt javascript. bitte aktivieren|bitte aktivieren sie javascript, um diese seite anzuzeigen|skripte sind in ihrem browser deaktiviert|ohne aktivierte skripte kann dieser datensatz nicht angezeigt werden|ohne javascript kann diese seite nicht angezeigt werden|page introuvable : erreur 0|page introuvable|erreur 0 : cette page n’existe pas|erreur 0 : accès refusé|erreur interne du serveur|accès refusé|accès interdit|la session a expiré|votre session a expiré, veuillez vous reconnecter|veuillez vous connecter|service indisponible|veuillez réessayer plus tard|veuillez activer javascript pour continuer|javascript est désactivé dans votre navigateur|cette page nécessite l’activation des scripts|cette page nécessite javascript|error 0: la página solicitada no existe|página no encontrada|página no encontrada (error 0)|acceso denegado|servicio no disponible (0)|error interno del servidor|su sesión ha caducado|la sesión ha expirado, inicie sesión de nuevo|inicie sesión para continuar|inténtelo de nuevo más tarde|esta página requiere javascript|active javascript en su navegador para ver el contenido|su navegador no admite scripts o los tiene bloqueados|habilite javascript para continuar".split("|")

def _seeds() -> tuple[list[str], list[str]]:
    """Seed phrases of the template and filler model and of the error and script model."""
    fields = [*FIELDS, *(f.replace(" ", "_") for f in FIELDS if " " in f)]
    template = [s.format(f=f) for s, f in itertools.product(SLOTS, fields) for _ in range(3)] + [s.format(f=f) for s, f in itertools.product((s for s in INSTRUCTIONS if "{f}" in s), FIELDS)]
    template += 20 * [*FILLER, *(s for s in INSTRUCTIONS if "{f}" not in s)]
    # Keyboard text: runs along the rows of the usual layouts, one after another.
    runs = [row[k : k + n] for row in KEYBOARDS for n in (3, 4, 6) for k in range(0, len(row) - n + 1, 2)]
    runs += [r[::-1] for r in runs]
    template += [runs[k] + sep + runs[(k * 31 + j * 17) % len(runs)] + sep + runs[(k * 7 + j * 29) % len(runs)] for k in range(len(runs)) for j, sep in enumerate(("", "", " "))]
    words = re.findall(r"[a-z]+", " ".join(FILLER[:5]))
    template += [" ".join(words[(k * 7 + j * j) % len(words)] for j in range(6)) + "." for k in range(len(words))]
    error = [f"{a} {t} {p}." for a, t, p in itertools.product(("the", "this"), THINGS, FAILS)] + [f"our catalogue {p}." for p in FAILS]
    codes = [(s.value, s.phrase.lower()) for s in http.HTTPStatus if s.value >= 400]
    error += [x.format(c="0", p=p) for (c, p), x in itertools.product(codes, ("error {c}: {p}", "http {c} - {p}", "{c} {p}", "http status {c} – {p}", "http/1.1 {c} {p}", "error {c} ({p})", "http error {c}. {p}"))]
    error += 20 * ERRORS
    return template, error


def fold(text: str) -> str:
    """Lower case, one width, no invisible characters, runs of digits as one 0."""
    if not text.isascii():
        from lithoflow.llm.characters import CYRILLIC_LATIN

        text = unicodedata.normalize("NFKC", text)
        text = _INVISIBLE.sub("", text)
        if _LATIN.search(text):
            text = _MIXED.sub(lambda m: m.group().translate(str.maketrans(CYRILLIC_LATIN)) if _LATIN.search(m.group()) else m.group(), text)
    return _DIGITS.sub("0", " ".join(text.casefold().split()))


_DIGITS = re.compile(r"\d+")
_INVISIBLE = re.compile("[­​-‏⁠-⁤﻿]")
_LATIN = re.compile("[a-zA-Z]")
_MIXED = re.compile(r"[^\W\d_]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the n-grams that end at each character of the texts, one column per order, and the
    texts' begins. Each text is preceded by a separator, so no n-gram reaches over it."""
    joined = "\n" + "\n".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    out = np.zeros((ORDER, len(codes)), np.int64)
    h = np.zeros(len(codes), np.uint64)
    sep = codes == 10
    since = np.arange(len(codes)) - np.maximum.accumulate(np.where(sep, np.arange(len(codes)), 0))
    for k in range(ORDER):
        prior = np.zeros_like(codes)
        prior[k:] = codes[: len(codes) - k]
        prior[since < k] = 10
        h = (h ^ (prior + np.uint64(k + 1) * np.uint64(0x100000001))) * _STEP
        h ^= h >> np.uint64(29)
        z = h * np.uint64(0xBF58476D1CE4E5B9)
        out[k] = ((z >> np.uint64(32)) % np.uint64(CELLS)).astype(np.int64)
    return out, np.nonzero(sep)[0]


def _signs(texts: list[str]) -> np.ndarray:
    """Which characters of the joined texts, as grams() has them, are neither letter, digit nor blank."""
    return _sign_table()[np.frombuffer(("\n" + "\n".join(texts)).encode("utf-32-le", "replace"), np.uint32)]


@lru_cache(1)
def _sign_table() -> np.ndarray:
    return np.fromiter((not (c.isalnum() or c.isspace()) for c in map(chr, range(0x110000))), bool, 0x110000)


def _together(texts: list[str]) -> Iterator[list[str]]:
    """The texts in lists of about AT_ONCE characters."""
    lo, size = 0, 0
    for hi in range(len(texts)):
        size += len(texts[hi])
        if size > AT_ONCE or hi == len(texts) - 1:
            yield texts[lo : hi + 1]
            lo, size = hi + 1, 0


def count(texts: list[str], into: np.ndarray, one: np.ndarray | None = None) -> None:
    """Adds the texts' n-grams to ``into``, single characters to ``one`` where it is given."""
    for part in _together(texts):
        cells, _ = grams(part)
        into += np.bincount(cells[one is not None :].ravel(), minlength=CELLS).astype(into.dtype)
        if one is not None:
            one += np.bincount(cells[0], minlength=CELLS).astype(one.dtype)


class Model:
    """Interpolated n-gram model; an n-gram's context is its cell one character earlier."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts

    def logs(self, cells: np.ndarray) -> np.ndarray:
        n = cells.shape[1]
        p = np.full(n, 1 / 400.0, np.float32)
        for k in range(ORDER):
            num = self.counts[cells[k]]
            if k:
                den = np.zeros(n, np.float32)
                den[1:] = self.counts[cells[k - 1][:-1]]
            else:
                den = np.full(n, max(self.counts[cells[0]].max(initial=0), 1) * 12, np.float32)
            den = np.maximum(den, num)
            # What a context hasn't been followed by yet gets a share that falls with the root of its uses.
            novel = 2.0 + 0.7 * np.sqrt(den) if k else OPEN / (1 - OPEN) * den
            p = (num + novel * p) / (den + novel)
        return np.log(p)


def ratios(texts: list[str], models: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each character's log-likelihood ratio of residue against prose, and the texts' begins."""
    cells, begins = grams(texts)
    prose = Model(models[2]).logs(cells)
    template, error = Model(models[0]).logs(cells) - prose, Model(models[1]).logs(cells) - prose
    high = np.where(_signs(texts), SIGN_HIGH, HIGH)
    return np.clip(np.stack([template, error]), LOW, high) - DRIFT, begins


def windows(texts: list[str], models: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[float, float, float]]:
    """(ratio of the best window, share of the text that windows cover, share that a window of
    CERTAIN_RATIO covers of the words it touches, 0 without one) of each text."""
    if not texts:
        return []
    both, begins = ratios(texts, models)
    n = both.shape[1]
    best, local = np.zeros(len(texts)), np.zeros(len(texts))
    covered = np.zeros(n, bool)
    codes = np.frombuffer(("\n" + "\n".join(texts)).encode("utf-32-le", "replace"), np.uint32)
    blank = (codes == 10) | (codes == 32)
    solid = np.cumsum(~blank)
    edges = np.append(np.nonzero(blank)[0], n)
    for ratio in both.astype(np.float64):
        ratio[begins] = -1e4  # no window reaches over a separator
        total = np.cumsum(ratio)
        low = np.minimum.accumulate(total)
        gain = total - low
        best = np.maximum(best, np.maximum.reduceat(gain, begins))
        for end in np.nonzero((gain >= LEAST_RATIO) & (np.append(gain[1:], 0) < gain))[0]:
            start = np.searchsorted(-low[: end + 1], -low[end], "left")
            first, last = edges[np.searchsorted(edges, start + 1, "right") - 1], edges[np.searchsorted(edges, end)]
            words = (solid[end] - solid[start]) / max(solid[last - 1] - solid[first], 1)
            if words < WORD_COVERAGE:
                continue
            covered[start + 1 : end + 1] = True
            if gain[end] >= CERTAIN_RATIO:
                k = np.searchsorted(begins, end, "right") - 1
                local[k] = max(local[k], words)
    sizes = np.diff(np.append(begins, n)) - 1
    share = np.add.reduceat(covered.astype(np.float64), begins) / np.maximum(sizes, 1)
    return list(zip(best.tolist(), share.tolist(), local.tolist()))


@lru_cache(1)
def seed_counts() -> tuple[np.ndarray, np.ndarray]:
    """Counts of the template and the error seeds."""
    tables = [np.zeros(CELLS, np.float32) for _ in range(2)]
    for into, lines in zip(tables, _seeds()):
        count([fold(x) for x in lines], into)
    return tables[0], tables[1]


def fit(texts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the template, error and prose models. texts: (t), distinct folded texts."""
    sc = texts.sparkSession.sparkContext
    template, error = seed_counts()
    seeds = sc.broadcast((template, error))
    rows = texts.count()
    scale = np.float32(min(1.0, UNIT_ROWS / max(rows, 1)))

    def counts(prose, most: float) -> list[np.ndarray]:
        """Counts over the texts without a window of ``most``: of several characters, of single ones."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = [np.zeros(CELLS, np.int64) for _ in range(2)]
            for batch in batches:
                for part in _together(batch.column(0).to_pylist()):
                    if prose is not None:
                        part = [t for t, m in zip(part, windows(part, (*seeds.value, prose.value))) if m[0] < most]
                    if part:
                        count(part, *tables)
            for kind, table in enumerate(tables):
                cells = np.nonzero(table)[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), kind, np.int32)), pa.array(cells.astype(np.int32)), pa.array(table[cells])], names=["kind", "cell", "n"])

        table = materialise(texts.select("t").mapInArrow(run, "kind int, cell int, n bigint").groupBy("kind", "cell").agg(F.sum("n").cast("float").alias("n")))
        summed = table.toArrow()
        drop(table)
        out = [np.zeros(CELLS, np.float32) for _ in range(2)]
        kinds, cells, n = (summed.column(c).to_numpy() for c in range(3))
        for kind, table in enumerate(out):
            table[cells[kinds == kind]] = n[kinds == kind]
        return out

    shared = template + error > 0
    clean = lambda several, one, rare: scale * one + np.rint(scale * np.maximum(several - rare * rows * shared, 0)).astype(np.float32)
    prose = clean(*counts(None, 0.0), RARE[0])
    for most in CLEAN_RATIOS:
        prose = clean(*counts(sc.broadcast(prose), most), RARE[1])
    return template, error, prose


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([fold(t) for t in batch.column(0).to_pylist()], pa.string())], names=["t"])


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(t): every distinct folded text of the rows (.., text), whole, each once; in few parts, as each
    makes a table of counts."""
    parts = min(max(2, rows.sparkSession.sparkContext.defaultParallelism), 64)
    return spread(rows.select("text")).mapInArrow(_folded, "t string").where("t <> ''").repartition(parts, "t").distinct()


def sample(df: DataFrame, text: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(t): at most ``rows`` distinct folded texts, those of the smallest hash: a bounded sample for
    trials with fit(); find() fits on all texts. However often a text is repeated, it takes one place. Texts of more than
    SAMPLE_CHARS characters are sampled by a stretch of that length, at a place that their hash tells. Only hashes
    are shuffled to find the sample's bound."""

    plain = F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(F.col(text).cast("string"), r"\s+", " ")), r"\d+", "0"), "[\u00ad\u200b-\u200f\ufeff]", ""))
    part = df.where(F.col(text).isNotNull()).select(plain.alias("t")).where("t <> ''").select("t", F.xxhash64("t").alias("h"))
    bound = part.select("h").distinct().orderBy("h").limit(rows).agg(F.max("h")).first()[0]
    start = F.pmod(F.col("h"), F.greatest(F.length("t") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    chosen = part.where(F.col("h") <= F.lit(bound)).dropDuplicates(["h"]) if bound is not None else part.limit(0)
    return chosen.select(F.substring("t", start, F.lit(SAMPLE_CHARS)).alias("t")).mapInArrow(_folded, "t string").where("t <> ''").distinct()


def find(sources: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(source_table, row_id, ratio, coverage, word_coverage) of the rows that hold residue.

    ``sources``: (name, table, key column, text column).
    """
    rows = None
    for name, df, key, text in sources:
        part = df.select(F.lit(name).alias("source_table"), F.col(key).cast("bigint").alias("row_id"), F.col(text).cast("string").alias("text")).where(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"))
        rows = part if rows is None else rows.unionByName(part)
    spark = rows.sparkSession
    texts = materialise(distinct_texts(rows))
    models = fit(texts)
    drop(texts)
    shared = spark.sparkContext.broadcast(models)  # 3 x CELLS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            marks = [m for part in _together(texts) for m in windows([fold(t) for t in part], shared.value)]
            found = list(zip(*marks)) or [(), (), ()]
            scored = pa.table([batch.column(0), batch.column(1), *(pa.array(c, pa.float64()) for c in found)], names=["source_table", "row_id", "ratio", "coverage", "word_coverage"])
            yield from scored.to_batches()

    scored = spread(rows).mapInArrow(run, "source_table string, row_id bigint, ratio double, coverage double, word_coverage double")
    found = scored.where((F.col("word_coverage") >= WORD_COVERAGE) | (F.col("ratio") >= LEAST_RATIO) & (F.col("coverage") >= LEAST_COVERAGE))
    return found.dropDuplicates(["source_table", "row_id"])  # rows repeated with the same key
