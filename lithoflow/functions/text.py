"""Text functions, Column to Column, evaluated in the JVM.

Null in gives null out unless a function says otherwise; where the model treats missing text as empty,
the operators coalesce first. ``SPACE`` is white space as Unicode has it, not only ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lithoflow import policy as P

SPACE = r"(?U)[\s\x1c-\x1f]+"
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f uses it, also inside lambdas."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def contains(haystack: Column, needle: Column) -> Column:
    return F.instr(haystack, needle) > 0


def norm0(text: Column) -> Column:
    """All white space removed, lower case: the form in which texts are compared literally."""
    return F.lower(F.regexp_replace(text, SPACE, ""))


def strip_script(text: Column) -> Column:
    return F.regexp_replace(text, P.SCRIPT_TAG, "")


def plain_source(text: Column) -> Column:
    return norm0(strip_script(text))


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def norm(text: Column) -> Column:
    """Comparison form of scoring for text in NFKC (see functions.python.nfkc); null gives ""."""
    return F.lower(squeeze(strip_script(F.coalesce(text, F.lit("")))))


def flat(text: Column) -> Column:
    """norm() without white space and punctuation."""
    return F.regexp_replace(norm(text), r"(?U)[\s.,;:()\[\]{}_\-–/'’\"]", "")


def words(text: Column) -> Column:
    return extract_all(F.lower(strip_script(text)), WORD)


def shingles(tokens: Column, n: int = P.SHINGLE) -> Column:
    """Distinct runs of n words, joined by blanks; none if there are fewer."""
    runs = lambda ts: F.when(F.size(ts) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(ts) - (n - 1)), lambda i: F.array_join(F.slice(ts, i, n), " ")))).otherwise(F.array().cast("array<string>"))
    return let(tokens, runs)


def identifiers(text: Column) -> Column:
    """Distinct ORCIDs in upper and DOIs in lower case, the latter without trailing punctuation."""
    dois = F.transform(extract_all(text, P.DOI), lambda d: F.lower(F.regexp_replace(d, r"[.,;:)\]}>]+$", "")))
    return F.array_distinct(F.concat(F.transform(extract_all(text, P.ORCID), F.upper), dois))


def numbers(text: Column) -> Column:
    """Distinct numbers as written, with a point: "1.0" is not "1"."""
    return F.array_distinct(F.transform(extract_all(strip_script(text), P.NUMBER), lambda x: F.replace(x, F.lit(","), F.lit("."))))


def numeric(text: Column) -> Column:
    """Distinct numbers as DOUBLE: 1.0 is 1."""
    return F.array_distinct(F.transform(numbers(norm(text)), lambda x: x.cast("double")))


def bare_host(value: Column) -> Column:
    """An identifier without its resolver's address."""
    return norm(F.regexp_replace(F.coalesce(value, F.lit("")), r"^https?://[^/]+/(?:sample/)?", ""))


def is_placeholder(value: Column) -> Column:
    return contains(F.coalesce(value, F.lit("")), F.lit(P.PLACEHOLDER))


def date_forms(iso: Column) -> Column:
    """Ways in which texts write an ISO date; for other values only the value."""
    y, m, d = (F.regexp_extract(iso, r"\A(\d{4})-(\d{2})-(\d{2})\z", g) for g in (1, 2, 3))
    month = F.element_at(F.array(*map(F.lit, P.MONTH_NAMES)), m.cast("int"))
    day = d.cast("int").cast("string")
    forms = F.array(iso, F.concat(d, F.lit("."), m, F.lit("."), y), F.concat(day, F.lit("."), m.cast("int").cast("string"), F.lit("."), y), F.concat_ws(" ", day, month, y), F.concat(month, F.lit(" "), day, F.lit(", "), y), F.concat(day, F.lit(". "), month, F.lit(" "), y), F.concat_ws("/", d, m, y))
    return F.when(iso.rlike(r"\A\d{4}-(0[1-9]|1[0-2])-\d{2}\z"), forms).otherwise(F.array(iso))


def iso_date(value: Column) -> Column:
    """Unambiguous notations of a date as ISO 8601; null where there is no safe reading."""
    v = F.trim(value)
    number = r"\A(\d{1,2})\.\s?(\d{1,2})\.\s?(\d{4})\z"
    day_first, month_first = r"\A(\d{1,2})\.?\s+([A-Za-zä]+)\.?\s+(\d{4})\z", r"\A([A-Za-zä]+)\.?\s+(\d{1,2}),?\s+(\d{4})\z"

    def month(name: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, n in P.MONTH_NUMBERS.items():
            out = F.when(F.substring(F.lower(name), 1, 3) == k, F.lit(str(n))).otherwise(out)
        return out

    def date(y: Column, m: Column, d: Column) -> Column:
        return F.date_format(F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"), "yyyy-MM-dd")

    g = lambda p, k: F.regexp_extract(v, p, k)
    return (
        F.when(v.rlike(r"\A\d{4}(-\d{2}(-\d{2})?)?(/\d{4}(-\d{2}(-\d{2})?)?)?\z"), v)
        .when(v.rlike(number), date(g(number, 3), g(number, 2), g(number, 1)))
        .when(v.rlike(day_first) & month(g(day_first, 2)).isNotNull(), date(g(day_first, 3), month(g(day_first, 2)), g(day_first, 1)))
        .when(v.rlike(month_first) & month(g(month_first, 1)).isNotNull(), date(g(month_first, 3), month(g(month_first, 1)), g(month_first, 2)))
    )


def strip_titles(value: Column) -> Column:
    """A name without academic titles."""
    return F.btrim(F.regexp_replace(F.regexp_replace(value, P.ACADEMIC_TITLE, ""), SPACE, " "), F.lit(" ,"))


def sub_super(value: Column) -> Column:
    """<sub> and <sup> as Unicode characters; where one has none, the text stays and the tags go."""
    def convert(text: Column, tag: str, signs: str) -> Column:
        inner = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)))
        small = lambda x: F.when(F.translate(x, P.SCRIPTED, "").rlike(r"[\p{L}\p{N}]"), x).otherwise(F.translate(x, P.SCRIPTED, signs))
        return F.aggregate(inner, text, lambda a, x: F.replace(a, F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>")), small(x)))

    return let(convert(value, "sub", P.SUBSCRIPTS), lambda v: convert(v, "sup", P.SUPERSCRIPTS))


def contributor_type(role: Column) -> Column:
    """The type that a role's wording tells; null if it tells none."""
    r = F.lower(F.trim(role))
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(P.ROLE_TYPES):
        out = F.when(r.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def bare_doi(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, P.DOI_PREFIX, ""))


def publication_year(text: Column, default: int) -> Column:
    """The year stated after the additional-information marker, else ``default``."""
    at = F.instr(text, F.lit(P.ADDITIONAL_INFORMATION))
    rest = F.when(at > 0, F.substring(text, at + len(P.ADDITIONAL_INFORMATION), F.length(text)))
    return F.coalesce(F.nullif(F.regexp_extract(rest, P.PUBLICATION_YEAR, 1), F.lit("")), F.lit(str(default)))


def safe_name(text: Column, limit: int = 60) -> Column:
    return F.left(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N} _.\-]", "")), F.lit(limit))


def format_time(seconds: Column) -> Column:
    """0.25s, 3m 7s, 2h 5m."""
    s = F.floor(seconds)
    return (
        F.when(seconds < 60, F.format_string("%.2fs", seconds.cast("double")))
        .when(seconds < 3600, F.format_string("%dm %ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%dh %dm", F.floor(s / 3600), F.floor(s / 60) % 60))
    )


def loop_reason(text: Column) -> Column:
    """Why generated text is taken to run in circles; null if it isn't."""
    times = lambda p: F.greatest(F.lit(4), F.ceil(F.lit(P.LOOP_CHARS) / p).cast("int"))

    def reason(tail: Column) -> Column:
        blank = (F.length(tail) >= P.LOOP_BLANK) & F.right(tail, F.lit(P.LOOP_BLANK)).rlike(r"(?U)\A[\s\x1c-\x1f]*\z")
        # The last characters must stand one period earlier too: that rules out most periods at once.
        could = lambda p: (F.length(tail) >= p * times(p)) & (F.right(tail, F.lit(8)) == F.substring(tail, F.length(tail) - 7 - p, F.lit(8)))
        periods = F.filter(F.filter(F.sequence(F.lit(P.LOOP_PERIODS[0]), F.lit(P.LOOP_PERIODS[1])), could), lambda p: F.right(tail, p * times(p)) == F.repeat(F.right(tail, p), times(p)))
        shortest = let(F.array_min(periods), lambda p: F.when(p.isNotNull(), F.concat(F.lit("repeats: "), F.left(F.right(tail, p), F.lit(P.LOOP_SHOWN)))))
        return F.when(blank, F.lit("endless whitespace")).otherwise(shortest)

    return let(F.right(text, F.lit(P.LOOP_TAIL)), reason)


def markdown_table(rows: Column) -> Column:
    """ARRAY<ARRAY<STRING>> as a Markdown table, the first row being the header; "" if all is blank."""
    cell = lambda c: F.trim(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" <br> ")))
    cells = F.filter(F.transform(rows, lambda r: F.transform(r, cell)), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(cells, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    lines = F.transform(cells, line)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    return F.when(F.size(cells) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n")).otherwise(F.lit(""))


def roman(n: Column) -> Column:
    """Roman numeral of 1 or more; M is repeated for the thousands."""
    digit = lambda one, five, ten: F.array(*map(F.lit, ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]))
    at = lambda k: (F.floor(n / k) % 10 + 1).cast("int")
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), F.element_at(digit("C", "D", "M"), at(100)), F.element_at(digit("X", "L", "C"), at(10)), F.element_at(digit("I", "V", "X"), at(1)))


def letter(n: Column) -> Column:
    return F.chr(F.lit(97) + (n - 1) % 26)


def tokens_with_dots(text: Column) -> Column:
    """Lower-case words with inner dots."""
    raw = F.transform(extract_all(strip_script(text), r"[\p{L}\p{N}_.]+"), lambda w: F.lower(F.btrim(w, F.lit("."))))
    return F.array_distinct(raw)


def tokens_in_source(text: Column, source_tokens: Column) -> Column:
    """All words of text that have a digit or four letters stand in the source; true if there are none."""
    needed = F.filter(tokens_with_dots(text), lambda w: w.rlike(r"\p{Nd}") | (F.length(w) >= 4))
    return F.size(F.array_except(needed, source_tokens)) == 0


def occurrences(text: Column, name: Column) -> Column:
    """0-based places at which ``name`` stands in ``text``, not overlapping; empty for an empty name."""
    def starts(parts: Column) -> Column:
        # Running lengths of the parts, one pass.
        ends = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")), lambda a, x: F.struct((a["at"] + F.length(x) + F.length(name)).alias("at"), F.array_append(a["found"], a["at"] + F.length(x)).alias("found")))["found"]
        return F.slice(ends, F.lit(1), F.size(parts) - 1)

    split = F.split(text, F.concat(F.lit("\\Q"), name, F.lit("\\E")), -1)
    return F.when(F.length(name) > 0, let(split, starts)).otherwise(F.array().cast("array<int>"))


def near_name(text: Column, name: Column, role: Column, window: int = P.ROLE_WINDOW) -> Column:
    """The role stands within ``window`` characters of the name somewhere in the text."""
    def near(t: Column) -> Column:
        n, r = F.lower(F.trim(name)), F.lower(F.trim(role))
        around = lambda s: F.substring(t, F.greatest(s - window, F.lit(0)) + 1, s + F.length(n) + window - F.greatest(s - window, F.lit(0)))
        # A role that stands nowhere needs no windows.
        return (F.length(r) > 0) & contains(t, r) & F.exists(occurrences(t, n), lambda s: contains(around(s), r))

    return F.coalesce(let(F.lower(F.regexp_replace(strip_script(text), SPACE, " ")), near), F.lit(False))
