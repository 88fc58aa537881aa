"""Checks that extracted values are copied from their document, and the changes this makes.

Inputs are wide rows: one per document with the text and the extraction (schemas.EXTRACTION). All
steps but the recovery of identifiers are column expressions within the row, so nothing is shuffled.
Null and missing values count as empty; a document without extraction keeps a null one.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoflow import policy as P
from lithoflow.functions import text as X


def prepare(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document what the checks need, computed once: compared form, tokens, word runs, numbers."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(key, F.col(text).alias("text"), X.norm0(t).alias("norm0"), X.plain_source(t).alias("haystack"), X.tokens_with_dots(t).alias("tokens"), X.shingles(X.words(t)).alias("shingles"), X.numbers(t).alias("numbers"))


#: Rows of a document that stand beside its text in one row of beside().
BESIDE = 200


def beside(children: DataFrame, docs: DataFrame, key: str = "doc_id", most: int = BESIDE) -> DataFrame:
    """docs with ``items``, their rows of ``children`` as structs, about ``most`` a row.

    A text travels once for so many children instead of once for each; a document that holds a great
    share of all children is spread over many rows. Documents without children are left out.
    """
    columns = [c for c in children.columns if c != key]
    chunks = children.groupBy(key).agg(F.ceil(F.count("*") / most).alias("chunks"))
    items = children.join(chunks, key).groupBy(key, F.pmod(F.xxhash64(*columns), F.col("chunks")).alias("chunk")).agg(F.collect_list(F.struct(*columns)).alias("items"))
    return items.drop("chunk").join(docs, key)


def copied_ratio(text: Column, source: Column, source_shingles: Column) -> Column:
    """Share of the text's four-word runs that stand in the source; for shorter texts 1 or 0 by containment."""
    mine = X.shingles(X.words(text))
    return F.when(F.size(mine) > 0, F.size(F.array_intersect(mine, source_shingles)) / F.size(mine)).otherwise(X.contains(X.norm0(source), X.norm0(text)).cast("double"))


def is_copied(text: Column, source: Column, haystack: Column, source_shingles: Column) -> Column:
    key = X.plain_source(F.coalesce(text, F.lit("")))
    return (key == "") | X.contains(haystack, key) | (copied_ratio(F.coalesce(text, F.lit("")), source, source_shingles) >= P.LEAST_COPIED)


def copy_ratios(docs: DataFrame, passages: DataFrame, least: float = P.LEAST_COPIED, doc_key: str = "doc_id", key: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_key, key, ratio): passages of which at least ``least`` of the four-word runs stand in the document.

    An equi-join on the runs' hashes of 64 bits, so no run travels as text; of a document only the runs that
    some passage has get beyond the join. Passages of fewer than four words have no runs and are left out.
    """
    runs = lambda df, k: df.select(k, F.explode(X.shingles(X.words(F.coalesce(F.col(text), F.lit(""))))).alias("run")).select(k, F.xxhash64("run").alias("run"))
    mine = runs(passages, key)
    hit = runs(docs, doc_key).join(mine, "run").groupBy(doc_key, key).agg(F.count("*").alias("n"))
    sizes = mine.groupBy(key).agg(F.count("*").alias("total"))
    return hit.join(sizes, key).select(doc_key, key, (F.col("n") / F.col("total")).alias("ratio")).where(F.col("ratio") >= least)


def keep_subjects(subjects: Column, ok) -> Column:
    """Non-blank keywords that pass, as bare subjects."""
    values = F.filter(F.transform(F.coalesce(subjects, F.array()), lambda s: F.trim(F.coalesce(s["subject"], F.lit("")))), lambda v: v != "")
    return F.filter(values, ok)


def code_from_title(title: Column, code: Column) -> Column:
    """The sample code, where a title's last bracket holds a better one; none where it is a title."""
    code = F.trim(F.coalesce(code, F.lit("")))
    title = F.coalesce(title, F.lit(""))
    code = F.when((F.size(F.split(F.trim(code), r"\s+")) > 3) | (F.length(code) > 40), F.lit("")).otherwise(code)
    found = F.trim(F.regexp_extract(title, P.TITLE_CODE, 1))
    like = (found != "") & (F.size(F.split(found, r"\s+")) <= 2) & found.rlike(r"[\p{Nd}_]|[A-Z]{2,}")
    better = like & (X.norm0(found) != X.norm0(code)) & ((code == "") | ~X.contains(X.norm0(title), X.norm0(code)))
    return F.when(better, found).otherwise(code)


def recover(people: list[dict], text: str) -> list[tuple[int, str]]:
    """(person, ORCID) for people without an identifier whose name is followed by one nobody has yet.

    The places of all names and identifiers are listed once, in order; what follows a name reaches to the
    next place of another name, P.ROLE_WINDOW characters at most.
    """
    plain = re.sub(r"\s+", " ", re.sub(P.SCRIPT_TAG, "", text))
    low = plain.lower()
    names = [((p.get("familyName") or (p.get("name") or "").split(",")[0]) or "").strip() for p in people]
    ids = [(m.start(), m[1]) for m in re.finditer(f"(?=({P.ORCID}))", plain)]
    starts = [at for at, _ in ids]
    places = {n: [m.start() for m in re.finditer(f"(?={re.escape(n.lower())})", low)] for n in set(names) if n}
    taken = {m[0] for p in people for i in p.get("nameIdentifiers") or [] if (m := re.search(P.ORCID, (i or {}).get("nameIdentifier") or ""))}
    found = []
    for k, (person, name) in enumerate(zip(people, names)):
        if person.get("nameIdentifiers") or not name:
            continue
        others = sorted(at for n, ats in places.items() if n != name for at in ats)
        after = -1
        for at in places[name]:
            if at < after:
                continue  # within the place before
            after = at + len(name)
            n = bisect_left(others, after)
            limit = min(after + P.ROLE_WINDOW, others[n] if n < len(others) else len(plain))
            k_id = bisect_left(starts, after)
            if k_id < len(ids) and ids[k_id][0] + len(ids[k_id][1]) <= limit and ids[k_id][1] not in taken:
                taken.add(ids[k_id][1])
                found.append((k, ids[k_id][1]))
                break
    return found


def recovered_orcids(df: DataFrame, key: str = "doc_id", people: str = "people", text: str = "text") -> DataFrame:
    """(key, person_idx, orcid). ``people``: ARRAY<STRUCT<name, familyName, nameIdentifiers>> in order.

    The identifiers in use are carried from person to person, so a document is handled as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, o) for k, p, t in zip(*(batch.column(c).to_pylist() for c in range(3))) for i, o in recover([x or {} for x in p or []], t or "")]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=[key, "person_idx", "orcid"])

    return df.select(F.col(key).cast("bigint"), F.col(people), F.col(text)).mapInArrow(run, f"`{key}` bigint, person_idx int, orcid string")


def verify(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text, extraction, changes): the extraction without what isn't in the document.

    df: (key, text, extraction). ``changes`` lists messages in the order of the steps.
    """
    df = df.select(key, F.coalesce("text", F.lit("")).alias("text"), "extraction")
    people = F.coalesce(F.col("extraction.shared.creators"), F.array())
    given = recovered_orcids(df.select(key, people.alias("people"), "text"), key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("person_idx", "orcid"))).alias("given"))
    df = df.join(given, key, "left").withColumns({"haystack": X.plain_source(F.col("text")), "tokens": X.tokens_with_dots(F.col("text")), "shingles": X.shingles(X.words(F.col("text")))})
    copied = lambda v: is_copied(v, F.col("text"), F.col("haystack"), F.col("shingles"))
    written = lambda v: copied(v) | X.tokens_in_source(v, F.col("tokens"))
    shown = lambda v: F.concat(F.lit("'"), v, F.lit("'"))

    def person(p: Column, i: Column) -> Column:
        orcid = F.try_element_at(F.col("given"), i)
        new = F.array(F.struct(F.concat(F.lit("https://orcid.org/"), orcid).alias("nameIdentifier"), F.lit("ORCID").alias("nameIdentifierScheme"), F.lit("https://orcid.org/").alias("schemeURI")))
        family = F.coalesce(F.nullif(p["familyName"], F.lit("")), F.split(F.coalesce(p["name"], F.lit("")), ",")[0])
        role = F.trim(F.coalesce(p["role"], F.lit("")))
        fields = {"name": p["name"], "givenName": p["givenName"], "familyName": p["familyName"], "role": F.when((role != "") & ~X.near_name(F.col("text"), family, role), F.lit("")).otherwise(p["role"]), "nameIdentifiers": F.when(orcid.isNotNull(), new).otherwise(p["nameIdentifiers"]), "affiliation": p["affiliation"]}
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    def subject(v: Column) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(v.alias("subject"), *[none.alias(c) for c in ("lang", "subjectScheme", "schemeURI", "valueURI")])

    shared, samples = F.col("extraction.shared"), F.coalesce(F.col("extraction.samples"), F.array())
    keep = lambda v: F.when(F.coalesce(v, F.lit("")) == "", v).when(copied(v), v).otherwise(F.lit(""))
    fact_value = lambda f: F.when(F.instr(f, ":") > 0, F.substring(f, F.instr(f, ":") + 1, F.length(f))).otherwise(f)
    sample = lambda s: F.struct(
        code_from_title(keep(s["givenTitle"]), s["sampleCode"]).alias("sampleCode"), keep(s["givenTitle"]).alias("givenTitle"), keep(s["givenDescription"]).alias("givenDescription"),
        F.filter(F.coalesce(s["facts"], F.array()), lambda f: written(fact_value(f))).alias("facts"), F.transform(keep_subjects(s["subjects"], written), subject).alias("subjects"), s["dates"].alias("dates"), s["relatedIdentifiers"].alias("relatedIdentifiers"),
    )
    new_people = F.transform(people, person)
    new_shared = F.struct(new_people.alias("creators"), keep(shared["preparation"]).alias("preparation"), F.transform(keep_subjects(shared["subjects"], written), subject).alias("subjects"), shared["dates"].alias("dates"), shared["relatedIdentifiers"].alias("relatedIdentifiers"))

    dropped = lambda subjects, where: F.transform(keep_subjects(subjects, lambda v: ~written(v)), lambda v: F.concat(where, F.lit(": dropped keyword "), shown(v), F.lit(": the document lacks it")))
    named = lambda p: F.coalesce(p["name"], F.lit(""))
    added = F.transform(F.filter(F.transform(people, lambda p, i: F.struct(named(p).alias("n"), F.try_element_at(F.col("given"), i).alias("o"))), lambda x: x["o"].isNotNull()), lambda x: F.concat(F.lit("added ORCID "), x["o"], F.lit(" for "), x["n"], F.lit(", which stands beside the name")))
    roles = F.transform(F.filter(F.zip_with(people, new_people, lambda a, b: F.struct(named(a).alias("n"), F.trim(F.coalesce(a["role"], F.lit(""))).alias("r"), F.coalesce(b["role"], F.lit("")).alias("q"))), lambda x: (x["r"] != "") & (x["q"] == "")), lambda x: F.concat(F.lit("dropped role "), shown(x["r"]), F.lit(" of "), x["n"], F.lit(", which stands nowhere near the name")))
    lost = lambda v: (F.coalesce(v, F.lit("")) != "") & ~copied(v)
    some = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    of_sample = lambda s, i: (lambda where: F.concat(
        some(*[F.when(lost(s[f]), F.concat(where, F.lit(f": dropped {f}: no copy from the document"))) for f in ("givenTitle", "givenDescription")]),
        F.transform(F.filter(F.coalesce(s["facts"], F.array()), lambda f: ~written(fact_value(f))), lambda f: F.concat(where, F.lit(": dropped fact "), shown(f), F.lit(": the document lacks it"))),
        dropped(s["subjects"], where),
        some(F.when(code_from_title(keep(s["givenTitle"]), s["sampleCode"]) != F.trim(F.coalesce(s["sampleCode"], F.lit(""))), F.concat(where, F.lit(": sample code "), shown(F.trim(F.coalesce(s["sampleCode"], F.lit("")))), F.lit(" became "), shown(code_from_title(keep(s["givenTitle"]), s["sampleCode"]))))),
    ))(F.concat(F.lit("sample "), (i + 1).cast("string")))
    changes = F.concat(added, roles, some(F.when(lost(shared["preparation"]), F.lit("dropped the shared preparation: no copy from the document"))), dropped(shared["subjects"], F.lit("shared")), F.flatten(F.transform(samples, of_sample)))
    out = F.when(F.col("extraction").isNotNull(), F.struct(new_shared.alias("shared"), F.transform(samples, sample).alias("samples")))
    return df.select(key, "text", out.alias("extraction"), F.coalesce(changes, F.array()).cast("array<string>").alias("changes"))
