"""Records from verified extractions: one nested record per sample, under schemas.RECORD.

Everything is a column expression over the document's row until the samples are exploded. Where the
order of values matters it is that of the source; of repeated values the first stays. Documents whose
values break a vocabulary come out in ``rejected`` rather than in ``records``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoflow import policy as P
from lithoflow import schemas as S
from lithoflow.functions import text as X


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def listed(c: Column) -> Column:
    return F.coalesce(c, F.array())


def first_wins(items: Column, key) -> Column:
    """Items without those whose key an earlier one has; order kept."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def verified_orcids(ids: Column, norm0: Column) -> Column:
    """Identifiers that are ORCIDs and stand in the source, in canonical form."""
    orcids = F.transform(listed(ids), lambda i: F.regexp_extract(empty(i["nameIdentifier"]), P.ORCID, 0))
    kept = F.filter(orcids, lambda o: (o != "") & X.contains(norm0, X.norm0(o)))
    return F.transform(kept, lambda o: F.struct(F.concat(F.lit("https://orcid.org/"), o).alias("nameIdentifier"), F.lit("ORCID").alias("nameIdentifierScheme"), F.lit("https://orcid.org/").alias("schemeURI")))


def person(p: Column, norm0: Column) -> Column:
    """A person as the record has it: no titles, "Family, Given", verified identifiers."""
    given, family = X.strip_titles(p["givenName"]), X.strip_titles(p["familyName"])
    name = F.when((empty(given) != "") & (empty(family) != ""), F.concat(family, F.lit(", "), given)).otherwise(X.strip_titles(p["name"]))
    none = F.lit(None).cast("string")
    affiliation = F.transform(F.filter(listed(p["affiliation"]), lambda a: empty(a["name"]) != ""), lambda a: F.struct(a["name"].alias("name"), none.alias("affiliationIdentifier"), none.alias("affiliationIdentifierScheme"), none.alias("schemeURI")))
    return F.struct(name.alias("name"), F.lit("Personal").alias("nameType"), given.alias("givenName"), family.alias("familyName"), verified_orcids(p["nameIdentifiers"], norm0).alias("nameIdentifiers"), affiliation.alias("affiliation"))


def converted_dates(dates: Column) -> Column:
    """Dates with a year, in ISO form where there is a safe reading."""
    dated = F.filter(listed(dates), lambda d: empty(d["date"]).rlike(r"\d{4}"))
    return F.transform(dated, lambda d: F.struct(F.coalesce(X.iso_date(d["date"]), d["date"]).alias("date"), d["dateType"].alias("dateType"), d["dateInformation"].alias("dateInformation")))


def merged_dates(dates: Column) -> Column:
    """Without repeats by date and type, sorted by date; equal dates keep their order."""
    unique = first_wins(dates, lambda d: F.struct(d["date"], d["dateType"]))
    return F.transform(F.array_sort(F.transform(unique, lambda d, i: F.struct(d["date"].alias("k"), i.alias("i"), d.alias("d")))), lambda x: x["d"])


def related(items: Column) -> Column:
    """Related identifiers, DOIs without their resolver's address."""
    return F.transform(listed(items), lambda r: F.struct(F.when(r["relatedIdentifierType"] == "DOI", X.bare_doi(empty(r["relatedIdentifier"]))).otherwise(r["relatedIdentifier"]).alias("relatedIdentifier"), *[r[c].alias(c) for c in ("relatedIdentifierType", "relationType", "resourceTypeGeneral")]))


def fallback(sample: Column, preparation: Column) -> tuple[Column, Column]:
    """Title and abstract out of copied text."""
    facts = F.transform(F.filter(listed(sample["facts"]), lambda f: F.trim(f) != ""), lambda f: F.regexp_replace(F.trim(f), r"\.+$", ""))
    first = F.coalesce(F.regexp_replace(F.get(facts, F.lit(0)), r"^[^:]{1,40}:\s*", ""), F.lit(""))
    filled = lambda c: F.nullif(F.trim(empty(c)), F.lit(""))
    title = F.coalesce(filled(sample["givenTitle"]), F.nullif(first, F.lit("")), F.trim(empty(sample["sampleCode"])))
    told = F.when(F.size(facts) > 0, F.concat(F.array_join(facts, "; "), F.lit(".")))
    return title, F.coalesce(filled(sample["givenDescription"]), F.concat_ws(" ", told, filled(preparation)))


def titles(title: Column, code: Column, norm0: Column, lang: str) -> Column:
    code = F.trim(empty(code))
    one = lambda v, kind: F.struct(v.alias("title"), F.lit(kind).cast("string").alias("titleType"), F.lit(lang).alias("lang"))
    alternative = (code != "") & (X.norm0(code) != X.norm0(title)) & X.contains(norm0, X.norm0(code))
    return F.filter(F.array(F.when(title != "", one(title, None)), F.when(alternative, one(code, "AlternativeTitle"))), lambda t: t.isNotNull())


def invalid(record: Column) -> Column:
    """Names of the vocabularies that a record breaks; empty if it is valid."""
    outside = lambda items, f, allowed: F.exists(listed(items), lambda x: x[f].isNotNull() & ~x[f].isin(*allowed))
    missing = lambda items, f: F.exists(listed(items), lambda x: x[f].isNull())
    tests = {
        "dateType": outside(record["dates"], "dateType", S.DATE_TYPES) | missing(record["dates"], "dateType"),
        "relatedIdentifierType": outside(record["relatedIdentifiers"], "relatedIdentifierType", S.RELATED_IDENTIFIER_TYPES),
        "relationType": outside(record["relatedIdentifiers"], "relationType", S.RELATION_TYPES),
        "resourceTypeGeneral": outside(record["relatedIdentifiers"], "resourceTypeGeneral", S.RESOURCE_TYPES),
        "contributorType": outside(record["contributors"], "contributorType", S.CONTRIBUTOR_TYPES),
        "titleType": outside(record["titles"], "titleType", S.TITLE_TYPES),
        "descriptionType": outside(record["descriptions"], "descriptionType", S.DESCRIPTION_TYPES),
        "nameType": outside(record["creators"], "nameType", S.NAME_TYPES) | missing(record["creators"], "name"),
    }
    return F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())


def plain_record(record: Column) -> Column:
    """The record with sub- and superscripts as Unicode in every text."""
    return F.from_json(X.sub_super(F.to_json(record)), S.RECORD)


def build(verified: DataFrame, texts: DataFrame | None = None, policy: P.Policy | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, rejected, changes) of verified extractions (key, text, extraction).

    ``texts``: (key, sample_idx, written STRUCT<title, abstract, keywords, issues>), the second
    answer of the model, joined by position; samples without one fall back on copied text.
    records: (key, sample_idx, record); rejected: (key, problems); changes: (key, sample_idx, seq, message).
    """
    policy = policy or P.Policy()
    lit = F.lit
    d = verified.select(key, F.coalesce("text", lit("")).alias("text"), "extraction").where(F.col("extraction").isNotNull())
    d = d.withColumns({"norm0": X.norm0(F.col("text")), "tokens": X.tokens_with_dots(F.col("text")), "year": X.publication_year(F.col("text"), policy.today_year), "shared": F.col("extraction.shared")})
    people = listed(F.col("shared.creators"))
    d = d.withColumn("creators", F.transform(people, lambda p: person(p, F.col("norm0"))))
    role = lambda p: F.trim(empty(p["role"]))
    with_role = F.filter(F.zip_with(people, F.col("creators"), lambda p, c: F.struct(role(p).alias("r"), c.alias("c"))), lambda x: x["r"] != "")
    fields = ("name", "nameType", "givenName", "familyName", "nameIdentifiers", "affiliation")
    contributors = F.transform(with_role, lambda x: F.struct(*[x["c"][f].alias(f) for f in fields], F.coalesce(X.contributor_type(x["r"]), lit("Other")).alias("contributorType")))
    if policy.curator:
        import json

        contributors = F.concat(contributors, F.array(F.from_json(lit(json.dumps(policy.curator)), S.CONTRIBUTOR)))
    d = d.withColumns({"contributors": contributors, "unmapped": F.transform(F.filter(with_role, lambda x: X.contributor_type(x["r"]).isNull()), lambda x: F.concat(lit("role '"), x["r"], lit("' has no mapping, used 'Other'")))})

    s = d.select(key, "text", "norm0", "tokens", "year", "shared", "creators", "contributors", F.posexplode(listed(F.col("extraction.samples"))).alias("sample_idx", "sample"))
    if texts is not None:
        s = s.join(texts.select(key, "sample_idx", "written"), [key, "sample_idx"], "left")
    else:
        s = s.withColumn("written", lit(None).cast(S.SAMPLE_TEXT))
    sample, shared, norm0 = F.col("sample"), F.col("shared"), F.col("norm0")
    own_title, own_abstract = fallback(sample, shared["preparation"])
    use = (F.trim(empty(F.col("written.title"))) != "") & (F.trim(empty(F.col("written.abstract"))) != "")
    title = F.when(use, F.trim(F.col("written.title"))).otherwise(own_title)
    abstract = F.when(use, F.trim(F.col("written.abstract"))).otherwise(own_abstract)
    words = F.filter(F.transform(listed(F.col("written.keywords")), lambda k: F.trim(empty(k))), lambda k: (k != "") & (X.norm0(k) != X.norm0(empty(sample["sampleCode"]))))
    known = lambda k: X.contains(norm0, X.norm0(k)) | X.tokens_in_source(k, F.col("tokens"))
    none = lit(None).cast("string")
    subject = lambda v: F.struct(v.alias("subject"), *[none.alias(c) for c in ("lang", "subjectScheme", "schemeURI", "valueURI")])
    subjects = F.concat(listed(shared["subjects"]), listed(sample["subjects"]), F.transform(F.filter(words, known), subject))
    publisher = F.struct(*[lit(policy.publisher.get(f)).cast("string").alias(f) for f in ("name", "publisherIdentifier", "publisherIdentifierScheme", "schemeURI")])
    record = F.struct(
        lit("").alias("doi"), lit("").alias("url"), F.col("creators"), titles(title, sample["sampleCode"], norm0, policy.text_language).alias("titles"), publisher.alias("publisher"), F.col("year").alias("publicationYear"),
        F.struct(lit(policy.resource_type_general).alias("resourceTypeGeneral"), lit(policy.resource_type).alias("resourceType")).alias("types"), lit(policy.schema_version).alias("schemaVersion"), F.col("contributors"),
        merged_dates(converted_dates(F.concat(listed(shared["dates"]), listed(sample["dates"])))).alias("dates"), lit(policy.language).alias("language"),
        F.filter(F.array(F.when(abstract != "", F.struct(abstract.alias("description"), lit("Abstract").alias("descriptionType"), lit(policy.text_language).alias("lang")))), lambda x: x.isNotNull()).alias("descriptions"),
        first_wins(subjects, lambda x: F.lower(F.trim(empty(x["subject"])))).alias("subjects"),
        first_wins(F.concat(related(shared["relatedIdentifiers"]), related(sample["relatedIdentifiers"])), lambda r: F.lower(empty(r["relatedIdentifier"]))).alias("relatedIdentifiers"),
    )
    where = F.concat(lit("sample "), (F.col("sample_idx") + 1).cast("string"))
    dates = F.concat(listed(shared["dates"]), listed(sample["dates"]))
    date_notes = F.filter(F.transform(dates, lambda x: F.when(~empty(x["date"]).rlike(r"\d{4}"), F.concat(lit("dropped "), F.coalesce(x["dateType"], lit("date")), lit(" entry without a date: '"), empty(x["date"]), lit("'"))).when(X.iso_date(x["date"]).isNull(), F.concat(lit("date '"), x["date"], lit("' is not ISO 8601 and was not converted, please fix by hand"))).when(X.iso_date(x["date"]) != x["date"], F.concat(lit("converted date '"), x["date"], lit("' to "), X.iso_date(x["date"])))), lambda m: m.isNotNull())
    notes = F.concat(date_notes, F.filter(F.array(F.when(~use | use.isNull(), F.concat(where, lit(": title and abstract taken from the document text (no writing pass)")))), lambda m: m.isNotNull()), F.transform(F.filter(words, lambda k: ~known(k)), lambda k: F.concat(where, lit(": dropped written keyword '"), k, lit("': not in the document"))))
    from lithoflow.session import materialise

    # Written once: the tests below read every part of the record several times.
    built = materialise(s.select(key, "sample_idx", plain_record(record).alias("record"), notes.alias("notes"))).withColumn("problems", invalid(F.col("record")))
    # One broken sample rejects its document, as a whole.
    rejected = built.where(F.size("problems") > 0).groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("problems")))).alias("problems"))
    records = built.where(F.size("problems") == 0).join(rejected, key, "left_anti").select(key, "sample_idx", "record")
    document = d.select(key, lit(None).cast("int").alias("sample_idx"), F.concat("unmapped", F.array(F.concat(lit("publicationYear: "), F.col("year"))), F.when(F.size(listed(F.col("extraction.samples"))) == 0, F.array(lit("the model found no samples in the document"))).otherwise(F.array())).alias("notes"))
    changes = document.unionByName(built.select(key, "sample_idx", "notes")).select(key, "sample_idx", F.posexplode("notes").alias("seq", "message"))
    # A message of the shared part comes once per document, with its first sample.
    changes = changes.groupBy(key, "message").agg(F.min(F.struct(F.coalesce("sample_idx", lit(-1)).alias("sample_idx"), "seq")).alias("m")).select(key, "m.sample_idx", "m.seq", "message")
    return records, rejected, changes


def gathered(records: DataFrame, titles_: DataFrame, creators: DataFrame, subjects: DataFrame, descriptions: DataFrame, contributors: DataFrame | None = None, affiliations: DataFrame | None = None) -> DataFrame:
    """Flat tables back into one row per record with sorted arrays of structs (the last delivery counts).

    Rows repeated whole count once. Each child is grouped by record before it is joined; with
    ``affiliations``, agents have theirs as ``affiliation``.
    """
    last = records.groupBy("record_id").agg(F.max(F.struct("received_at", "delivery_id", "doc_id", "sample_idx", "doi", "publicationyear", "publisher")).alias("r")).select("record_id", "r.doc_id", "r.sample_idx", "r.doi", "r.publicationyear", "r.publisher")
    under = lambda df, key, name, *cols: df.select(key, *cols).distinct().groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    of = lambda df, name, *cols: under(df, "record_id", name, *cols)
    agent = ("agent_id", "name", "givenname", "familyname", "nameidentifiers")
    if affiliations is not None:
        places = under(affiliations, "agent_id", "affiliation", "affiliation_id", "name", "affiliationidentifier", "affiliationidentifierscheme", "schemeuri")
        agent = (*agent, "affiliation")
        creators = creators.join(places, "agent_id", "left")
        contributors = None if contributors is None else contributors.join(places, "agent_id", "left")
    parts = [of(titles_, "titles", "title_id", "title", "titletype", "lang"), of(creators, "creators", "seq_no", *agent), of(subjects, "subjects", "subject_id", "subject", "lang"), of(descriptions, "descriptions", "description_id", "description", "lang")]
    if contributors is not None:
        parts.append(of(contributors, "contributors", *agent, "nametype", "contributortype"))
    out = last
    for part in parts:
        out = out.join(part, "record_id", "left")
    return out
