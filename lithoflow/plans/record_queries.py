"""Registered queries of the rules, the verification and the matching over nested records.

The flat tables stand for generated records: people with identifiers and affiliations, titles,
descriptions, subjects, the days of all deliveries as Created dates, and the next record of the same
document as a related identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithoflow import policy as P
from lithoflow.functions import text as X
from lithoflow.operators import checks, layout, records, verify
from lithoflow.plans.base import docs, last_deliveries, query
from lithoflow.schemas import NAME_TYPES, RECORD
from lithoflow.session import materialise, read


def nested(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, record_id, sample_idx, record): the flat tables as nested records of the model."""
    deliveries = read(spark, sf, "records")
    g = records.gathered(deliveries, *[read(spark, sf, t) for t in ("titles", "creators", "subjects", "descriptions", "contributors", "affiliations")])
    created = F.date_format("created_at", "yyyy-MM-dd")
    days = deliveries.groupBy("record_id").agg(F.array_sort(F.collect_list(created)).alias("created"), F.max_by("schemaversion", F.struct("received_at", "delivery_id")).alias("schemaversion"))
    beside = last_deliveries(spark, sf, "doi").withColumn("next_doi", F.lead("doi").over(Window.partitionBy("doc_id").orderBy("record_id"))).select("record_id", "next_doi")
    g = g.join(days, "record_id").join(beside, "record_id")
    none = F.lit(None).cast("string")
    e = lambda c: F.coalesce(c, F.array())
    ids = lambda c: F.transform(e(c["nameidentifiers"]), lambda i: F.struct(i["nameidentifier"].alias("nameIdentifier"), i["nameidentifierscheme"].alias("nameIdentifierScheme"), i["schemeuri"].alias("schemeURI")))
    places = lambda c: F.transform(e(c["affiliation"]), lambda a: F.struct(a["name"].alias("name"), a["affiliationidentifier"].alias("affiliationIdentifier"), a["affiliationidentifierscheme"].alias("affiliationIdentifierScheme"), a["schemeuri"].alias("schemeURI")))
    agent = lambda c, kind: (c["name"].alias("name"), kind.alias("nameType"), c["givenname"].alias("givenName"), c["familyname"].alias("familyName"), ids(c).alias("nameIdentifiers"), places(c).alias("affiliation"))
    told = lambda c: F.when(c["nametype"].isin(*NAME_TYPES), c["nametype"]).otherwise("Personal")
    dates = F.transform(F.col("created"), lambda d: F.struct(d.alias("date"), F.lit("Created").alias("dateType"), none.alias("dateInformation")))
    related = F.when(F.col("next_doi").isNotNull(), F.array(F.struct(F.col("next_doi").alias("relatedIdentifier"), F.lit("DOI").alias("relatedIdentifierType"), F.lit("IsPartOf").alias("relationType"), none.alias("resourceTypeGeneral")))).otherwise(F.array())
    record = F.struct(
        F.col("doi").alias("doi"), F.lit("").alias("url"),
        F.transform(e(F.col("creators")), lambda c: F.struct(*agent(c, F.lit("Personal")))).alias("creators"),
        F.transform(e(F.col("titles")), lambda t: F.struct(t["title"].alias("title"), none.alias("titleType"), t["lang"].alias("lang"))).alias("titles"),
        F.struct(F.col("publisher.name").alias("name"), none.alias("publisherIdentifier"), none.alias("publisherIdentifierScheme"), none.alias("schemeURI")).alias("publisher"),
        F.col("publicationyear").alias("publicationYear"), F.struct(F.lit("PhysicalObject").alias("resourceTypeGeneral"), F.lit("Material sample").alias("resourceType")).alias("types"), F.col("schemaversion").alias("schemaVersion"),
        F.transform(e(F.col("contributors")), lambda c: F.struct(*agent(c, told(c)), F.coalesce(X.contributor_type(c["contributortype"]), F.lit("Other")).alias("contributorType"))).alias("contributors"), dates.alias("dates"), F.lit("en").alias("language"),
        F.transform(e(F.col("descriptions")), lambda d: F.struct(d["description"].alias("description"), F.lit("Abstract").alias("descriptionType"), d["lang"].alias("lang"))).alias("descriptions"),
        F.transform(e(F.col("subjects")), lambda s: F.struct(s["subject"].alias("subject"), s["lang"].alias("lang"), none.alias("subjectScheme"), none.alias("schemeURI"), none.alias("valueURI"))).alias("subjects"),
        related.alias("relatedIdentifiers"),
    )
    return g.select("doc_id", "record_id", "sample_idx", record.cast(RECORD.replace("STRUCT", "struct")).alias("record"))


def _wide(spark: SparkSession, sf: str) -> DataFrame:
    """Records with their document's compared forms, as the rules take them; sample_idx is the record's id."""
    r = materialise(nested(spark, sf)).select("doc_id", F.col("record_id").cast("int").alias("sample_idx"), "record")
    return r.join(verify.prepare(docs(spark, sf)).select("doc_id", "text", "norm0", "numbers"), "doc_id")


def _counted(findings: DataFrame, *columns: str) -> DataFrame:
    return findings.groupBy(F.col("sample_idx").cast("bigint").alias("record_id"), *columns).agg(F.count("*").alias("n"))


# -- rules ------------------------------------------------------------------------------------


@query
def unknown_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(checks.unknown_identifiers(_wide(spark, sf)), "kind", "value")


@query
def unknown_names(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(checks.unknown_names(_wide(spark, sf)), "value")


@query
def fixed_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(checks.fixed_fields(_wide(spark, sf)), "path", "value")


@query
def unknown_dates(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(checks.unknown_dates(_wide(spark, sf)), "path", "value")


@query
def unknown_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(checks.unknown_numbers(_wide(spark, sf)), "path", "value")


@query
def created_dates(spark: SparkSession, sf: str) -> DataFrame:
    return _counted(checks.created_dates(_wide(spark, sf)), "value")


@query
def missing_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers of a document that its record lacks."""
    return _counted(checks.missing_identifiers(_wide(spark, sf)), "kind", "value")


@query
def duplicate_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles that another record of the same receiving desk has."""
    d = read(spark, sf, "documents").select("doc_id", "source").where("source is not null")
    t = read(spark, sf, "titles").select("title_id", "record_id", "title").distinct().join(last_deliveries(spark, sf), "record_id").join(d, "doc_id")
    return checks.duplicate_titles(t, "source", "title_id", "title")


def _all_findings(spark: SparkSession, sf: str) -> DataFrame:
    r = materialise(nested(spark, sf)).select("doc_id", F.col("record_id").cast("int").alias("sample_idx"), "record")
    return checks.check_all(r, verify.prepare(docs(spark, sf)))


@query
def findings_union(spark: SparkSession, sf: str) -> DataFrame:
    """All rules over the nested records."""
    return _all_findings(spark, sf).groupBy("doc_id", "severity", "kind").agg(F.count("*").alias("n"))


@query
def findings_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Errors and warnings per document."""
    return checks.summary(_all_findings(spark, sf))


# -- verification -----------------------------------------------------------------------------


def extractions(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text, extraction): a first answer per document, made of its records: creators, contributors
    with their roles as typed, the first description as the shared preparation."""
    from lithoflow.schemas import EXTRACTION

    n = nested(spark, sf)
    first = lambda a, f: F.get(F.col(a), F.lit(0))[f]
    e = lambda c: F.coalesce(c, F.lit(""))
    title, told = first("record.titles", "title"), first("record.descriptions", "description")
    typed = read(spark, sf, "contributors").groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct("agent_id", "contributortype"))).alias("typed"))
    n = n.join(typed, "record_id", "left")
    person = lambda c, role: F.struct(*[c[f].alias(f) for f in ("name", "givenName", "familyName")], role.alias("role"), c["nameIdentifiers"].alias("nameIdentifiers"), F.transform(c["affiliation"], lambda a: F.struct(a["name"].alias("name"))).alias("affiliation"))
    people = F.concat(F.transform("record.creators", lambda c: person(c, F.lit(""))), F.transform("record.contributors", lambda c, i: person(c, F.get(F.col("typed"), i)["contributortype"])))
    sample = F.struct(F.lit("").alias("sampleCode"), title.alias("givenTitle"), told.alias("givenDescription"), F.array(F.concat(F.lit("title: "), e(title))).alias("facts"), F.col("record.subjects").alias("subjects"), F.col("record.dates").alias("dates"), F.col("record.relatedIdentifiers").alias("relatedIdentifiers"))
    d = n.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("record_id", F.to_json(sample).alias("s")))), lambda x: x["s"]).alias("samples"), F.min_by(F.struct(F.to_json(people).alias("people"), F.to_json(F.struct(told.alias("preparation"))).alias("preparation")), "record_id").alias("f"))
    shared = F.concat(F.lit('{"creators":'), "f.people", F.lit(","), F.when(F.length("f.preparation") > 2, F.expr("substring(f.preparation, 2)")).otherwise(F.lit('"preparation":null}')))
    j = F.concat(F.lit('{"shared":'), shared, F.lit(',"samples":['), F.array_join("samples", ","), F.lit("]}"))
    return docs(spark, sf).join(d, "doc_id").select("doc_id", "text", F.from_json(j, EXTRACTION).alias("extraction"))


def _verified(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(verify.verify(extractions(spark, sf)))


@query
def verified_samples(spark: SparkSession, sf: str) -> DataFrame:
    """What is kept of each sample: title, description, facts, keywords, and the code that its title tells."""
    s = _verified(spark, sf).select("doc_id", F.posexplode("extraction.samples").alias("sample_no", "s"))
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return s.select("doc_id", "sample_no", has(F.col("s.givenTitle")).alias("title"), has(F.col("s.givenDescription")).alias("description"), F.size("s.facts").alias("n_facts"), F.size("s.subjects").alias("n_subjects"), F.coalesce("s.sampleCode", F.lit("")).alias("code"))


@query
def verified_shared(spark: SparkSession, sf: str) -> DataFrame:
    """What is kept of a document's shared part: the preparation, and how many roles stand near their names."""
    s = _verified(spark, sf)
    roles = F.size(F.filter("extraction.shared.creators", lambda c: F.trim(F.coalesce(c["role"], F.lit(""))) != ""))
    return s.select("doc_id", (F.coalesce("extraction.shared.preparation", F.lit("")) != "").alias("preparation"), roles.alias("n_roles"))


@query
def verified_extractions(spark: SparkSession, sf: str) -> DataFrame:
    v = _verified(spark, sf)
    return v.select("doc_id", F.size("changes").alias("n_changes"), F.size("extraction.samples").alias("n_samples"), F.array_join("changes", "\n").alias("changes"))


PERSON_IN_TEXT = r"([A-Z][a-z]+) \([A-Z][a-z]+, ORCID"


@query
def recovered_orcids(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers that follow the names of people whom the text names with a role, given without any."""
    people = F.transform(F.array_sort(F.array_distinct(X.extract_all(F.col("text"), PERSON_IN_TEXT, 1))), lambda n: F.struct(n.alias("name"), n.alias("familyName"), F.array().cast("array<struct<nameIdentifier:string>>").alias("nameIdentifiers")))
    return verify.recovered_orcids(docs(spark, sf).withColumn("people", people).where(F.size("people") > 0))


@query
def role_near_name(spark: SparkSession, sf: str) -> DataFrame:
    """Capitalised words before a bracket, with the role that the first such bracket of the text gives."""
    role = F.regexp_extract("text", r"[A-Z][a-z]+ \(([A-Z][a-z]+),", 1)
    names = docs(spark, sf).withColumn("role", role).where("role <> ''").select("doc_id", "text", "role", F.explode(F.array_distinct(X.extract_all(F.col("text"), r"([A-Z][a-z]+) \(", 1))).alias("family"))
    return names.select("doc_id", "family", "role", X.near_name(F.col("text"), F.col("family"), F.col("role")).alias("near"))


# -- records ----------------------------------------------------------------------------------


@query
def built_records(spark: SparkSession, sf: str) -> DataFrame:
    recs, _, _ = records.build(_verified(spark, sf))
    return recs.select("doc_id", "sample_idx", F.to_json("record").alias("record"))


@query
def built_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes and dates of built records: people, roles as contributors, merged keywords and dates, related DOIs."""
    recs, _, _ = records.build(_verified(spark, sf))
    r = lambda f: F.col(f"record.{f}")
    return recs.select("doc_id", "sample_idx", F.size(r("creators")).alias("n_creators"), F.size(r("contributors")).alias("n_contributors"), F.size(r("subjects")).alias("n_subjects"), F.array_join(F.transform(r("dates"), lambda d: d["date"]), ";").alias("dates"), F.array_join(F.transform(r("relatedIdentifiers"), lambda d: d["relatedIdentifier"]), ";").alias("related"), r("publicationYear").alias("year"))


@query
def rejected_records(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of which a record breaks a vocabulary: every seventh document's first date gets an unknown kind."""
    s = F.col("extraction.samples")
    broken = F.transform(s, lambda x, i: x.withField("dates", F.when((i == 0) & (F.col("doc_id") % 7 == 0), F.transform(x["dates"], lambda d: d.withField("dateType", F.lit("Invented")))).otherwise(x["dates"])))
    _, rejected, _ = records.build(_verified(spark, sf).withColumn("extraction", F.col("extraction").withField("samples", broken)))
    return rejected.select("doc_id", F.array_join("problems", ",").alias("problems"))


# -- page layout ------------------------------------------------------------------------------


def _box(n: Column, k: Column) -> dict[str, Column]:
    x0, top = (n * 40).cast("double"), (k % 5 * 12).cast("double")
    return {"x0": x0, "x1": x0 + 30 + k % 20, "top": top, "bottom": top + 10}


@query
def form_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Form widgets made of order lines: texts, choices, buttons, some inheriting their kind or value."""
    n, k = F.col("l_linenumber").cast("int"), F.col("l_partkey").cast("int")
    own = k % 3 != 0
    kind = F.when(k % 5 < 2, "Tx").when(k % 5 == 2, "Ch").otherwise("Btn")
    value = F.concat(F.lit(" "), "l_linestatus", F.lit(" \n "), "l_returnflag")
    flags = F.when(k % 7 == 0, 1 << 16).otherwise(0)
    state = F.when(k % 4 == 0, "Off").when(k % 4 == 1, "").otherwise("Yes")
    w = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("page"), F.when(own, kind).alias("kind"), F.when(k % 2 == 0, value).alias("value"), state.alias("state"), F.when(own, flags).alias("flags"), kind.alias("parent_kind"), F.when(k % 11 == 0, F.lit("inherited")).alias("parent_value"), flags.alias("parent_flags"), *[c.alias(a) for a, c in _box(n, k).items()], F.lit(10.0).alias("size"))
    return layout.form_words(w).groupBy("doc_id", "text").agg(F.count("*").alias("n"))


@query
def free_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of the line from 0 to 400 that an order's words leave free, wide enough for a gutter."""
    n, k = F.col("l_linenumber").cast("int"), F.col("l_partkey").cast("int")
    box = _box(n, k)
    lines = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(box["x0"].alias("x0"), box["x1"].alias("x1"))).alias("ws"))
    whole = F.array(F.struct(F.lit(0.0).alias("a"), F.lit(400.0).alias("b")))
    free = lines.select("l_orderkey", F.explode(layout.intersect(layout.free_intervals(F.col("ws"), F.lit(0.0), F.lit(400.0)), whole)).alias("i"))
    return free.select("l_orderkey", F.col("i.a").alias("a"), F.col("i.b").alias("b"))


@query
def glyph_counts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_partkey").cast("int")
    glyphs = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).cast("int").alias("page"), F.when(k % 3 == 0, F.concat(F.lit("(cid:"), k.cast("string"), F.lit(")"))).when(k % 3 == 1, "a").otherwise("(cid:x)").alias("text"))
    return layout.glyph_counts(glyphs)


@query
def link_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Words that lie under a link: one link box per order over the middle of the page."""
    n, k = F.col("l_linenumber").cast("int"), F.col("l_partkey").cast("int")
    words = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("w"), k.cast("string"), F.lit(",")).alias("text"), *[c.alias(a) for a, c in _box(n, k).items()])
    links = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(0).alias("link_no"), F.lit("https://example.org").alias("uri"), F.lit(50.0).alias("x0"), F.lit(0.0).alias("top"), F.lit(190.0).alias("x1"), F.lit(40.0).alias("bottom"))
    return layout.link_labels(links, words).select("doc_id", "label")


@query
def lost_from_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers of documents, of their records' DOIs (as links) and of their creators (as form fields) that the text lacks."""
    last = last_deliveries(spark, sf, "doi")
    ids = read(spark, sf, "creators").select("record_id", F.explode("nameidentifiers").alias("i")).join(last, "record_id").select("doc_id", F.col("i.nameidentifier").alias("value"))
    d = docs(spark, sf).select("doc_id", F.lit("").alias("raw"), "text")
    return layout.lost_from_pages(d, ids, last.select("doc_id", F.col("doi").alias("uri"))).select("doc_id", F.array_join("lost", ",").alias("lost"))


# -- identifiers and names --------------------------------------------------------------------


@query
def bare_hosts(spark: SparkSession, sf: str) -> DataFrame:
    """Records' addresses without their host, and whether they are unfilled."""
    url = F.coalesce("url", F.lit(""))
    return read(spark, sf, "records").select("delivery_id", X.bare_host(F.col("url")).alias("bare"), X.is_placeholder(F.concat(url, F.when(F.col("delivery_id") % 5 == 0, F.lit("???")).otherwise(F.lit("")))).alias("unfilled"))


@query
def record_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Title, abstract and the creators' family names that scoring compares records by."""
    from lithoflow.operators import scoring

    r = nested(spark, sf)
    return r.select("record_id", scoring.title(F.col("record")).alias("title"), scoring.code(F.col("record")).alias("code"), scoring.abstract(F.col("record")).alias("abstract"), F.array_join(F.transform("record.creators", scoring.family), ";").alias("families"))


@query
def provenance_counts(spark: SparkSession, sf: str) -> DataFrame:
    """What the provenance of each document says of its source and of its findings."""
    from lithoflow import sinks

    d = docs(spark, sf)
    r = materialise(nested(spark, sf)).select("doc_id", F.col("record_id").cast("int").alias("sample_idx"), "record")
    none = spark.createDataFrame([], "doc_id bigint, sample_idx int, seq int, message string")
    p = sinks.provenance(d, none, checks.check_all(r, verify.prepare(d)), {"library": "lithoflow"})
    get = lambda path: F.get_json_object("json", path)
    return p.select("doc_id", get("$.source.sha256").alias("sha"), get("$.source.chars").cast("bigint").alias("chars"), get("$.validation.errorCount").cast("bigint").alias("errors"))
