"""Registry look-ups as joins with a cache table; what the cache lacks is fetched by an injected callable.

The cache is (url_key, payload): a payload of ``{}`` says that the registry has nothing. A failed
fetch gives a row with an error and is not cached.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoflow import policy as P
from lithoflow.functions import python as Y
from lithoflow.operators.records import empty, listed
from lithoflow.session import materialise

PERSON = "STRUCT<name: STRUCT<`given-names`: STRUCT<value: STRING>, `family-name`: STRUCT<value: STRING>>>"
ORGANISATION = "STRUCT<items: ARRAY<STRUCT<chosen: BOOLEAN, organization: STRUCT<id: STRING, names: ARRAY<STRUCT<value: STRING, lang: STRING, types: ARRAY<STRING>>>>>>>"


def url_key(url: Column) -> Column:
    return F.left(F.sha2(url, 256), F.lit(24))


def resolve(urls: DataFrame, cache: DataFrame, fetch: Callable[[str], str | None] | None = None, parallel: int = 4) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache rows) for the distinct ``urls`` (url). answers: (url, payload, error).

    ``fetch`` gets a URL and gives a payload, ``{}`` for "not found"; after a ConnectionError the rest
    of the task's URLs are not tried. ``parallel`` tasks ask at once, so a registry that is down is tried
    that often at most. Without ``fetch`` only the cache answers.
    """
    wanted = urls.select("url").where(F.col("url").isNotNull()).distinct().withColumn("url_key", url_key(F.col("url")))
    hits = wanted.join(cache.dropDuplicates(["url_key"]), "url_key").select("url", "payload", F.lit(None).cast("string").alias("error"))
    if fetch is None:
        return hits, cache.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offline = ""
        for batch in batches:
            payloads, errors = [], []
            for url in batch.column(1).to_pylist():
                payload = error = None
                if offline:
                    error = offline
                else:
                    try:
                        payload = fetch(url)
                    except ConnectionError as e:
                        error = offline = f"offline: {e}"
                    except Exception as e:  # noqa: BLE001 - any other failure concerns this URL only
                        error = str(e)
                payloads.append(payload)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(payloads, pa.string()), pa.array(errors, pa.string())], names=["url_key", "url", "payload", "error"])

    misses = wanted.join(cache.select("url_key"), "url_key", "left_anti").select("url_key", "url")
    fetched = materialise(misses.repartition(parallel).mapInArrow(run, "url_key string, url string, payload string, error string"))
    return hits.unionByName(fetched.select("url", "payload", "error")), fetched.where(F.col("payload").isNotNull()).select("url_key", "payload")


def person_name(payload: Column) -> Column:
    """STRUCT<given, family> as registered; null unless both are there."""
    p = F.from_json(payload, PERSON)
    given, family = F.trim(p["name"]["given-names"]["value"]), F.trim(p["name"]["family-name"]["value"])
    return F.when((empty(given) != "") & (empty(family) != ""), F.struct(given.alias("given"), family.alias("family")))


def chosen_organisation(payload: Column) -> Column:
    """STRUCT<id, english, display, display_lang, aliases> of the registry's choice; null if there is none."""
    item = F.get(F.filter(listed(F.from_json(payload, ORGANISATION)["items"]), lambda x: x["chosen"]), F.lit(0))["organization"]
    names = listed(item["names"])
    of = lambda kind: F.filter(names, lambda n: F.array_contains(listed(n["types"]), kind))
    english = F.get(F.filter(of("label"), lambda n: n["lang"] == "en"), F.lit(0))["value"]
    display = F.get(of("ror_display"), F.lit(0))
    aliases = F.transform(F.filter(of("alias"), lambda n: n["lang"] == "en"), lambda n: n["value"])
    return F.when(item.isNotNull(), F.struct(item["id"].alias("id"), english.alias("english"), display["value"].alias("display"), display["lang"].alias("display_lang"), aliases.alias("aliases")))


def organisation_names(answers: DataFrame, text: str = "text", payload: str = "payload") -> DataFrame:
    """(text, ror, name): English label, else English display name, else the most similar name, else the text."""
    a = answers.select(text, chosen_organisation(F.col(payload)).alias("o")).where(F.col("o").isNotNull())
    sure = F.coalesce(F.col("o.english"), F.when(F.col("o.display_lang").isNull() | (F.col("o.display_lang") == "en"), F.col("o.display")))
    known = a.where(sure.isNotNull()).select(text, F.col("o.id").alias("ror"), sure.alias("name"))
    rest = a.where(sure.isNull()).select(text, F.col("o.id").alias("ror"), F.posexplode_outer(F.filter(F.concat(F.array("o.display"), F.col("o.aliases")), lambda x: x.isNotNull())).alias("pos", "c"))
    rated = rest.withColumn("ratio", Y.sequence_ratio(F.lower("c"), F.lower(text)))
    best = rated.groupBy(text, "ror").agg(F.max(F.struct("ratio", F.negative("pos").alias("p"), "c")).alias("b")).select(text, "ror", F.coalesce("b.c", text).alias("name"))
    return known.unionByName(best)


def enrich_people(people: DataFrame, names: DataFrame) -> DataFrame:
    """People with registered names. people: (person_id, name, givenname, familyname, orcids ARRAY);
    names: (orcid, registered STRUCT<given, family>). The first identifier with a registered name counts.

    Adds changed and differs (the family names are different ones).
    """
    people = people.select("person_id", "name", "givenname", "familyname", "orcids")
    ids = people.select("person_id", F.posexplode("orcids").alias("pos", "orcid"))
    first = ids.join(names.where(F.col("registered").isNotNull()), "orcid").groupBy("person_id").agg(F.min_by("registered", "pos").alias("r"))
    p = people.join(first, "person_id", "left")
    family, given = Y.cased(F.col("r.family"), empty(F.col("familyname"))), Y.cased(F.col("r.given"), empty(F.col("givenname")))
    p = p.withColumns({"new_family": F.when(F.col("r").isNotNull(), family), "new_given": F.when(F.col("r").isNotNull(), given)})
    p = p.withColumn("new_name", F.concat("new_family", F.lit(", "), "new_given"))
    changed = F.coalesce(F.col("new_name") != empty(F.col("name")), F.lit(False))
    differs = changed & (Y.nfkd_key(F.col("new_family")) != Y.nfkd_key(F.split(empty(F.col("name")), ",")[0]))
    pick = lambda new, old: F.when(changed, F.col(new)).otherwise(F.col(old)).alias(old)
    return p.select("person_id", pick("new_name", "name"), pick("new_given", "givenname"), pick("new_family", "familyname"), changed.alias("changed"), differs.alias("differs"))


def enrich_affiliations(affiliations: DataFrame, known: DataFrame) -> DataFrame:
    """Affiliations without an identifier get the one of their text. known: (text, ror, label).

    Adds status: kept, matched, unmatched or empty.
    """
    a = affiliations.select("affiliation_id", "name", "affiliationidentifier", "affiliationidentifierscheme")
    a = a.join(known.select("text", "ror", "label").dropDuplicates(["text"]), F.col("name") == F.col("text"), "left")
    has, blank = empty(F.col("affiliationidentifier")) != "", empty(F.col("name")) == ""
    new = ~has & ~blank & F.col("ror").isNotNull()
    status = F.when(has, "kept").when(blank, "empty").when(F.col("ror").isNotNull(), "matched").otherwise("unmatched")
    return a.select("affiliation_id", F.when(new, F.col("label")).otherwise(F.col("name")).alias("name"), F.when(new, F.col("ror")).otherwise(F.col("affiliationidentifier")).alias("affiliationidentifier"), F.when(new, F.lit("ROR")).otherwise(F.col("affiliationidentifierscheme")).alias("affiliationidentifierscheme"), status.alias("status"))


def status(answers: DataFrame) -> DataFrame:
    """One row: answered, failed and the first five errors in alphabetical order."""
    ranked = answers.where(F.col("error").isNotNull()).select("error").distinct().orderBy("error").limit(5)
    counts = answers.agg(F.count_if(F.col("payload").isNotNull()).alias("answered"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return counts.crossJoin(F.broadcast(ranked.agg(F.array_sort(F.collect_list("error")).alias("errors"))))  # one row each


# The registries' addresses.
PERSON_URL, ORGANISATION_URL = "https://pub.orcid.org/v3.0/{}/person", "https://api.ror.org/v2/organizations?affiliation={}"


def registries(records: DataFrame, cache: DataFrame, fetch: Callable[[str], str | None] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(names, known, new cache rows, status) that enrich_records() takes, asked for the identifiers and
    affiliations of the records (.., record); answered from the cache where it knows the address."""
    told = lambda role: F.transform(listed(F.col(f"record.{role}")), lambda p: F.struct(p["nameIdentifiers"].alias("nameIdentifiers"), p["affiliation"].alias("affiliation")))
    people = records.select(F.explode(F.concat(told("creators"), told("contributors"))).alias("p"))
    people = materialise(people.select("p.nameIdentifiers", "p.affiliation"))
    orcids = people.select(F.explode("nameIdentifiers").alias("i")).select(F.regexp_extract(empty(F.col("i.nameIdentifier")), P.ORCID, 0).alias("orcid")).where("orcid <> ''").distinct()
    places = people.select(F.explode("affiliation").alias("a")).where((empty(F.col("a.name")) != "") & (empty(F.col("a.affiliationIdentifier")) == "")).select(F.col("a.name").alias("text")).distinct()
    address = lambda pattern, c: F.concat(F.lit(pattern.split("{}")[0]), c, F.lit(pattern.split("{}")[1]))
    orcids = orcids.withColumn("url", address(PERSON_URL, F.col("orcid")))
    places = places.withColumn("url", address(ORGANISATION_URL, F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20"))))
    answers, fresh = resolve(orcids.select("url").unionByName(places.select("url")), cache, fetch)
    answers = materialise(answers)
    names = orcids.join(answers, "url").select("orcid", person_name(F.col("payload")).alias("registered")).where(F.col("registered").isNotNull())
    known = organisation_names(places.join(answers, "url").select("text", "payload")).select("text", "ror", F.col("name").alias("label"))
    return names, known, fresh, status(answers)


def enrich_records(records: DataFrame, names: DataFrame, known: DataFrame, online: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, changes, findings) with registered names and organisation identifiers put in. Only
    ``online`` does a missing organisation mean that the registry has none, which is told then.

    records: (doc_id, sample_idx, record); names: (orcid, registered STRUCT<given, family>); known:
    (text, ror, label). Data curators stay as they are. People and their affiliations are exploded as
    narrow rows, joined, and laid back into their places by position; the records' other parts and
    texts don't travel. Each message comes once per document.
    """
    place = ["doc_id", "sample_idx", "role", "pos"]
    rows = None
    for role in ("creators", "contributors"):
        part = records.select("doc_id", "sample_idx", F.lit(role).alias("role"), F.posexplode(listed(F.col(f"record.{role}"))).alias("pos", "p"))
        kind = F.coalesce(F.col("p.contributorType"), F.lit("")) if role == "contributors" else F.lit("")
        part = part.where(kind != "DataCurator").select(*place, "p.name", "p.givenName", "p.familyName", "p.nameIdentifiers", "p.affiliation")
        rows = part if rows is None else rows.unionByName(part)
    rows = materialise(rows.withColumn("person_id", F.xxhash64(*place)))
    orcids = F.transform(listed(F.col("nameIdentifiers")), lambda i: F.regexp_extract(empty(i["nameIdentifier"]), P.ORCID, 0))
    people = enrich_people(rows.select("person_id", "name", F.col("givenName").alias("givenname"), F.col("familyName").alias("familyname"), orcids.alias("orcids")), names)
    a = rows.select("person_id", F.posexplode(listed(F.col("affiliation"))).alias("k", "a"))
    placed = enrich_affiliations(a.select(F.struct("person_id", "k").alias("affiliation_id"), "a.name", F.col("a.affiliationIdentifier").alias("affiliationidentifier"), F.col("a.affiliationIdentifierScheme").alias("affiliationidentifierscheme")), known)
    placed = materialise(placed.join(a.select(F.struct("person_id", "k").alias("affiliation_id"), F.col("a.name").alias("text"), F.col("a.schemeURI").alias("uri")), "affiliation_id"))
    ror = F.col("status") == "matched"
    entry = F.struct("name", F.col("affiliationidentifier").alias("affiliationIdentifier"), F.col("affiliationidentifierscheme").alias("affiliationIdentifierScheme"), F.when(ror, F.lit("https://ror.org/")).otherwise(F.col("uri")).alias("schemeURI"))
    lists = placed.groupBy(F.col("affiliation_id.person_id").alias("person_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("affiliation_id.k").alias("k"), entry.alias("e")))), lambda x: x["e"]).alias("places"))
    done = materialise(rows.select(*place, "person_id", F.col("name").alias("before")).join(people, "person_id").join(lists, "person_id", "left"))

    new = F.struct("pos", "name", F.col("givenname").alias("givenName"), F.col("familyname").alias("familyName"), "places")
    by_role = done.groupBy("doc_id", "sample_idx").agg(*[F.collect_list(F.when(F.col("role") == r, new)).alias(f"new_{r}") for r in ("creators", "contributors")])
    out = records.join(by_role, ["doc_id", "sample_idx"], "left")
    def laid(role: str) -> Column:
        def put(p: Column, i: Column) -> Column:
            hit = F.get(F.filter(listed(F.col(f"new_{role}")), lambda n: n["pos"] == i), F.lit(0))
            changed = p.withField("name", hit["name"]).withField("givenName", hit["givenName"]).withField("familyName", hit["familyName"]).withField("affiliation", F.coalesce(hit["places"], p["affiliation"]))
            return F.when(hit.isNotNull(), changed).otherwise(p)

        return F.transform(F.col(f"record.{role}"), put)

    for role in ("creators", "contributors"):
        out = out.withColumn("record", F.col("record").withField(role, laid(role)))
    told = done.where("changed").select("doc_id", F.concat(empty(F.col("before")), F.lit(" -> "), "name", F.lit(" as registered")).alias("message"))
    owner = done.select("person_id", "doc_id")
    of = placed.select(F.col("affiliation_id.person_id").alias("person_id"), "status", "text", "name", "affiliationidentifier").join(owner, "person_id")
    told = told.unionByName(of.where("status = 'matched'").select("doc_id", F.concat(F.lit("affiliation '"), "text", F.lit("' -> "), "name", F.lit(" ("), "affiliationidentifier", F.lit(")")).alias("message")))
    told = told.unionByName(of.where((F.col("status") == "unmatched") & F.lit(online)).select("doc_id", F.concat(F.lit("no registered organisation is clearly meant by '"), "text", F.lit("'")).alias("message")))
    findings = done.where("differs").select("doc_id", "sample_idx", F.lit("warning").alias("severity"), F.lit("orcid-name").alias("kind"), F.concat("role", F.lit("["), F.col("pos").cast("string"), F.lit("].name")).alias("path"), F.concat(empty(F.col("before")), F.lit(" -> "), "name").alias("value"), F.lit("another family name is registered under this identifier").alias("message"))
    return out.select(*records.columns), told.distinct(), findings

