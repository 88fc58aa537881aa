"""Checks of generated against curated records, and their summaries.

``pairs``: (doc_id, label, g STRUCT, o STRUCT) with records under schemas.RECORD, NFKC where needed, and
``text``. Checks are one array per pair, exploded once. Values of any type are stored as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoflow.functions import python as Y
from lithoflow.functions import text as X
from lithoflow.operators.records import empty, listed


def title(r: Column) -> Column:
    return empty(F.get(F.filter(listed(r["titles"]), lambda t: t["titleType"].isNull()), F.lit(0))["title"])


def code(r: Column) -> Column:
    return empty(F.get(F.filter(listed(r["titles"]), lambda t: t["titleType"] == "AlternativeTitle"), F.lit(0))["title"])


def abstract(r: Column) -> Column:
    return empty(F.get(F.filter(listed(r["descriptions"]), lambda d: d["descriptionType"] == "Abstract"), F.lit(0))["description"])


def family(p: Column) -> Column:
    return F.coalesce(F.nullif(p["familyName"], F.lit("")), F.trim(F.split(empty(p["name"]), ",")[0]))


def tail(c: Column) -> Column:
    return F.regexp_extract(empty(c), r"([^/]*)\z", 1)


def source(text: Column) -> dict[str, Column]:
    return {"s_flat": X.flat(Y.nfkc(text)), "s_numbers": X.numeric(Y.nfkc(text))}


def record_checks(pairs: DataFrame, draft: bool = False) -> DataFrame:
    """(doc_id, sample, category, field, passed, expected, got) of each pair."""
    p = pairs.select("doc_id", "label", "g", "o", "text").withColumns(source(empty(F.col("text")))).withColumns({"t_ratio": Y.sequence_ratio(X.norm(Y.nfkc(title(F.col("g")))), X.norm(Y.nfkc(title(F.col("o"))))), "a_ratio": Y.sequence_ratio(X.norm(Y.nfkc(abstract(F.col("g")))), X.norm(Y.nfkc(abstract(F.col("o")))))})
    g, o, flat = F.col("g"), F.col("o"), X.flat
    has = lambda v: (flat(v) != "") & X.contains(F.col("s_flat"), flat(v))
    where = lambda v: F.when(has(v), "document").otherwise("curator")
    text = lambda v: v.cast("string")

    def check(category, field, passed, expected, got) -> Column:
        cat = category if isinstance(category, Column) else F.lit(category)
        name = field if isinstance(field, Column) else F.lit(field)
        ok = F.lit(None).cast("boolean") if passed is None else passed
        return F.struct(cat.alias("category"), name.alias("field"), ok.alias("passed"), text(expected).alias("expected"), text(got).alias("got"))

    def when(condition: Column, c: Column) -> Column:
        return F.when(condition, F.array(c)).otherwise(F.array())

    def each(items: Column, f) -> Column:
        return F.flatten(F.transform(listed(items), f))

    skip = lambda field, v: check("skipped", field, None, v, F.lit(None))
    gc, oc = code(g), code(o)
    codes = F.when(gc == "", F.array()).when(X.is_placeholder(gc), F.array(skip("sample code", gc))).otherwise(F.array(check(where(gc), "sample code", flat(gc) == flat(oc), gc, oc)))
    theirs = listed(o["creators"])
    keys = F.array_distinct(F.transform(theirs, lambda c: flat(family(c))))
    # Of several creators with one family name the last counts.
    find = lambda p_: F.get(F.reverse(F.filter(theirs, lambda c: flat(family(c)) == flat(family(p_)))), F.lit(0))
    strict = F.lit(not draft)

    def creator(c: Column) -> Column:
        who, m = F.coalesce(c["name"], F.lit("?")), find(c)
        label = lambda s: F.concat(F.lit("creator "), who, F.lit(f": {s}"))
        given = empty(c["givenName"])
        ids = F.transform(listed(m["nameIdentifiers"]), lambda i: tail(i["nameIdentifier"]))
        names = F.filter(F.transform(listed(m["affiliation"]), lambda a: empty(a["name"])), lambda a: a != "")
        rors = F.filter(F.transform(listed(m["affiliation"]), lambda a: a["affiliationIdentifier"]), lambda a: a.isNotNull())
        return F.concat(
            F.array(check(where(family(c)), label("present"), m.isNotNull(), who, m["name"])),
            F.when(X.is_placeholder(given), F.array(skip(label("given name"), given))).when(given != "", F.array(check(where(given), label("given name"), m.isNotNull() & (flat(m["givenName"]) == flat(given)), given, m["givenName"]))).otherwise(F.array()),
            F.transform(listed(c["nameIdentifiers"]), lambda i: check(where(tail(i["nameIdentifier"])), label("ORCID"), F.array_contains(ids, tail(i["nameIdentifier"])), tail(i["nameIdentifier"]), F.array_join(F.array_sort(F.array_distinct(ids)), ", "))),
            each(c["affiliation"], lambda a: F.concat(
                F.array(check(where(a["name"]), label("affiliation"), F.exists(names, lambda n: X.contains(flat(n), flat(a["name"])) | X.contains(flat(a["name"]), flat(n))), a["name"], F.array_join(names, ", "))),
                when(empty(a["affiliationIdentifier"]) != "", check(where(tail(a["affiliationIdentifier"])), label("affiliation ROR"), F.array_contains(rors, empty(a["affiliationIdentifier"])), a["affiliationIdentifier"], F.array_join(F.array_sort(F.array_distinct(rors)), ", "))),
            )),
        )

    creators = F.concat(when((F.size(listed(g["creators"])) > 0) | strict, check("document", "creator count", F.size(listed(g["creators"])) == F.size(keys), F.size(listed(g["creators"])), F.size(keys))), each(g["creators"], creator))
    named = F.filter(listed(g["contributors"]), lambda c: empty(c["name"]) != "")
    curating = lambda c: empty(c["contributorType"]) == "DataCurator"
    g_roles, o_roles = F.filter(named, lambda c: ~curating(c)), F.filter(listed(o["contributors"]), lambda c: ~curating(c))
    contributors = F.concat(
        when(F.exists(named, curating), check("policy", "data curator present", F.exists(listed(o["contributors"]), curating), F.lit("DataCurator"), F.array_join(F.transform(F.filter(listed(o["contributors"]), curating), lambda c: empty(c["name"])), ", "))),
        when((F.size(g_roles) > 0) | strict, check("document", "contributor count", F.size(g_roles) == F.size(o_roles), F.size(g_roles), F.size(o_roles))),
        F.transform(g_roles, lambda c: (lambda m: check("document", F.concat(F.lit("contributor "), empty(c["name"]), F.lit(": role")), m.isNotNull() & m["contributorType"].eqNullSafe(c["contributorType"]), c["contributorType"], m["contributorType"]))(F.get(F.filter(o_roles, lambda x: flat(family(x)) == flat(family(c))), F.lit(0)))),
    )
    dated = lambda d: F.concat_ws(" ", empty(d["date"]), d["dateType"])
    o_dates = F.array_distinct(F.transform(listed(o["dates"]), dated))
    bare = lambda d: (empty(d["date"]) == "") | X.is_placeholder(d["date"])
    parts = lambda v: F.filter(F.split(v, "/"), lambda x: x != "")
    told = lambda v: (F.size(parts(v)) > 0) & F.forall(parts(v), lambda q: F.exists(X.date_forms(q), has))
    extras = F.array_except(o_dates, F.transform(F.filter(listed(g["dates"]), lambda d: ~bare(d)), dated))
    dates = F.concat(
        F.transform(listed(g["dates"]), lambda d: F.when(bare(d), skip(F.concat(F.lit("date ("), empty(d["dateType"]), F.lit(")")), empty(d["date"]))).otherwise(check(F.when(told(d["date"]), "document").otherwise("curator"), F.concat(F.lit("date "), d["date"], F.lit(" ("), empty(d["dateType"]), F.lit(")")), F.array_contains(o_dates, dated(d)), dated(d), F.array_join(F.array_sort(o_dates), ", ")))),
        when(F.exists(listed(g["dates"]), lambda d: ~bare(d)), check("document", "dates: no extras", F.size(extras) == 0, F.lit(""), F.array_join(F.array_sort(extras), ", "))),
    )
    o_subjects = F.transform(F.filter(listed(o["subjects"]), lambda s: empty(s["subject"]) != ""), lambda s: flat(s["subject"]))
    keywords = F.transform(listed(g["subjects"]), lambda s: check(where(s["subject"]), F.concat(F.lit("keyword "), empty(s["subject"])), F.exists(o_subjects, lambda x: X.contains(x, flat(s["subject"])) | X.contains(flat(s["subject"]), x)), s["subject"], F.array_join(o_subjects, ", ")))
    o_related = F.transform(listed(o["relatedIdentifiers"]), lambda r: X.bare_host(r["relatedIdentifier"]))
    related = F.transform(listed(g["relatedIdentifiers"]), lambda r: F.when((empty(r["relatedIdentifier"]) == "") | X.is_placeholder(r["relatedIdentifier"]) | empty(r["relatedIdentifier"]).endswith("/"), skip("related identifier", empty(r["relatedIdentifier"]))).otherwise(check(where(X.bare_host(r["relatedIdentifier"])), F.concat(F.lit("related "), r["relatedIdentifier"]), F.array_contains(o_related, X.bare_host(r["relatedIdentifier"])), r["relatedIdentifier"], F.array_join(F.array_sort(F.array_distinct(o_related)), ", "))))
    ga, oa = abstract(g), abstract(o)
    shown = lambda n: F.regexp_replace(n.cast("decimal(30,6)").cast("string"), r"\.?0+$", "")
    writing = F.concat(
        F.array(check("writing", "title similarity", None, title(g), F.bround("t_ratio", 3))),
        when(ga != "", check("writing", "abstract similarity", None, F.left(ga, F.lit(80)), F.bround("a_ratio", 3))),
        F.when(ga != "", F.transform(F.array_sort(X.numeric(ga)), lambda n: check(F.when(F.array_contains(F.col("s_numbers"), n), "document").otherwise("curator"), F.concat(F.lit("abstract value "), shown(n)), F.array_contains(X.numeric(oa), n), n, F.lit(None)))).otherwise(F.array()),
        when((ga == "") & F.lit(draft), skip("abstract", F.lit(""))),
    )
    same = lambda f, e, got: check("policy", f, X.norm(e) == X.norm(got), e, got)
    policy = F.concat(F.array(same("publisher", g["publisher"]["name"], o["publisher"]["name"])), *[when(empty(g["types"][f]) != "", same(f, g["types"][f], o["types"][f])) for f in ("resourceTypeGeneral", "resourceType")])
    checks = F.concat(codes, creators, contributors, dates, keywords, related, writing, policy)
    return p.select("doc_id", F.col("label").alias("sample"), F.explode(checks).alias("c")).select("doc_id", "sample", "c.*")


def document_checks(sizes: DataFrame, pairs: DataFrame, gold: DataFrame, ours: DataFrame, draft: bool = False) -> DataFrame:
    """Sample counts and the records without a partner. sizes: (doc_id, n_g, n_o); pairs: (doc_id, g, o);
    gold and ours: (doc_id, idx, label)."""
    none = F.lit(None).cast("string")
    row = lambda field, passed, expected, got, sample: [sample.alias("sample"), F.lit("document").alias("category"), F.lit(field).alias("field"), passed.alias("passed"), expected.cast("string").alias("expected"), got.cast("string").alias("got")]
    counts = sizes.where(F.lit(not draft) | (F.col("n_g") > 0)).select("doc_id", *row("sample count", F.col("n_g") == F.col("n_o"), F.col("n_g"), F.col("n_o"), none))
    lost = gold.join(pairs.select("doc_id", F.col("g").alias("idx")), ["doc_id", "idx"], "left_anti").select("doc_id", *row("sample found", F.lit(False), F.col("label"), none, F.col("label")))
    extra = ours.join(pairs.select("doc_id", F.col("o").alias("idx")), ["doc_id", "idx"], "left_anti").select("doc_id", *row("sample expected", F.lit(False), none, F.col("label"), F.col("label")))
    return counts.unionByName(lost).unionByName(extra)


def field_group(field: Column) -> Column:
    return F.when(field.startswith("dates"), "date").otherwise(F.split(field, " ")[0])


def by_group(checks: DataFrame) -> DataFrame:
    """(doc_id, category, field_group, passed, total) of the scored checks."""
    scored = checks.where(F.col("passed").isNotNull())
    return scored.groupBy("doc_id", "category", field_group(F.col("field")).alias("field_group")).agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))


def summarize(checks: DataFrame) -> DataFrame:
    """One row per document with its scores."""
    c = lambda cat: F.col("category") == cat
    ok = F.coalesce("passed", F.lit(False))
    n = lambda cat: F.count_if(c(cat) & F.col("passed").isNotNull())
    mean = lambda field: F.avg(F.when(F.col("field") == field, F.col("got").cast("double")))
    s = checks.groupBy("doc_id").agg(*[f.alias(k) for cat in ("document", "policy") for k, f in ((f"{cat}_passed", F.count_if(c(cat) & ok)), (f"{cat}_total", n(cat)))], F.count_if(c("curator")).alias("curator_total"), F.count_if(c("curator") & ok).alias("curator_matched"), F.count_if(c("skipped")).alias("skipped"), mean("title similarity").alias("title_similarity"), mean("abstract similarity").alias("abstract_similarity"))
    return s.withColumns({f"{cat}_score": F.when(F.col(f"{cat}_total") > 0, F.bround(F.col(f"{cat}_passed") / F.col(f"{cat}_total"), 3)) for cat in ("document", "policy")})


def overall(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.sum("document_passed").alias("passed"), F.sum("document_total").alias("total")).withColumn("share", F.col("passed") / F.col("total"))


def failures(checks: DataFrame, most: int | None = 12) -> DataFrame:
    """The failed checks of each document in order; with ``most`` only so many, as the report shows."""
    from pyspark.sql import Window

    failed = checks.where(~F.col("passed"))
    if most is None:
        return failed
    w = Window.partitionBy("doc_id").orderBy("category", "field", "sample")
    return failed.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")


def report(summaries: DataFrame, checks: DataFrame, run: dict[str, str]) -> DataFrame:
    """(doc_id, json): scores, per-field counts and failures of a document with the run's settings."""
    groups = by_group(checks).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("/", "category", "field_group"), F.concat_ws("/", F.col("passed").cast("string"), F.col("total").cast("string")))))).alias("by_field"))
    failed = failures(checks, None).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("category", "field", "sample", "expected", "got"))).alias("failed"))
    settings = F.create_map(*[F.lit(x) for kv in sorted(run.items()) for x in kv])
    d = summaries.join(groups, "doc_id", "left").join(failed, "doc_id", "left")
    return d.select("doc_id", F.to_json(F.struct(*[c for c in d.columns if c != "doc_id"], settings.alias("run"))).alias("json"))
