"""Registered queries of the core library: name -> (spark, sf_dir) -> DataFrame.

Each runs its operators over whole tables. The records of the flat tables stand for generated records
and ``documents`` for their source; the last delivery of a record counts.
"""

from __future__ import annotations

import json
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithoflow import policy as P
from lithoflow.functions import python as Y
from lithoflow.functions import text as X
from lithoflow.operators import checks, layout, lookup, matching, model_calls, records, shred, verify
from lithoflow.plans import pipeline
from lithoflow.plans.base import REGISTRY, Query, docs, last_deliveries, query
from lithoflow.plans.record_queries import extractions, nested
from lithoflow.plans.sql import all_sql  # noqa: F401 - registered beside the queries
from lithoflow.session import materialise, read
from lithoflow.sources import files

_last, _docs = last_deliveries, docs


def all_queries() -> dict[str, Query]:
    from lithoflow.plans import record_queries  # noqa: F401 - registers its queries

    return dict(REGISTRY)


def _of_docs(spark: SparkSession, sf: str, child: DataFrame) -> DataFrame:
    """Rows of a child table (once per id) with the doc_id and sample_idx of their record."""
    return child.distinct().join(_last(spark, sf), "record_id")


# -- p3 ---------------------------------------------------------------------------------------


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return shred.found(read(spark, sf, "raw_records"), "raw_id", "payload")


@query
def p3_affiliations(spark: SparkSession, sf: str) -> DataFrame:
    """The flat table of affiliations with all their fields."""
    nodes = materialise(shred.shred(read(spark, sf, "raw_records").dropDuplicates(["raw_id"]), "raw_id", "payload", labels=("creators",)))
    return shred.entities(nodes)["affiliation"].withColumnRenamed("row_key", "raw_id")


# -- copies and source checks -----------------------------------------------------------------


@query
def copy_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return verify.copy_ratios(_docs(spark, sf), read(spark, sf, "eval_items"))


@query
def copied_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    d = _of_docs(spark, sf, read(spark, sf, "descriptions").select("description_id", "record_id", "description").where("description is not null"))
    j = verify.beside(d.select("doc_id", "description_id", "description"), _docs(spark, sf))
    told = lambda t, haystack, runs: F.transform("items", lambda x: F.struct(x["description_id"].alias("description_id"), verify.is_copied(x["description"], t, haystack, runs).alias("copied")))
    t = F.col("text")
    return j.select(F.inline(X.let(X.plain_source(t), lambda haystack: X.let(X.shingles(X.words(t)), lambda runs: told(t, haystack, runs)))))


@query
def keyword_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Keywords of which every telling word stands in the document."""
    s = _of_docs(spark, sf, read(spark, sf, "subjects").select("subject_id", "record_id", "subject").where("trim(subject) <> ''"))
    j = verify.beside(s.select("doc_id", "subject_id", "subject"), _docs(spark, sf))
    told = lambda tokens: F.transform("items", lambda x: F.struct(x["subject_id"].alias("subject_id"), X.tokens_in_source(F.trim(x["subject"]), tokens).alias("in_source")))
    return j.select(F.inline(X.let(X.tokens_with_dots(F.col("text")), told)))


@query
def norm_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    n = X.norm0(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.sha2(n, 256).alias("sha"), F.length(n).alias("n_norm"))


@query
def number_set_str(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.explode(X.numbers(F.col("text"))).alias("number"))


@query
def number_set_num(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "descriptions").select("description_id", "description").distinct().where("description is not null")
    return d.select("description_id", F.explode(X.numeric(F.col("description"))).alias("number"))


@query
def new_numbers(spark: SparkSession, sf: str) -> DataFrame:
    d = _of_docs(spark, sf, read(spark, sf, "descriptions").select("description_id", "record_id", "description").where("description is not null"))
    j = verify.beside(d.select("doc_id", "description_id", "description"), _docs(spark, sf))
    told = lambda numbers: F.transform("items", lambda x: F.struct(x["description_id"].alias("description_id"), checks.new_numbers(x["description"], numbers).alias("value")))
    return j.select(F.inline(X.let(X.numbers(F.col("text")), told))).where("value <> ''")


@query
def doc_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    return files.identifiers_of(_docs(spark, sf))


def _orcids(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "creators").select("agent_id", "record_id", F.explode(F.array_distinct(F.transform("nameidentifiers", lambda x: F.regexp_extract(F.coalesce(x["nameidentifier"], F.lit("")), P.ORCID, 0)))).alias("orcid")).where("orcid <> ''")
    return _of_docs(spark, sf, c)


@query
def verified_orcids(spark: SparkSession, sf: str) -> DataFrame:
    """How many identifiers of each creator stand in the document, in canonical form."""
    c = read(spark, sf, "creators").select("agent_id", "record_id", F.transform("nameidentifiers", lambda x: F.struct(x["nameidentifier"].alias("nameIdentifier"))).alias("ids"))
    j = c.join(_last(spark, sf), "record_id").join(_docs(spark, sf).select("doc_id", X.norm0(F.col("text")).alias("n")), "doc_id")
    return j.select("agent_id", F.size(records.verified_orcids(F.col("ids"), F.col("n"))).alias("n_verified"))


@query
def date_in_source(spark: SparkSession, sf: str) -> DataFrame:
    r = read(spark, sf, "records").select("delivery_id", "doc_id", F.date_format("created_at", "yyyy-MM-dd").alias("d")).where("d is not null")
    j = r.join(_docs(spark, sf).select("doc_id", X.norm0(F.col("text")).alias("n")), "doc_id")
    return j.select("delivery_id", checks.date_in_source(F.col("d"), F.col("n")).alias("in_source"))


@query
def code_from_title(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "titles").select("title_id", "title").distinct()
    return t.select("title_id", verify.code_from_title(F.col("title"), F.lit("")).alias("code")).where("code <> ''")


# -- text functions ---------------------------------------------------------------------------


@query
def loop_reason(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions repeated to a long text run in circles; whole documents don't."""
    d = read(spark, sf, "descriptions").select("description_id", F.repeat(F.coalesce("description", F.lit("")), F.lit(5)).alias("t")).distinct()
    return d.select("description_id", X.loop_reason(F.col("t")).alias("reason")).where("reason is not null")


@query
def prompt_truncation(spark: SparkSession, sf: str) -> DataFrame:
    p = model_calls.extraction_prompt(F.col("text"), "Read this:\n{text}\nAnswer in JSON.")
    return _docs(spark, sf).select("doc_id", F.length(p).alias("n_prompt"), F.sha2(p, 256).alias("sha"))


@query
def md_table(spark: SparkSession, sf: str) -> DataFrame:
    cells = lambda *cs: F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cs])
    rows = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", F.concat("l_returnflag", F.lit("|"), "l_linestatus").alias("flags"), cells("l_linenumber", "l_partkey").alias("a")))), lambda x: F.concat(x["a"], F.array(x["flags"]))).alias("rows"))
    head = F.array(F.array(F.lit("line"), F.lit("part"), F.lit("flags")))
    return rows.select("l_orderkey", X.markdown_table(F.concat(head, "rows")).alias("md"))


@query
def input_filter(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.when(F.col("doc_id") % 7 == 0, "~$").when(F.col("doc_id") % 11 == 0, ".").otherwise(""), F.lit("doc"), "doc_id")
    path = F.concat(F.lit("/in/"), F.coalesce("source", F.lit("none")), F.lit("/"), name, F.lit("."), F.when(F.col("doc_id") % 5 == 0, "ODT").otherwise(F.col("file_format")))
    d = read(spark, sf, "documents").select("doc_id", path.alias("path"))
    how = files.dispatch(F.col("path"))
    return d.select("doc_id", files.is_input(F.col("path")).alias("is_input"), how["format"].alias("format"), how["fatal"].alias("fatal"))


@query
def safe_name(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "titles").select("title_id", "title").distinct().where("title is not null").select("title_id", X.safe_name(F.col("title"), 20).alias("name"))


@query
def json_walk(spark: SparkSession, sf: str) -> DataFrame:
    return checks.walk_json(read(spark, sf, "events"), "event_id", "props")


@query
def contributor_type(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "contributors").select("agent_id", F.coalesce(X.contributor_type(F.col("contributortype")), F.lit("Other")).alias("kind"))


@query
def iso_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates as documents write them, and in ISO form where there is one."""
    months = "|".join(P.MONTH_NAMES)
    raw = X.extract_all(F.col("text"), rf"\d{{1,2}}\.? (?:{months}) \d{{4}}|(?:{months}) \d{{1,2}}, \d{{4}}|\d{{1,2}}\.\d{{1,2}}\.\d{{4}}")
    return _docs(spark, sf).select("doc_id", F.explode(F.array_distinct(raw)).alias("raw")).select("doc_id", "raw", X.iso_date(F.col("raw")).alias("iso"))


@query
def strip_titles(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "creators").where("name is not null").select("agent_id", X.strip_titles(F.col("name")).alias("bare"))


@query
def sub_super_plain(spark: SparkSession, sf: str) -> DataFrame:
    t = read(spark, sf, "titles").select("title_id", "title").distinct().where("title is not null")
    tagged = F.regexp_replace("title", r"(\d+)", "<sub>$1</sub>")
    return t.select("title_id", X.sub_super(tagged).alias("plain"))


@query
def bare_doi(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "records").select("delivery_id", X.bare_doi(F.concat(F.when(F.col("delivery_id") % 3 == 0, "https://doi.org/").when(F.col("delivery_id") % 3 == 1, "DOI: ").otherwise(""), F.coalesce("doi", F.lit("")))).alias("bare"))


@query
def publication_year(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat("text", F.when(F.col("doc_id") % 4 == 0, F.lit("\nAdditional information: published in print, 2019")).otherwise(F.lit("")))
    return _docs(spark, sf).select("doc_id", X.publication_year(t, 2026).alias("year"))


@query
def format_time(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", X.format_time(F.col("o_custkey").cast("double") * 7).alias("t")).where("o_orderkey is not null")


@query
def list_labels(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("s_suppkey")
    return read(spark, sf, "supplier").where("s_suppkey >= 1").select("s_suppkey", X.roman(n).alias("roman"), X.letter(n).alias("letter"))


# -- records ----------------------------------------------------------------------------------


@query
def first_wins_unique(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "subjects").select("subject_id", "record_id", "subject").distinct().groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("subject_id", "subject"))), lambda x: F.coalesce(x["subject"], F.lit(""))).alias("all"))
    return s.select("record_id", F.array_join(records.first_wins(F.col("all"), lambda v: F.lower(F.trim(v))), "|").alias("kept"))


@query
def stable_date_sort(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderpriority").alias("dateType"), F.lit("").alias("dateInformation")))), lambda x: F.struct(x["date"].alias("date"), x["dateType"].alias("dateType"), x["dateInformation"].alias("dateInformation"))).alias("ds"))
    return o.select("o_custkey", F.array_join(F.transform(records.merged_dates(F.col("ds")), lambda d: F.concat(d["date"], F.lit(" "), d["dateType"])), ";").alias("dates"))


@query
def records_gathered(spark: SparkSession, sf: str) -> DataFrame:
    g = records.gathered(*[read(spark, sf, t) for t in ("records", "titles", "creators", "subjects", "descriptions")])
    n = lambda c: F.size(F.coalesce(c, F.array()))
    return g.select("record_id", "doc_id", n(F.col("titles")).alias("n_titles"), n(F.col("creators")).alias("n_creators"), n(F.col("subjects")).alias("n_subjects"), n(F.col("descriptions")).alias("n_descriptions"))


# -- look-ups ---------------------------------------------------------------------------------


def _known(spark: SparkSession, sf: str) -> DataFrame:
    """(text, ror, label): labels and aliases of the organisations, each once."""
    return read(spark, sf, "organisations").select(F.explode(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("text"), "ror", "label").groupBy("text").agg(F.min_by("ror", "ror").alias("ror"), F.min_by("label", "ror").alias("label"))


@query
def lookup_join(spark: SparkSession, sf: str) -> DataFrame:
    a = read(spark, sf, "affiliations")
    return lookup.enrich_affiliations(a, _known(spark, sf)).select("affiliation_id", F.coalesce("affiliationidentifier", F.lit("")).alias("identifier"), "status")


@query
def ror_choose(spark: SparkSession, sf: str) -> DataFrame:
    """Registry answers made of the organisations: English label, display name, or the most similar alias."""
    o = read(spark, sf, "organisations")
    name = lambda v, lang, kind: F.struct(v.alias("value"), F.lit(lang).alias("lang"), F.array(F.lit(kind)).alias("types"))
    names = F.when(F.col("org_id") % 3 == 0, F.array(name(F.col("label"), "en", "label"))).when(F.col("org_id") % 3 == 1, F.array(name(F.col("label"), None, "ror_display"))).otherwise(F.array(name(F.get("aliases", F.lit(0)), "de", "ror_display"), name(F.col("label"), "en", "alias")))
    payload = F.to_json(F.struct(F.array(F.struct((F.col("org_id") % 5 != 0).alias("chosen"), F.struct(F.col("ror").alias("id"), names.alias("names")).alias("organization"))).alias("items")))
    return lookup.organisation_names(o.select(F.col("label").alias("text"), payload.alias("payload")))


def _people(agents: DataFrame) -> DataFrame:
    """Agents of the flat tables with the ORCIDs of their identifiers."""
    return agents.select(F.col("agent_id").alias("person_id"), "name", "givenname", "familyname", F.coalesce(F.transform("nameidentifiers", lambda x: F.regexp_extract(F.coalesce(x["nameidentifier"], F.lit("")), P.ORCID, 0)), F.array().cast("array<string>")).alias("orcids"))


def _registry(people: DataFrame) -> DataFrame:
    """(orcid, registered): a registry made of the people who have both names."""
    return people.select(F.explode("orcids").alias("orcid"), "givenname", "familyname").where("orcid <> '' and givenname is not null and familyname is not null").groupBy("orcid").agg(F.max(F.struct(F.upper("givenname").alias("given"), F.upper("familyname").alias("family"))).alias("registered"))


@query
def enriched_people(spark: SparkSession, sf: str) -> DataFrame:
    people = _people(read(spark, sf, "creators"))
    return lookup.enrich_people(people, _registry(people))


@query
def enriched_records(spark: SparkSession, sf: str) -> DataFrame:
    """Nested records with the organisations' identifiers and the names under which identifiers are registered."""
    registry = _registry(_people(read(spark, sf, "creators")))
    out, _, _ = lookup.enrich_records(materialise(nested(spark, sf)).select("doc_id", F.col("record_id").cast("int").alias("sample_idx"), "record"), registry, _known(spark, sf))
    return out.select("doc_id", "sample_idx", F.to_json("record").alias("record"))


@query
def late_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per day of arrival and source."""
    d = read(spark, sf, "documents").where("received_at is not null")
    return d.groupBy(F.date_format(F.window("received_at", "1 day")["start"], "yyyy-MM-dd").alias("day"), F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))


# -- matching and scoring ---------------------------------------------------------------------


def _sides(spark: SparkSession, sf: str, folded: bool = True) -> DataFrame:
    """Records of a document as both sides of a comparison: odd ones curated, even ones generated."""
    nfkc = Y.nfkc if folded else lambda c: c
    last = _last(spark, sf)
    t = read(spark, sf, "titles").select("record_id", "title_id", "title").distinct().groupBy("record_id").agg(F.min_by("title", "title_id").alias("title"))
    a = read(spark, sf, "descriptions").select("record_id", "description_id", "description").distinct().groupBy("record_id").agg(F.min_by("description", "description_id").alias("abstract"))
    j = last.join(t, "record_id", "left").join(a, "record_id", "left")
    return j.select("doc_id", F.when(F.col("record_id") % 2 == 1, "gold").otherwise("ours").alias("side"), F.col("record_id").alias("idx"), F.lit("").alias("code"), nfkc(F.coalesce("title", F.lit(""))).alias("title"), nfkc(F.coalesce("abstract", F.lit(""))).alias("abstract"))


def _groups(spark: SparkSession, sf: str, folded: bool = True) -> DataFrame:
    """The sides by batches of five documents, so that groups hold several records on both sides."""
    d = read(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 5).alias("batch"))
    return _sides(spark, sf, folded).join(d, "doc_id").drop("doc_id").withColumnRenamed("batch", "doc_id")


@query
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of texts as they are, compatibility forms not folded."""
    return matching.weights(_groups(spark, sf, False)).select("doc_id", "idx", "term", F.round("w", 6).alias("w"))


@query
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of texts as they are, compatibility forms not folded."""
    return matching.scores(_groups(spark, sf, False)).select("doc_id", "g", "o", F.round("score", 6).alias("score"))


@query
def matched_records(spark: SparkSession, sf: str) -> DataFrame:
    return matching.match(materialise(_groups(spark, sf))).select("doc_id", "g", "o", F.round("score", 6).alias("score"), "uncertain")


@query
def title_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of the titles of records that follow each other in a document."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    s = _sides(spark, sf).select("doc_id", "idx", "title", F.lead("title").over(w).alias("next_title")).where("next_title is not null")
    return s.select("doc_id", "idx", F.round(Y.sequence_ratio(X.norm(F.col("title")), X.norm(F.col("next_title"))), 6).alias("ratio"))


@query
def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Records with even ids scored against the matching ones with odd ids of their document."""
    n = materialise(nested(spark, sf)).select("doc_id", F.col("record_id").cast("int").alias("sample_idx"), "record")
    _, summaries = pipeline.evaluate(n.where("sample_idx % 2 = 0"), n.where("sample_idx % 2 = 1"), _docs(spark, sf))
    return summaries


# -- model calls and the whole pipeline -------------------------------------------------------

EXAMPLES = [(0, "Basalt core", "A core.", ["desk-01"]), (1, "Gypsum rod", "A rod.", []), (2, "Peat disc", "A disc.", ["desk-02", "desk-03"]), (3, "Zirconia foil", "A foil.", []), (4, "Titania wafer", "A wafer.", []), (5, "Olivine slab", "A slab.", ["desk-01"])]


@query
def style_examples(spark: SparkSession, sf: str) -> DataFrame:
    ex = spark.createDataFrame(EXAMPLES, "pos int, title string, abstract string, source_documents array<string>")
    return model_calls.style_examples(read(spark, sf, "documents").where("source is not null").select("source"), ex)


@query
def provenance_json(spark: SparkSession, sf: str) -> DataFrame:
    from lithoflow import sinks

    v = materialise(verify.verify(extractions(spark, sf)))
    recs, _, changes = records.build(v)
    docs = _docs(spark, sf)
    return sinks.provenance(docs, changes, checks.check_all(materialise(recs), verify.prepare(docs)), {"library": "lithoflow"})


@query
def cached_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts answered from a cache that knows the even documents, the others by a stand-in model."""
    d = _docs(spark, sf)
    prompts = d.select(F.col("doc_id").cast("string").alias("id"), model_calls.extraction_prompt(F.col("text"), "{text}").alias("prompt"))
    cache = prompts.where(F.col("id").cast("bigint") % 2 == 0).select(model_calls.cache_key(F.col("prompt"), "model").alias("cache_key"), F.lit('{"samples": []}').alias("content"), F.lit("model").alias("model"))
    answers, _ = model_calls.answer(prompts, cache, _stand_in)
    return answers.select(F.col("id").cast("bigint").alias("doc_id"), "cached", "content", "error")


def _stand_in(prompt: str) -> str:
    if not prompt:
        raise ValueError("empty prompt")
    return json.dumps({"samples": [], "n_chars": len(prompt)})


# -- page layout ------------------------------------------------------------------------------


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Word boxes made of order lines: six words a line, some small, some in a table."""
    n, k = F.col("l_linenumber").cast("int"), F.col("l_partkey").cast("int")
    line = n % 3
    x0 = ((n * 53) % 300).cast("double")
    size = F.when(k % 4 == 0, 6.0).otherwise(10.0)
    top = (line * 14).cast("double") + F.when(k % 4 == 0, F.when(k % 8 == 0, -3.0).otherwise(6.0)).otherwise(0.0)
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.concat(F.lit("w"), k.cast("string"), F.when(k % 5 == 0, F.lit("(cid:7)")).otherwise(F.lit(""))).alias("text"), x0.alias("x0"), (x0 + 20).alias("x1"), top.alias("top"), (top + size).alias("bottom"), size.alias("size"), F.when(k % 9 == 0, "field").otherwise("text").alias("kind"), line.alias("line_no"), n.alias("n"))


@query
def words_outside_tables(spark: SparkSession, sf: str) -> DataFrame:
    tables = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(100.0).alias("x0"), F.lit(0.0).alias("top"), F.lit(220.0).alias("x1"), F.lit(20.0).alias("bottom"))
    return layout.clean_words(_boxes(spark, sf), tables).select("doc_id", "n", "text")


def _numbered(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("doc_id", "page", "line_no").orderBy("x0", "n", "text")
    return _boxes(spark, sf).withColumn("word_no", F.row_number().over(w))


@query
def script_words(spark: SparkSession, sf: str) -> DataFrame:
    return layout.mark_scripts(_numbered(spark, sf)).where("kind in ('sup', 'sub')").select("doc_id", "n", "kind")


@query
def rendered_lines(spark: SparkSession, sf: str) -> DataFrame:
    return layout.render_lines(_numbered(spark, sf)).select("doc_id", "line_no", "text")


@query
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as pages: a line of six words for each item, three on either side of a gutter; every seventh
    part's line runs over it, and every fifth order has a table after its third line."""
    part = F.col("l_partkey").cast("int")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))
    words = F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("n"), "l_linenumber"), F.concat(F.lit("r"), "l_returnflag"), F.concat(F.lit("t"), "l_linestatus"), F.concat(F.lit("m"), F.pmod("l_partkey", F.lit(100))))
    d = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), n.alias("n"), (part % 7 == 0).alias("over"), words.alias("words"))
    d = d.select("doc_id", "n", "over", F.posexplode("words").alias("k", "text"))
    x0 = (F.col("k") * 48 + F.when(~F.col("over") & (F.col("k") >= 3), 76).otherwise(0)).cast("double")
    top = (F.col("n") * 14).cast("double")
    boxes = d.select("doc_id", F.lit(1).alias("page"), "text", x0.alias("x0"), (x0 + 45).alias("x1"), top.alias("top"), (top + 10).alias("bottom"), F.lit(10.0).alias("size"), F.lit("text").alias("kind"))
    pages = read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"))
    tables = pages.where("doc_id % 5 = 0").select("doc_id", "page", F.lit(49.0).alias("top"), F.lit("| t |").alias("markdown"))
    return layout.page_texts(layout.mark_scripts(layout.lines(boxes)), tables, pages.withColumn("width", F.lit(400.0))).select("doc_id", "text")


@query
def page_quality(spark: SparkSession, sf: str) -> DataFrame:
    stats = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page"), F.col("l_quantity").cast("int").alias("unmapped"), F.lit(100).alias("total"), (F.col("l_partkey") % 40).cast("int").alias("text_len"))
    q = layout.page_quality(stats)
    return q.select("doc_id", F.array_join(F.transform("unreadable", lambda x: x.cast("string")), ",").alias("unreadable"), F.array_join(F.transform("empty", lambda x: x.cast("string")), ",").alias("empty"), "fatal")


@query
def links_section(spark: SparkSession, sf: str) -> DataFrame:
    links = _orcids(spark, sf).select("doc_id", F.col("agent_id").alias("link_no"), F.concat(F.lit("https://orcid.org/"), "orcid").alias("uri"), F.when(F.col("agent_id") % 2 == 0, "author").otherwise("").alias("label"))
    return layout.links_section(_docs(spark, sf), links)


@query
def lost_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", F.col("text").alias("raw"), F.substring("text", 1, F.floor(F.length("text") / 2).cast("int")).alias("text"))
    return layout.lost_identifiers(d).select("doc_id", F.array_join("lost", ",").alias("lost"))
