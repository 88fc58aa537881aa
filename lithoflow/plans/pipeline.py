"""The whole way from documents to records, findings and scores, as one composition of the stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoflow import policy as P
from lithoflow import schemas as S
from lithoflow.functions import python as Y
from lithoflow.operators import checks, lookup, matching, model_calls, records, scoring, verify
from lithoflow.session import materialise


@dataclass
class Result:
    records: DataFrame
    rejected: DataFrame
    changes: DataFrame
    findings: DataFrame
    answers: DataFrame
    passes: DataFrame
    fresh: DataFrame


def run(docs: DataFrame, cache: DataFrame, extraction_template: str, model: Callable[[str], str] | None = None, writing_template: str | None = None, policy: P.Policy | None = None, name: str = "model") -> Result:
    """docs: (doc_id, text). Two passes of the model, both answered from ``cache`` where it knows the prompt.

    Documents without text are left out; one without a usable first answer gives no records; a sample without a second one falls
    back on copied text. Each stage is written once, as several later stages read it.
    """
    def told(answers: DataFrame, prompts: DataFrame, kind: str) -> DataFrame:
        doc = F.split("id", "/")[0].cast("bigint").alias("doc_id")
        rest = F.regexp_extract("id", "/(.*)", 1)
        asked = prompts.select("id", F.length("prompt").alias("promptChars"), F.sha2("prompt", 256).alias("promptSha256"))
        return answers.join(asked, "id").select(doc, F.concat(F.lit(kind), F.when(rest != "", F.concat(F.lit(" "), rest)).otherwise("")).alias("pass"), F.lit(name).alias("model"), "promptChars", "promptSha256", F.col("cache_key").alias("cacheKey"), "cached", "error")

    docs = docs.where(F.col("text").rlike(r"(?U)[^\s]"))
    prompts = docs.select(F.col("doc_id").cast("string").alias("id"), model_calls.extraction_prompt(F.col("text"), extraction_template).alias("prompt"))
    answers, fresh = model_calls.answer(prompts, cache, model, name)
    passes = told(answers, prompts, "extract")
    parsed = model_calls.parse(answers, S.EXTRACTION)
    verified = materialise(verify.verify(docs.join(parsed.where(F.col("value").isNotNull()).select(F.col("id").cast("bigint").alias("doc_id"), F.col("value").alias("extraction")), "doc_id")))
    texts = None
    if writing_template:
        w = model_calls.writing_fields(verified)
        names = ("code", "given_title", "given_description", "facts", "preparation", "others")
        p2 = w.select(F.concat_ws("/", F.col("doc_id").cast("string"), F.col("sample_idx").cast("string")).alias("id"), model_calls.fill(writing_template, {n: F.col(n) for n in names}).alias("prompt"))
        second, more = model_calls.answer(p2, cache, model, name)
        fresh, passes = fresh.unionByName(more), passes.unionByName(told(second, p2, "write"))
        good = model_calls.parse(second, S.SAMPLE_TEXT).where(F.col("value").isNotNull())
        at = F.split("id", "/")
        texts = materialise(good.select(at[0].cast("bigint").alias("doc_id"), at[1].cast("int").alias("sample_idx"), F.col("value").alias("written")))
    recs, rejected, changes = records.build(verified, texts, policy)
    recs = materialise(recs)
    noted = verified.select("doc_id", F.posexplode("changes").alias("seq", "message")).select("doc_id", F.lit(-2).alias("sample_idx"), "seq", "message")
    findings = checks.check_all(recs, verify.prepare(docs), texts, policy)
    return Result(recs, rejected, noted.unionByName(changes.select("doc_id", "sample_idx", "seq", "message")), findings, parsed.select("id", "cached", "error"), passes, fresh)


def enrich(result: Result, people: DataFrame, organisations: DataFrame, online: bool = True) -> Result:
    """The result with registered names and identifiers in its records; its checks stay as they were, as
    registry data isn't in the documents. people: (orcid, registered); organisations: (text, ror, label)."""
    recs, said, found = lookup.enrich_records(result.records, people, organisations, online)
    numbered = found.withColumn("finding_no", F.lit(None).cast("int"))
    findings = result.findings.select("doc_id", "sample_idx", "severity", "kind", "path", "value", "message", "finding_no").unionByName(numbered)
    changes = result.changes.unionByName(said.select("doc_id", F.lit(None).cast("int").alias("sample_idx"), F.lit(None).cast("int").alias("seq"), "message"))
    return Result(materialise(recs), result.rejected, changes, findings, result.answers, result.passes, result.fresh)


def evaluate(ours: DataFrame, gold: DataFrame, docs: DataFrame, draft: bool = False) -> tuple[DataFrame, DataFrame]:
    """(checks, summaries) of generated against curated records, both (doc_id, sample_idx, record).

    Only documents with curated records are scored; records are paired within their document.
    """
    ours = ours.join(gold.select("doc_id").distinct(), "doc_id", "left_semi")
    flat = lambda df, side: df.select("doc_id", F.lit(side).alias("side"), F.col("sample_idx").cast("bigint").alias("idx"), scoring.code(F.col("record")).alias("code"), Y.nfkc(scoring.title(F.col("record"))).alias("title"), Y.nfkc(scoring.abstract(F.col("record"))).alias("abstract"))
    sides = materialise(flat(gold, "gold").unionByName(flat(ours, "ours")))
    pairs = materialise(matching.match(sides))
    label = F.left(F.coalesce(F.nullif("code", F.lit("")), "title"), F.lit(P.OTHER_CHARS))
    sizes = sides.groupBy("doc_id").agg(F.count_if(F.col("side") == "gold").alias("n_g"), F.count_if(F.col("side") == "ours").alias("n_o"))
    labels = lambda side: sides.where(F.col("side") == side).select("doc_id", "idx", label.alias("label"))
    wide = pairs.join(labels("gold").withColumnRenamed("idx", "g"), ["doc_id", "g"])
    wide = wide.join(gold.select("doc_id", F.col("sample_idx").cast("bigint").alias("g"), F.col("record").alias("gr")), ["doc_id", "g"]).join(ours.select("doc_id", F.col("sample_idx").cast("bigint").alias("o"), F.col("record").alias("our")), ["doc_id", "o"])
    wide = wide.select("doc_id", "label", F.col("gr").alias("g"), F.col("our").alias("o")).join(docs.select("doc_id", "text"), "doc_id", "left")
    checks_ = scoring.record_checks(wide, draft)
    checks_ = materialise(checks_.unionByName(scoring.document_checks(sizes, pairs, labels("gold"), labels("ours"), draft).select(checks_.columns)))
    return checks_, scoring.summarize(checks_)
