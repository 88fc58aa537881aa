"""The commands of the shell: whole runs over folders, scores of their outputs, later enrichment.

Outputs of a document are NAME.json, its records as one list, NAME.provenance.json and NAME.md, in a folder
that all executors share. Models and registries are functions named as module:function.
"""

from __future__ import annotations

import importlib
import json
import os
import time
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoflow import policy as P
from lithoflow import schemas as S
from lithoflow import sinks
from lithoflow.functions import text as X
from lithoflow.operators import lookup, scoring
from lithoflow.plans import pipeline
from lithoflow.session import materialise
from lithoflow.sources import docx, files

SIDECAR = ".provenance.json"
CACHE = "cache_key string, content string, model string"
REGISTRY = "url_key string, payload string"


def function(name: str | None) -> Callable | None:
    """The function that module:function names."""
    if not name:
        return None
    name, _, attribute = name.partition(":")
    module = importlib.import_module(name)
    cloudpickle.register_pickle_by_value(module)  # executors needn't have it
    return getattr(module, attribute)


def _table(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """A Parquet table that may not be there yet."""
    if path and os.path.isdir(path.removeprefix("file:")):
        return spark.read.parquet(path)
    return spark.createDataFrame([], schema)


def _stem(path: Column) -> Column:
    return X.safe_name(F.regexp_replace(files.file_name(path), r"\.[^.]*$", ""))


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected files): (doc_id, doc_name, filename, format, text, warnings) and (path, warning)."""
    found = files.scan(spark, folder)
    usable, broken = files.split_fatal(docx.load(found.where(files.suffix(F.col("path")) == ".docx")))
    docs = usable.select(F.xxhash64("path").alias("doc_id"), _stem(F.col("path")).alias("doc_name"), files.file_name(F.col("path")).alias("filename"), F.lit("docx").alias("format"), "text", "warnings")
    other = found.where(files.suffix(F.col("path")) != ".docx").select("path", F.coalesce(files.dispatch(F.col("path"))["warning"], F.lit("no reader for this format here")).alias("warning"))
    return materialise(docs), other.unionByName(broken.select("path", F.array_join("warnings", "; ").alias("warning")))


def run(spark: SparkSession, folder: str, out: str, extraction: str, writing: str | None = None, model: Callable | None = None, name: str = "model", cache: str | None = None, registry: str | None = None, fetch: Callable | None = None, look_up: bool = True, manifest: str | None = None, policy: P.Policy | None = None) -> tuple[DataFrame, pipeline.Result]:
    """Documents of a folder to records, sidecars and pages in ``out``; (documents, result).

    ``extraction`` and ``writing`` are templates. Answers of the model and of the registries are read from
    and added to the tables ``cache`` and ``registry``. Documents that ``manifest`` names are scored as well.
    """
    docs, rejected = load(spark, folder)
    result = pipeline.run(docs.select("doc_id", "text"), _table(spark, cache, CACHE), extraction, model, writing, policy, name)
    if cache and model is not None:
        result.fresh.write.mode("append").parquet(cache)
    enrichment = None
    if look_up:
        names, known, fresh, status = lookup.registries(result.records, _table(spark, registry, REGISTRY), fetch)
        if registry and fetch is not None:
            fresh.write.mode("append").parquet(registry)
        result = pipeline.enrich(result, names, known, online=fetch is not None)
        enrichment = docs.select("doc_id").join(F.broadcast(status.select(F.to_json(F.struct(*status.columns)).alias("json"))))  # one row
    evaluation = None
    if manifest:
        _, summaries = evaluated(spark, manifest, result.records, docs)
        evaluation = summaries.select("doc_id", F.to_json(F.struct(*[c for c in summaries.columns if c != "doc_id"])).alias("json"))
    settings = {"generatedBy": "lithoflow", "generatedAt": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
    sidecars = sinks.provenance(docs, result.changes, result.findings, settings, result.passes, enrichment, evaluation)
    sinks.write_named(sinks.record_lists(result.records, docs.select("doc_id", F.col("doc_name").alias("name"))).select("doc_name", F.col("json").alias("value")), out, ".json")
    sinks.write_named(sidecars.join(docs, "doc_id").select("doc_name", F.col("json").alias("value")), out, SIDECAR)
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", sinks.report(F.col("record")).alias("page")))), lambda x: x["page"]), "\n\n---\n\n")
    sinks.write_named(result.records.groupBy("doc_id").agg(page.alias("value")).join(docs, "doc_id").select("doc_name", "value"), out, ".md")
    return docs, result


def _outputs(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_name, records) of the record lists in a folder."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).where(~F.col("path").endswith(SIDECAR))
    whole = F.from_json(F.decode("content", "UTF-8"), f"ARRAY<{S.RECORD}>")
    return raw.select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("doc_name"), F.decode("content", "UTF-8").alias("json"), whole.alias("records"))


def _curated(spark: SparkSession, manifest: str) -> DataFrame:
    """(doc_name, sample_idx, record, draft) of the curated records that a manifest names, from files beside it."""
    m = files.manifest(spark, manifest)
    held = files.records(spark, os.path.join(os.path.dirname(manifest), "*.json")).select(files.file_name(F.col("path")).alias("file"), "records")
    chosen = m.withColumn("file", files.file_name(F.col("records"))).drop("records").join(held, "file").select("source", "draft", files.selected(F.col("records"), F.col("selected")).alias("records"))
    return chosen.select(_stem(F.col("source")).alias("doc_name"), "draft", F.posexplode("records").alias("sample_idx", "record"))


def evaluated(spark: SparkSession, manifest: str, records: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checks, summaries) of records (doc_id, sample_idx, record) of the documents that the manifest names."""
    gold = _curated(spark, manifest).join(docs.select("doc_id", "doc_name"), "doc_name")
    gold = materialise(gold.select("doc_id", "sample_idx", "record", "draft"))
    parts = [pipeline.evaluate(records, gold.where(F.col("draft") == d).drop("draft"), docs.select("doc_id", "text"), d) for d in (False, True)]
    return parts[0][0].unionByName(parts[1][0]), parts[0][1].unionByName(parts[1][1])


def evaluate(spark: SparkSession, manifest: str, outputs: str, folder: str, runs: str | None = None) -> DataFrame:
    """(doc_name, json, document_passed, document_total): a report for each scored document; with ``runs``
    they are saved there as one run file named after the time."""
    docs, _ = load(spark, folder)
    records = _outputs(spark, outputs).join(docs.select("doc_id", "doc_name"), "doc_name").select("doc_id", F.posexplode("records").alias("sample_idx", "record"))
    checks, summaries = evaluated(spark, manifest, materialise(records), docs)
    sidecars = spark.read.format("binaryFile").option("pathGlobFilter", "*" + SIDECAR).load(outputs)
    told = sidecars.select(F.regexp_extract("path", rf"([^/]*)\{SIDECAR}$", 1).alias("doc_name"), F.decode("content", "UTF-8").alias("s"))
    how = told.select("doc_name", F.to_json(F.struct(F.get_json_object("s", "$.generatedAt").alias("generatedAt"), F.get_json_object("s", "$.passes[0].model").alias("model"), F.coalesce(F.get_json_object("s", "$.passes").contains('"pass":"write'), F.lit(False)).alias("writingPass"))).alias("run"))
    reports = scoring.report(summaries, checks, {}).join(docs.select("doc_id", "doc_name"), "doc_id").join(how, "doc_name", "left")
    reports = materialise(reports.join(summaries.select("doc_id", "document_passed", "document_total"), "doc_id").select("doc_name", "json", "run", "document_passed", "document_total"))
    if runs:
        os.makedirs(runs, exist_ok=True)
        with open(os.path.join(runs, time.strftime("%Y%m%d-%H%M%S") + ".json"), "w", encoding="utf-8") as f:
            f.write('{"reports": [')
            for n, r in enumerate(reports.orderBy("doc_name").toLocalIterator()):
                f.write((",\n" if n else "\n") + json.dumps({"document": r["doc_name"], "report": json.loads(r["json"]), "run": json.loads(r["run"] or "null")}, ensure_ascii=False))
            f.write("\n]}\n")
    return reports


def enrich(spark: SparkSession, outputs: str, registry: str | None = None, fetch: Callable | None = None) -> DataFrame:
    """Enriches finished outputs in place and tells their sidecars; gives the status row of the look-ups."""
    out = materialise(_outputs(spark, outputs).withColumn("doc_id", F.xxhash64("doc_name")))
    records = materialise(out.select("doc_id", F.posexplode("records").alias("sample_idx", "record")))
    names, known, fresh, status = lookup.registries(records, _table(spark, registry, REGISTRY), fetch)
    if registry and fetch is not None:
        fresh.write.mode("append").parquet(registry)
    new, changes, findings = lookup.enrich_records(records, names, known, online=fetch is not None)
    by_name = out.select("doc_id", F.col("doc_name").alias("name"))
    lists = materialise(sinks.record_lists(new, by_name))
    sidecars = spark.read.format("binaryFile").option("pathGlobFilter", "*" + SIDECAR).load(outputs)
    sidecars = sidecars.select(F.xxhash64(F.regexp_extract("path", rf"([^/]*)\{SIDECAR}$", 1)).alias("doc_id"), F.decode("content", "UTF-8").alias("json"))
    told = materialise(sinks.with_enrichment(materialise(sidecars), changes, findings, status).join(by_name, "doc_id"))
    sinks.write_named(lists.select("doc_name", F.col("json").alias("value")), outputs, ".json")
    sinks.write_named(told.select(F.col("name").alias("doc_name"), F.col("json").alias("value")), outputs, SIDECAR)
    return status
