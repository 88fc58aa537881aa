"""Outputs: records as JSON, provenance, a readable report, each as a column before it is written."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithoflow.functions import text as X
from lithoflow.operators.records import empty, listed


def record_lists(records: DataFrame, names: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, doc_name, json): the document's records as one JSON list, in order of the samples."""
    lists = records.groupBy(key).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "record"))), lambda x: x["record"])).alias("json"))
    return lists.join(names, key).select(key, X.safe_name(F.col("name")).alias("doc_name"), "json")


def provenance(docs: DataFrame, changes: DataFrame, findings: DataFrame, run: dict[str, str], passes: DataFrame | None = None, enrichment: DataFrame | None = None, evaluation: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, json): how a document's records came about.

    docs: (key, text[, filename, format, warnings]), whose further columns describe the source; passes: (key,
    pass, and whatever is told of a call); enrichment and evaluation: (key, json), a JSON object each. Parts
    that a document doesn't have are empty lists or null.
    """
    told = [c for c in ("filename", "format", "warnings") if c in docs.columns]
    source = docs.select(key, F.struct(*told, F.sha2(empty(F.col("text")), 256).alias("sha256"), F.length(empty(F.col("text"))).alias("chars")).alias("source"))
    ordered = lambda df, at, what: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*at, what.alias("x")))), lambda v: v["x"]).alias("xs"))
    said = ordered(changes, [F.coalesce("sample_idx", F.lit(-1)).alias("i"), F.col("seq")], F.col("message")).withColumnRenamed("xs", "postprocessing")
    issues = ordered(findings, [F.col("finding_no")], F.struct("severity", "kind", "path", "value", "message")).withColumnRenamed("xs", "findings")
    errors = findings.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("n_errors"))
    d = source.join(said, key, "left").join(issues, key, "left").join(errors, key, "left")
    parts = {}
    if passes is not None:
        calls = passes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*["pass", *(c for c in passes.columns if c not in (key, "pass"))]))).alias("passes"))
        d = d.join(calls, key, "left")
    for name, part in (("enrichment", enrichment), ("evaluation", evaluation)):
        if part is not None:
            d = d.join(part.select(key, F.parse_json("json").alias(name)), key, "left")
        parts[name] = F.col(name) if part is not None else F.lit(None).cast("variant")
    settings = [F.lit(v).alias(k) for k, v in sorted(run.items())]
    fields = [F.col("source"), (F.coalesce("passes", F.array()) if passes is not None else F.array().cast("array<string>")).alias("passes"), F.coalesce("postprocessing", F.array().cast("array<string>")).alias("postprocessing"), *[c.alias(n) for n, c in parts.items()], F.struct(F.coalesce("findings", F.array()).alias("findings"), F.coalesce("n_errors", F.lit(0)).alias("errorCount")).alias("validation")]
    return d.select(key, F.to_json(F.struct(*settings, *fields)).alias("json"))


def with_enrichment(sidecars: DataFrame, changes: DataFrame, findings: DataFrame, status: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, json): finished sidecars with what a later enrichment changed, found and how its look-ups went.

    sidecars: (key, json); changes: (key, message); findings: (key, severity, kind, path, value, message); status:
    one row. Changes and findings are appended, the number of errors stays as it was counted.
    """
    more = changes.groupBy(key).agg(F.array_sort(F.collect_set("message")).alias("messages"))
    found = findings.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("severity", "kind", "path", "value", "message"))).alias("new_findings"))
    d = sidecars.join(more, key, "left").join(found, key, "left").join(F.broadcast(status.select(F.to_json(F.struct(*status.columns)).alias("status"))))  # one row

    @F.arrow_udf("string")
    def put(json_: pa.Array, messages: pa.Array, new: pa.Array, state: pa.Array) -> pa.Array:
        out = []
        for text, said, issues, how in zip(json_.to_pylist(), messages.to_pylist(), new.to_pylist(), state.to_pylist()):
            whole = json.loads(text)
            whole.setdefault("postprocessing", []).extend(said or [])
            whole["enrichment"] = json.loads(how)
            whole.setdefault("validation", {"findings": [], "errorCount": 0})["findings"].extend(issues or [])
            out.append(json.dumps(whole, ensure_ascii=False))
        return pa.array(out, pa.string())

    return d.select(key, put("json", "messages", "new_findings", "status").alias("json"))


def report(record: Column) -> Column:
    """A record as a Markdown page."""
    people = lambda ps: F.array_join(F.transform(listed(ps), lambda p: F.concat(F.lit("- "), empty(p["name"]), F.array_join(F.transform(listed(p["nameIdentifiers"]), lambda i: F.concat(F.lit(" ("), empty(i["nameIdentifier"]), F.lit(")"))), ""), F.array_join(F.transform(listed(p["affiliation"]), lambda a: F.concat(F.lit(", "), empty(a["name"]))), ""))), "\n")
    bullets = lambda items, f: F.array_join(F.transform(listed(items), lambda x: F.concat(F.lit("- "), f(x))), "\n")
    section = lambda head, body: F.when(empty(body) != "", F.concat(F.lit(f"## {head}\n"), body))
    top = F.concat(F.lit("# "), F.coalesce(F.get(record["titles"], F.lit(0))["title"], F.lit("(no title)")))
    facts = F.array_join(F.filter(F.array(*[F.when(empty(v) != "", F.concat(F.lit(f"{k}: "), v)) for k, v in (("DOI", record["doi"]), ("URL", record["url"]), ("Year", record["publicationYear"]))]), lambda x: x.isNotNull()), "\n")
    parts = [top, F.nullif(facts, F.lit("")), section("Creators", people(record["creators"])), section("Contributors", people(record["contributors"])), section("Descriptions", F.array_join(F.transform(listed(record["descriptions"]), lambda d: empty(d["description"])), "\n\n")), section("Keywords", F.array_join(F.transform(listed(record["subjects"]), lambda s: empty(s["subject"])), ", ")), section("Resource", F.concat_ws(", ", record["types"]["resourceTypeGeneral"], record["types"]["resourceType"])), section("Publisher", record["publisher"]["name"]), section("Dates", bullets(record["dates"], lambda d: F.concat_ws(" ", d["date"], F.concat(F.lit("("), d["dateType"], F.lit(")"))))), section("Related identifiers", bullets(record["relatedIdentifiers"], lambda r: F.concat_ws(" ", r["relationType"], r["relatedIdentifier"])))]
    return F.concat_ws("\n\n", *parts)


def write_json(lists: DataFrame, path: str) -> None:
    """One folder per document name, each with its text file of JSON; replaces what was there."""
    lists.select("doc_name", F.col("json").alias("value")).write.mode("overwrite").partitionBy("doc_name").text(path)


def write_named(texts: DataFrame, path: str, ending: str) -> None:
    """Files NAME + ending under a folder, one a row of (doc_name, value); what was there is replaced.

    Written from the tasks through the file system of ``path``; the folder must be one that all share.
    """
    root = path.removeprefix("file:")

    def run(batches):
        import os

        os.makedirs(root, exist_ok=True)
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = os.path.join(root, name + ending)
                with open(at + ".part", "w", encoding="utf-8") as f:
                    f.write(value)
                os.replace(at + ".part", at)
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["doc_name"])

    texts.select("doc_name", "value").mapInArrow(run, "doc_name string").write.format("noop").mode("overwrite").save()
