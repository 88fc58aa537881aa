"""python -m lithoflow run | evaluate | enrich | preview | query | names (see --help of each)"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser("lithoflow")
    sub = parser.add_subparsers(dest="what", required=True)
    r = sub.add_parser("run", help="documents of a folder to records, sidecars and pages")
    r.add_argument("folder")
    r.add_argument("out")
    r.add_argument("--extraction", required=True, help="file with the template of the first prompt, {text} standing for the document")
    r.add_argument("--writing", help="file with the template of the second prompt; without it titles and abstracts come from the document")
    r.add_argument("--model", help="function that answers a prompt, module:function")
    r.add_argument("--name", default="model", help="the model's name, part of the answers' keys")
    r.add_argument("--cache", help="Parquet table of answers")
    r.add_argument("--no-lookup", action="store_true", help="ask no registries")
    r.add_argument("--manifest", help="curated records to score against")
    e = sub.add_parser("evaluate", help="score outputs against curated records")
    e.add_argument("manifest")
    e.add_argument("outputs")
    e.add_argument("folder", help="the documents")
    e.add_argument("--runs", help="folder for the run file")
    e.add_argument("--details", action="store_true", help="show whole reports")
    n = sub.add_parser("enrich", help="put registered names and identifiers into finished outputs")
    n.add_argument("outputs")
    n.add_argument("--offline", action="store_true", help="cached answers only")
    for p in (r, n):
        p.add_argument("--registry", help="Parquet table of the registries' answers")
        p.add_argument("--fetch", help="function that gets an address, module:function")
    sub.add_parser("preview", help="load the documents of a folder and show their text and warnings").add_argument("folder")
    q = sub.add_parser("query", help="run a registered query and show its first rows")
    q.add_argument("name")
    q.add_argument("folder")
    q.add_argument("--rows", type=int, default=20)
    sub.add_parser("names", help="list the registered queries")
    return parser


def _read(path: str | None) -> str | None:
    if path is None:
        return None
    with open(path, encoding="utf-8") as f:
        return f.read()


def main(args: list[str] | None = None) -> int:
    given = _parser().parse_args(args)

    from lithoflow.plans import commands, queries

    if given.what == "names":
        print("\n".join(sorted(queries.all_queries())))
        return 0
    spark = SparkSession.builder.getOrCreate()
    if given.what == "query":
        queries.all_queries()[given.name](spark, given.folder).show(given.rows, truncate=100)
        return 0
    if given.what == "run":
        _, result = commands.run(spark, given.folder, given.out, _read(given.extraction), _read(given.writing), commands.function(given.model), given.name, given.cache, given.registry, commands.function(given.fetch), not given.no_lookup, given.manifest)
        result.findings.groupBy("severity", "kind").count().orderBy("severity", "kind").show(truncate=False)
        result.rejected.show(truncate=False)
        return 0
    if given.what == "evaluate":
        reports = commands.evaluate(spark, given.manifest, given.outputs, given.folder, given.runs)
        reports.select("doc_name", "document_passed", "document_total", *(["json"] if given.details else [])).show(truncate=False)
        reports.agg(F.sum("document_passed").alias("passed"), F.sum("document_total").alias("total")).show()
        return 0
    if given.what == "enrich":
        status = commands.enrich(spark, given.outputs, given.registry, None if given.offline else commands.function(given.fetch))
        status.show(truncate=False)
        return int(status.first()["failed"] > 0)
    docs, rejected = commands.load(spark, given.folder)
    docs.select("filename", "warnings", "text").show(truncate=False)
    rejected.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
