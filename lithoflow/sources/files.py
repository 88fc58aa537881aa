"""Files as DataFrames: listing with filters, dispatch by format, settings, manifests, examples, outputs."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoflow import policy as P
from lithoflow import schemas as S
from lithoflow.functions import text as X

SUPPORTED, CONVERTIBLE = (".docx", ".pdf"), (".doc", ".odt", ".rtf", ".pages")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]*)\z", 1))


def is_input(path: Column) -> Column:
    """Names that are neither hidden nor lock files and have a known suffix."""
    name = file_name(path)
    return ~name.startswith("~$") & ~name.startswith(".") & suffix(path).isin(*SUPPORTED, *CONVERTIBLE)


def dispatch(path: Column) -> Column:
    """STRUCT<format, fatal, warning> by suffix."""
    s = suffix(path)
    known = s.isin(*SUPPORTED)
    hint = F.when(s.isin(*CONVERTIBLE), F.concat(s, F.lit(" is not supported, please convert to .docx or .pdf"))).when(~known, F.concat(F.lit("unsupported format "), s))
    return F.struct(F.when(known, F.substring(s, 2, 10)).alias("format"), (~known).alias("fatal"), hint.alias("warning"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content) of the input files under a folder, sorted by path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(is_input(F.col("path"))).orderBy("path")


def split_fatal(loaded: DataFrame, most: int = P.PROMPT_CHARS) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) of loaded documents (.., text, warnings, fatal); over-long ones get a warning."""
    blank = ~F.coalesce("text", F.lit("")).rlike(r"(?U)[^\s]")
    d = loaded.withColumn("fatal", F.coalesce("fatal", F.lit(False)) | blank)
    long = F.when(F.length("text") > most, F.array(F.concat(F.lit("longer than "), F.lit(str(most)), F.lit(" characters, the rest isn't shown to the model")))).otherwise(F.array())
    d = d.withColumn("warnings", F.concat(F.coalesce("warnings", F.array().cast("array<string>")), long))
    return d.where(~F.col("fatal")), d.where("fatal")


def settings(text: str, environment: dict[str, str] | None = None) -> dict[str, str]:
    """KEY=VALUE lines with comments and quotes; what the environment has already stays."""
    out = dict(environment or {})
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        key, value = (x.strip() for x in line.split("=", 1))
        if value[:1] in "\"'" and value[:1] and value.endswith(value[:1]) and len(value) > 1:
            value = value[1:-1]
        else:
            value = value.split(" #", 1)[0].strip()
        out.setdefault(key, value)
    return out


def curator(values: dict[str, str], prefix: str = "CURATOR_") -> dict | None:
    """The person of the settings as a contributor; None without a "Family, Given" name."""
    name = values.get(prefix + "NAME", "")
    family, comma, given = (x.strip() for x in name.partition(","))
    if not (family and comma and given):
        return None
    person: dict = {"name": f"{family}, {given}", "nameType": "Personal", "givenName": given, "familyName": family, "nameIdentifiers": [], "affiliation": [], "contributorType": "DataCurator"}
    if m := re.search(P.ORCID, values.get(prefix + "ORCID", "")):
        person["nameIdentifiers"] = [{"nameIdentifier": f"https://orcid.org/{m.group()}", "nameIdentifierScheme": "ORCID", "schemeURI": "https://orcid.org/"}]
    if place := values.get(prefix + "AFFILIATION"):
        entry = {"name": place}
        if m := re.search(P.ROR, "ror.org/" + values.get(prefix + "ROR", "").rsplit("/", 1)[-1]):
            entry |= {"affiliationIdentifier": f"https://ror.org/{m.group(1).lower()}", "affiliationIdentifierScheme": "ROR", "schemeURI": "https://ror.org/"}
        person["affiliation"] = [entry]
    return person


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source, records, selected, draft, note) of a manifest file, a JSON object by file name."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "MAP<STRING, STRING>").alias("m")).select(F.explode("m").alias("source", "j")).where(~F.col("source").startswith("_"))
    e = raw.select("source", F.from_json("j", "STRUCT<records: STRING, `select`: ARRAY<INT>, draft: BOOLEAN, note: STRING>").alias("e")).where("e is not null")
    return e.select("source", "e.records", F.col("e.select").alias("selected"), F.coalesce("e.draft", F.lit(False)).alias("draft"), "e.note")


def selected(records: Column, positions: Column) -> Column:
    """Records at 0-based positions; all if there are none given, positions outside give nothing."""
    return F.when(positions.isNull(), records).otherwise(F.filter(F.transform(positions, lambda i: F.get(records, i)), lambda r: r.isNotNull()))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(path, records): JSON files that hold one record or a list of them."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("j"))
    whole = F.from_json("j", f"ARRAY<{S.RECORD}>")
    return raw.select("path", F.when(F.ltrim("j").startswith("["), whole).otherwise(F.array(F.from_json("j", S.RECORD))).alias("records"))


def style_examples(spark: SparkSession, path: str) -> DataFrame:
    """(pos, title, abstract, source_documents); empty where there is no such file or it is broken."""
    schema = "pos INT, title STRING, abstract STRING, source_documents ARRAY<STRING>"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    e = spark.read.text(path, wholetext=True).select(F.from_json("value", "STRUCT<examples: ARRAY<STRUCT<title: STRING, abstract: STRING, source_documents: ARRAY<STRING>>>>").alias("v"))
    return e.select(F.posexplode(F.coalesce("v.examples", F.array())).alias("pos", "x")).select("pos", "x.title", "x.abstract", F.coalesce("x.source_documents", F.array()).alias("source_documents"))


def identifiers_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.explode(X.identifiers(F.coalesce(F.col(text), F.lit("")))).alias("identifier"))


def dumps(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False, indent=2)
