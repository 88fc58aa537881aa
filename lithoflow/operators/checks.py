"""Data-quality rules over records and their source text; each gives findings (schemas.FINDINGS).

Rules that compare with the source take ``wide``: one row per record with its nested record and the
document's compared form. Containment is tested within the row, so no text is shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoflow import policy as P
from lithoflow.functions import text as X
from lithoflow.operators.records import empty, listed


def leaves(c: Column, kind: T.DataType, path: Column) -> Column:
    """ARRAY<STRUCT<path, value>> of all text leaves of a nested column, paths as a.b[0].c."""
    if isinstance(kind, T.StructType):
        parts = [leaves(c[f.name], f.dataType, F.concat(path, F.when(path == "", F.lit("")).otherwise(F.lit(".")), F.lit(f.name))) for f in kind.fields]
        return F.concat(*parts)
    if isinstance(kind, T.ArrayType):
        return F.flatten(F.transform(listed(c), lambda x, i: leaves(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
    return F.filter(F.array(F.when(c.isNotNull(), F.struct(path.alias("path"), c.cast("string").alias("value")))), lambda x: x.isNotNull())


def walk_json(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, path, value) of the leaves of JSON of any shape, level by level, from the adjacency table of the shredder."""
    from lithoflow.operators.shred import shred
    from lithoflow.session import materialise

    nodes = materialise(shred(df, key, payload, lists=(), objects=(), keys=()))
    # Arrays at the top are taken as records; their position begins the path.
    done = None
    level = nodes.where("parent = -1").select("row_key", "node", "kind", "scalar", F.when(F.col("ordinal") > 0, F.concat(F.lit("["), F.col("ordinal"), F.lit("]"))).otherwise(F.lit("")).alias("path"))
    while True:
        part = level.where("kind = 'scalar'").select(F.col("row_key").alias(key), "path", F.col("scalar").alias("value"))
        done = part if done is None else done.unionByName(part)
        inner = level.where("kind <> 'scalar'").select("row_key", F.col("node").alias("parent"), F.col("kind").alias("p_kind"), F.col("path").alias("p_path"))
        child = nodes.join(inner, ["row_key", "parent"])
        step = F.when(F.col("p_kind") == "array", F.concat(F.col("p_path"), F.lit("["), F.col("ordinal").cast("string"), F.lit("]"))).otherwise(F.concat(F.col("p_path"), F.when(F.col("p_path") == "", F.lit("")).otherwise(F.lit(".")), F.col("label")))
        level = materialise(child.select("row_key", "node", "kind", "scalar", step.alias("path")))
        if level.isEmpty():
            return done


def _findings(df: DataFrame, items: Column, severity: str, kind: Column | str, message: str, rule: int) -> DataFrame:
    """items: ARRAY<STRUCT<path, value[, kind]>> of each row."""
    e = df.select("doc_id", "sample_idx", F.posexplode(items).alias("seq", "x"))
    return e.select("doc_id", "sample_idx", F.lit(severity).alias("severity"), (F.col("x.kind") if kind is None else F.lit(kind)).alias("kind"), F.col("x.path").alias("path"), F.col("x.value").alias("value"), F.lit(message).alias("message"), F.lit(rule).alias("rule"), "seq")


def without_curators(contributors: Column) -> Column:
    return F.filter(listed(contributors), lambda c: empty(c["contributorType"]) != "DataCurator")


def unknown_identifiers(wide: DataFrame) -> DataFrame:
    """Identifiers in the record that the document doesn't have."""
    kind = wide.schema["record"].dataType
    record = F.col("record").withField("contributors", without_curators(F.col("record.contributors")))
    texts = F.filter(leaves(record, kind, F.lit("")), lambda x: ~x["path"].startswith("publisher."))
    def hits(name: str, pattern: str, group: int) -> Column:
        return F.flatten(F.transform(texts, lambda x: F.transform(X.extract_all(x["value"], pattern, group), lambda v: F.struct(x["path"].alias("path"), v.alias("value"), F.lit(name).alias("kind")))))

    found = [hits("orcid", P.ORCID, 0), hits("doi", P.DOI, 0), hits("ror", P.ROR, 1)]
    missing = F.filter(F.concat(*found), lambda x: ~X.contains(F.col("norm0"), X.norm0(x["value"])))
    return _findings(wide, missing, "error", None, "the document doesn't have this identifier", 1)


def unknown_names(wide: DataFrame) -> DataFrame:
    """Family names that the document doesn't have."""
    def of(people: Column, name: str) -> Column:
        family = lambda p: F.trim(F.coalesce(F.nullif(p["familyName"], F.lit("")), F.split(empty(p["name"]), ",")[0]))
        return F.filter(F.transform(people, lambda p, i: F.struct(F.concat(F.lit(f"{name}["), i.cast("string"), F.lit("].name")).alias("path"), family(p).alias("value"))), lambda x: (x["value"] != "") & ~X.contains(F.col("norm0"), X.norm0(x["value"])))

    items = F.concat(of(listed(F.col("record.creators")), "creators"), of(without_curators(F.col("record.contributors")), "contributors"))
    return _findings(wide, items, "error", "creator-name", "the document doesn't have this family name", 2)


def fixed_fields(wide: DataFrame, policy: P.Policy | None = None) -> DataFrame:
    """Fields that aren't what the repository sets."""
    policy = policy or P.Policy()
    one = lambda path, c, v: F.when(~c.eqNullSafe(F.lit(v)), F.struct(F.lit(path).alias("path"), empty(c).alias("value")))
    items = F.filter(F.array(one("schemaVersion", F.col("record.schemaVersion"), policy.schema_version), one("publisher.name", F.col("record.publisher.name"), policy.publisher["name"])), lambda x: x.isNotNull())
    return _findings(wide, items, "warning", "fixed-field", "not the value that the repository sets", 3)


def date_in_source(value: Column, norm0: Column) -> Column:
    """Every part of a date or interval is written in the text in some form."""
    parts = F.filter(F.split(value, "/"), lambda p: p != "")
    return X.let(norm0, lambda n: F.forall(parts, lambda p: F.exists(X.date_forms(p), lambda f: X.contains(n, X.norm0(f)))))


def unknown_dates(wide: DataFrame) -> DataFrame:
    items = F.filter(F.transform(listed(F.col("record.dates")), lambda d, i: F.struct(F.concat(F.lit("dates["), i.cast("string"), F.lit("].date")).alias("path"), empty(d["date"]).alias("value"))), lambda x: ~date_in_source(x["value"], F.col("norm0")))
    return _findings(wide, items, "warning", "date", "the document writes this date in no known form", 4)


def new_numbers(text: Column, source_numbers: Column) -> Column:
    """Numbers of a text that the source lacks, sorted as text, joined; "" if none."""
    return F.array_join(F.array_sort(F.array_except(X.numbers(text), source_numbers)), ", ")


def unknown_numbers(wide: DataFrame) -> DataFrame:
    first = F.struct(F.lit("titles[0].title").alias("path"), empty(F.get(F.col("record.titles"), F.lit(0))["title"]).alias("t"))
    texts = F.concat(F.array(first), F.transform(listed(F.col("record.descriptions")), lambda d, i: F.struct(F.concat(F.lit("descriptions["), i.cast("string"), F.lit("].description")).alias("path"), empty(d["description"]).alias("t"))))
    items = F.filter(F.transform(texts, lambda x: F.struct(x["path"].alias("path"), new_numbers(x["t"], F.col("numbers")).alias("value"))), lambda x: x["value"] != "")
    return _findings(wide, items, "warning", "number", "the document doesn't have these numbers", 5)


def created_dates(wide: DataFrame) -> DataFrame:
    made = F.filter(listed(F.col("record.dates")), lambda d: d["dateType"] == "Created")
    items = F.when(F.size(made) > 1, F.array(F.struct(F.lit("dates").alias("path"), F.array_join(F.transform(made, lambda d: empty(d["date"])), ", ").alias("value")))).otherwise(F.array().cast("array<struct<path:string,value:string>>"))
    return _findings(wide, items, "warning", "dates", "several dates of creation, only one can be right", 6)


def missing_identifiers(wide: DataFrame) -> DataFrame:
    """Identifiers in the document that the record lacks."""
    kind = wide.schema["record"].dataType
    told = X.norm0(F.array_join(F.transform(leaves(F.col("record"), kind, F.lit("")), lambda x: x["value"]), " "))
    def of(name: str, pattern: str) -> Column:
        bare = F.transform(X.extract_all(F.coalesce("text", F.lit("")), pattern), lambda v: F.regexp_replace(v, r"[.,;:)]+$", ""))
        return F.transform(F.array_sort(F.array_distinct(bare)), lambda v: F.struct(F.lit("").alias("path"), v.alias("value"), F.lit(f"missing-{name}").alias("kind")))

    found = [of("orcid", P.ORCID), of("doi", P.DOI)]
    items = X.let(told, lambda t: F.filter(F.concat(*found), lambda x: ~X.contains(t, X.norm0(x["value"]))))
    return _findings(wide, items, "warning", None, "the document has it, the record doesn't", 7)


def duplicate_titles(titles: DataFrame, group: str = "doc_id", position: str = "sample_idx", title: str = "title") -> DataFrame:
    """Rows whose title an earlier row of the group has, with the first such row's position.

    Blank titles count as equal. The first position per title is an aggregate, not a window, so a
    group of many equal titles is combined before it is shuffled.
    """
    t = titles.select(group, position, F.lower(F.trim(empty(F.col(title)))).alias("key"))
    first = t.groupBy(group, "key").agg(F.min(position).alias("first_idx"))
    return t.join(first, [group, "key"]).where(F.col(position) > F.col("first_idx")).select(group, position, F.col("key").alias("value"), "first_idx")


def model_notes(texts: DataFrame) -> DataFrame:
    """Non-blank doubts that the model noted. texts: (doc_id, sample_idx, written)."""
    items = F.transform(F.filter(listed(F.col("written.issues")), lambda i: F.trim(empty(i)) != ""), lambda i: F.struct(F.lit("").alias("path"), F.trim(i).alias("value")))
    return _findings(texts, items, "warning", "model-note", "doubt of the model", 0)


def check_all(records: DataFrame, prepared: DataFrame, texts: DataFrame | None = None, policy: P.Policy | None = None) -> DataFrame:
    """All findings in reporting order: per document, then sample, then severity, rule and place."""
    wide = records.join(prepared.select("doc_id", "text", "norm0", "numbers"), "doc_id", "left")
    rules = [unknown_identifiers(wide), unknown_names(wide), fixed_fields(wide, policy), unknown_dates(wide), unknown_numbers(wide), created_dates(wide), missing_identifiers(wide)]
    same = duplicate_titles(records.select("doc_id", "sample_idx", F.get(F.col("record.titles"), F.lit(0))["title"].alias("title")))
    rules.append(same.select("doc_id", "sample_idx", F.lit("warning").alias("severity"), F.lit("duplicate-title").alias("kind"), F.lit("titles[0]").alias("path"), "value", F.concat(F.lit("title of sample "), (F.col("first_idx") + 1).cast("string"), F.lit(" again")).alias("message"), F.lit(-1).alias("rule"), F.lit(0).alias("seq")))
    if texts is not None:
        rules.append(model_notes(texts))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(9)
    w = Window.partitionBy("doc_id").orderBy(F.when(F.col("rule") < 1, F.col("rule")).otherwise(1), "sample_idx", rank, "rule", "seq")
    return out.withColumn("finding_no", F.row_number().over(w))


def summary(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    return findings.groupBy(key).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
