"""Prompts, cached answers and calls of an injected language model.

A call is a memo join: prompts with a known answer are joined, the others go to the callable, once per
distinct key. Failures are rows with an error and never stop the others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoflow import policy as P
from lithoflow import schemas as S
from lithoflow.functions import text as X
from lithoflow.operators.records import empty, listed
from lithoflow.session import materialise
from lithoflow.streaming.loops import loop_reason


def extraction_prompt(text: Column, template: str, most: int = P.PROMPT_CHARS) -> Column:
    """The template with the text's first ``most`` characters in place of {text}."""
    head, _, end = template.partition("{text}")
    return F.concat(F.lit(head), F.left(empty(text), F.lit(most)), F.lit(end))


def style_examples(docs: DataFrame, examples: DataFrame, most: int = P.STYLE_EXAMPLES) -> DataFrame:
    """(source, block): the first ``most`` examples that don't stem from the document itself.

    examples: (pos, title, abstract, source_documents), a short curated list; docs: (source). As a
    document can exclude only its own, the first ones free of it are found without pairing all: the
    leading examples are common, those of the document are looked up.
    """
    ex = examples.select("pos", F.concat(F.lit("Title: "), "title", F.lit("\nAbstract: "), "abstract").alias("block"), listed(F.col("source_documents")).alias("sources"))
    own = ex.select(F.explode("sources").alias("source"), "pos").distinct().groupBy("source").agg(F.collect_set("pos").alias("own"))
    shown = docs.select("source").distinct().join(own, "source", "left")
    ranked = ex.agg(F.array_sort(F.collect_list(F.struct("pos", "block"))).alias("all"))
    blocks = F.slice(F.filter("all", lambda x: ~F.array_contains(F.coalesce("own", F.array().cast("array<int>")), x["pos"].cast("int"))), 1, most)
    return shown.join(F.broadcast(ranked)).select("source", F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n").alias("block"))  # the list is one row


def writing_fields(verified: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sample_idx, code, given_title, given_description, facts, preparation, others) for the second prompt.

    The names of the other samples come from the document's own row; each sample leaves out its own.
    """
    samples = listed(F.col("extraction.samples"))
    name = lambda s: F.left(F.coalesce(F.nullif(s["sampleCode"], F.lit("")), F.nullif(s["givenTitle"], F.lit("")), F.get(listed(s["facts"]), F.lit(0)), F.lit("")), F.lit(P.OTHER_CHARS))
    d = verified.withColumn("names", F.transform(samples, name)).select(key, "extraction", "names", F.posexplode(samples).alias("sample_idx", "s"))
    none = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("(none)"))
    others = F.filter(F.transform("names", lambda n, i: F.when(i != F.col("sample_idx"), n).otherwise("")), lambda n: n != "")
    return d.select(key, "sample_idx", none(F.col("s.sampleCode")).alias("code"), none(F.col("s.givenTitle")).alias("given_title"), none(F.col("s.givenDescription")).alias("given_description"), none(F.array_join(F.transform(listed(F.col("s.facts")), lambda f: F.concat(F.lit("- "), f)), "\n")).alias("facts"), none(F.col("extraction.shared.preparation")).alias("preparation"), none(F.array_join(others, ", ")).alias("others"))


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template with its {names} replaced."""
    out: list[Column] = []
    rest = template
    while (a := rest.find("{")) >= 0 and (b := rest.find("}", a)) >= 0:
        out += [F.lit(rest[:a]), values[rest[a + 1 : b]]]
        rest = rest[b + 1 :]
    return F.concat(*out, F.lit(rest))


def cache_key(prompt: Column, model: str, schema: str = "", options: str = "") -> Column:
    """Fingerprint of everything that an answer depends on."""
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), F.lit(options).alias("options"), prompt.alias("prompt"), F.lit(schema).alias("schema"))), 256)


def collected(answer: str | Iterable[str], most: int | None = None) -> tuple[str, str | None]:
    """(text, reason to give it up) of an answer, which may come in chunks: these are no longer asked for
    once the text runs in circles, looked at every P.LOOP_EVERY chunks, or has ``most`` chunks."""
    if isinstance(answer, str):
        return answer, None
    text = ""
    for n, chunk in enumerate(answer, 1):
        text += chunk
        reason = loop_reason(text) if n % P.LOOP_EVERY == 0 else None
        if reason is None and most is not None and n >= most:
            reason = f"stopped after {most} chunks"
        if reason is not None:
            if hasattr(answer, "close"):
                answer.close()
            return text, reason
    return text, None


def answer(prompts: DataFrame, cache: DataFrame, model: Callable[[str], str | Iterable[str]] | None = None, name: str = "model", parallel: int = 8, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache rows). prompts: (id, prompt); cache: (cache_key, content, model).

    answers: (id, cache_key, content, cached, error, partial). The model gives its answer whole or in
    chunks. An answer that runs in circles, or has ``most`` chunks, is an error with its text kept in
    ``partial``. At most ``parallel`` tasks call the model at once.
    """
    keyed = prompts.withColumn("cache_key", cache_key(F.col("prompt"), name))
    known = keyed.join(cache.select("cache_key", "content").dropDuplicates(["cache_key"]), "cache_key").select("id", "cache_key", "content", F.lit(True).alias("cached"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("partial"))
    if model is None:
        return known, cache.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str | None, str | None, str | None]] = []  # content, error, partial
            for prompt in batch.column(1).to_pylist():
                try:
                    text, reason = collected(model(prompt), most)
                    rows.append((text, None, None) if reason is None else (None, reason, text))
                except Exception as e:  # noqa: BLE001 - one prompt's failure is its own
                    rows.append((None, str(e), None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in zip(*rows))], names=["cache_key", "content", "error", "partial"])

    todo = keyed.join(cache.select("cache_key"), "cache_key", "left_anti").select("cache_key", "prompt").dropDuplicates(["cache_key"])
    called = todo.repartition(parallel).mapInArrow(run, "cache_key string, content string, error string, partial string")
    loop = X.loop_reason(F.col("content"))
    called = materialise(called.select("cache_key", F.when(loop.isNull(), F.col("content")).alias("content"), F.coalesce("error", loop).alias("error"), F.coalesce("partial", F.when(loop.isNotNull(), F.col("content"))).alias("partial")))
    fresh = keyed.select("id", "cache_key").join(called, "cache_key").select("id", "cache_key", "content", F.lit(False).alias("cached"), "error", "partial")
    return known.unionByName(fresh), called.where(F.col("content").isNotNull()).select("cache_key", "content", F.lit(name).alias("model"))


def parse(answers: DataFrame, schema: str = S.EXTRACTION) -> DataFrame:
    """answers with ``value``; content that is no such JSON has a null value and an error."""
    value = F.from_json("content", schema, {"mode": "PERMISSIVE"})
    broken = F.col("content").isNotNull() & F.try_parse_json("content").isNull()
    return answers.withColumn("value", F.when(~broken, value)).withColumn("error", F.coalesce("error", F.when(broken, F.lit("answer is not JSON"))))


def first_of_each(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")
