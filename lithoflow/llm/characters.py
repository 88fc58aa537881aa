"""One plain form for text that looks the same but is written with different characters (problem 4).

The distinct values that hold anything but printable ASCII are exploded to positioned code points.
Broadcast tables, built from the Unicode data of the standard library and so bounded by Unicode's
size, give the decomposition and the combining class of each. Look-alike letters are settled word by
word: a word of mixed alphabets is rewritten in the one it is mainly written in. Combining marks are
ordered by class within their base's segment, the strings are rebuilt and recomposed.

Left as they are: super- and subscripts, Greek letters as symbols, the en dash, quotation marks and
other signs that plain writing uses, words wholly in one alphabet, full-width punctuation within
Chinese or Japanese text, and a joiner that the word's own spelling requires, which is one that most
uses of the word in the data have (of joiners, only those between letters of a joining script count).

Defined results: null and blank values have no plain form but null and are never reported; the plain
form of a plain form is itself.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithoflow.session import growing, materialise

# Letters of other alphabets and the Latin letters they look like.
CYRILLIC_LATIN = dict(zip("АВЕКМНОРСТУХІЅЈаеорсухіѕјһԁԛԝ", "ABEKMHOPCTYXISJaeopcyxisjhdqw"))
GREEK_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχ", "ABEZHIKMNOPTYXaikvopux"))
LATIN_CYRILLIC = {v: k for k, v in CYRILLIC_LATIN.items()}
LATIN_GREEK = {v: k for k, v in GREEK_LATIN.items()}
# Units that a Greek letter as prefix stands before, and hyphens and compatibility signs.
UNITS = ("m", "g", "l", "L", "s", "A", "V", "W", "F", "H", "J", "N", "T", "C", "S", "M", "mol", "Pa", "bar", "Bq", "Sv", "Gy", "Hz", "eV", "cm", "mm", "km")
HYPHENS = "‐‑‒﹣－⁃﹘"
KEPT = "…№™℠ªº¹²³¼½¾´¨¯¸"
ZWNJ, ZWJ = "‌", "‍"
JOINING = r"\p{IsArabic}\p{IsSyriac}\p{IsDevanagari}\p{IsBengali}\p{IsGurmukhi}\p{IsGujarati}\p{IsOriya}\p{IsTamil}\p{IsTelugu}\p{IsKannada}\p{IsMalayalam}\p{IsSinhala}\p{IsMongolian}"
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"


def _parts(c: str) -> list[str] | None:
    """What stands for a code point in decomposed plain text; None: itself, []: nothing."""
    if c in HYPHENS:
        return ["-"]
    category = unicodedata.category(c)
    if c in (ZWNJ, ZWJ) or c in KEPT or "ⁱ" <= c <= "₟" or c in "⁰":
        return None
    if category == "Cf" or c in "͏ᅟᅠ឴឵ㅤﾠ" or "︀" <= c <= "️":
        return []
    if category == "Zs":
        return None if c == " " else [" "]
    if "가" <= c <= "힣":
        return None
    how = unicodedata.decomposition(c)
    if not how:
        return None
    if how.startswith(("<super>", "<sub>", "<fraction>")):
        return None
    parts = unicodedata.normalize("NFKD", c)
    return list(parts) if parts != c else None


@lru_cache(1)
def _tables() -> tuple[list, list]:
    decomposition, marks = [], []
    for n in range(128, sys.maxunicode + 1):
        c = chr(n)
        if 0xD800 <= n < 0xE000:
            continue
        if (p := _parts(c)) is not None:
            decomposition.append((c, p))
        if k := unicodedata.combining(c):
            marks.append((c, k))
    return decomposition, marks


def _lookalikes() -> list[tuple[str, str, str, str]]:
    """(letter, its Latin, Cyrillic and Greek look-alike or itself)."""
    rows = {}
    for latin in {*CYRILLIC_LATIN.values(), *GREEK_LATIN.values()}:
        rows[latin] = (latin, latin, LATIN_CYRILLIC.get(latin, latin), LATIN_GREEK.get(latin, latin))
    for table in (CYRILLIC_LATIN, GREEK_LATIN):
        for letter, latin in table.items():
            rows[letter] = (letter, latin, LATIN_CYRILLIC.get(latin, letter), LATIN_GREEK.get(latin, letter))
    return sorted(rows.values())


def _frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table of fixed content; its size is bounded by Unicode's, so it may be broadcast."""
    names, kinds = zip(*(x.strip().split() for x in schema.split(",")))
    kind = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    return F.broadcast(spark.createDataFrame(pa.table([pa.array(c, kind[k]) for c, k in zip(zip(*rows), kinds)], names=list(names))))


def _recompose(text: Column) -> Column:
    @F.arrow_udf("string")
    def nfc(batch: pa.Array) -> pa.Array:
        return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in batch.to_pylist()], pa.string())

    return nfc(text)


def _required_joiners(words: DataFrame) -> DataFrame:
    """(skeleton, at): joiners that most uses of a word have, the word without any being skeleton.

    ``words``: (word, n) with other invisible characters removed.
    """
    plain = words.select(F.regexp_replace("word", f"[{ZWNJ}{ZWJ}]", "").alias("skeleton"), "word", "n")
    total = plain.groupBy("skeleton").agg(F.sum("n").alias("uses"))
    # A joiner's place is the number of letters before it.
    pieces = F.split("word", f"[{ZWNJ}{ZWJ}]")
    places = (
        plain.where(F.col("word").rlike(f"[{ZWNJ}{ZWJ}]"))
        .select("skeleton", "n", F.explode(F.sequence(F.lit(1), F.size(pieces) - 1)).alias("k"), pieces.alias("pieces"))
        .select("skeleton", "n", F.aggregate(F.slice("pieces", 1, F.col("k")), F.lit(0), lambda a, x: a + F.length(x)).alias("at"))
        .distinct()
        .groupBy("skeleton", "at")
        .agg(F.sum("n").alias("n"))
    )
    return places.join(total, "skeleton").where(F.col("n") * 2 > F.col("uses")).select("skeleton", "at")


def plain_forms(values: DataFrame) -> DataFrame:
    """(value, plain) for the distinct values of ``values`` (value, n: number of uses) that aren't ASCII."""
    spark = values.sparkSession
    decomposition, marks = _tables()
    dec = _frame(spark, decomposition, "ch string, parts array<string>")
    ccc = _frame(spark, marks, "c string, ccc int")
    alike = _frame(spark, _lookalikes(), "c string, latin string, cyrillic string, greek string")
    odd = values.where(F.col("value").rlike(r"[^ -~]") & ~F.col("value").rlike(r"(?U)^[\s\x1c-\x1f]*$"))
    # Code points carry 128 bits of their value's hash, not the value itself.
    odd = odd.select("value", "n", F.xxhash64("value").alias("v1"), F.xxhash64("value", F.lit(1)).alias("v2"))
    by_value = Window.partitionBy("v1", "v2")
    ordered = by_value.orderBy("pos", "sub")

    # Code points and their decomposition. Full-width punctuation beside Chinese or Japanese stays.
    chars = odd.select("v1", "v2", (F.col("value").rlike(f"[{CJK}][！（），：；？～]|[！（），：；？～][{CJK}]")).alias("cjk"), F.posexplode(F.split("value", "")).alias("pos", "ch")).where(F.col("ch") != "")
    chars = chars.join(dec, "ch", "left")
    natural = F.col("ch").rlike("[！（），：；？～]") & F.col("cjk")
    pieces = chars.select("v1", "v2", "pos", F.posexplode(F.when(natural | F.col("parts").isNull(), F.array("ch")).otherwise(F.col("parts"))).alias("sub", "c"))
    pieces = pieces.join(ccc, "c", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))

    # Words: runs of letters, marks, digits and joiners.
    part_of_word = F.col("c").rlike(rf"[\p{{L}}\p{{M}}\p{{N}}{ZWNJ}{ZWJ}]")
    pieces = pieces.withColumn("word_no", F.sum(F.when(part_of_word, 0).otherwise(1)).over(ordered))
    pieces = pieces.withColumn("script", F.when(F.col("c").rlike(r"^\p{IsLatin}$"), "l").when(F.col("c").rlike(r"^\p{IsCyrillic}$"), "c").when(F.col("c").rlike(r"^\p{IsGreek}$"), "g"))
    pieces = pieces.join(alike, "c", "left")

    in_word = Window.partitionBy("v1", "v2", "word_no")
    w_order = in_word.orderBy("pos", "sub")
    count = lambda s: F.sum(F.when(F.col("script") == s, 1).otherwise(0)).over(in_word)
    proper = lambda s, other: F.max(F.when((F.col("script") == s) & (F.col("latin").isNull() | (F.col(other) == F.col("c"))), 1).otherwise(0)).over(in_word)
    pieces = pieces.withColumns({"n_l": count("l"), "n_c": count("c"), "n_g": count("g")})
    mixed = (F.signum("n_l") + F.signum("n_c") + F.signum("n_g")) > 1
    # Letters that only their own alphabet has tell which one the word is written in.
    pieces = pieces.withColumns({
        "own_l": F.max(F.when((F.col("script") == "l") & (F.col("latin").isNull() | F.when(F.col("n_c") >= F.col("n_g"), F.col("cyrillic") == F.col("c")).otherwise(F.col("greek") == F.col("c"))), 1).otherwise(0)).over(in_word),
        "own_c": proper("c", "latin"),
        "own_g": proper("g", "latin"),
        "next_c": F.lead("c").over(w_order),
        "first_in_word": F.row_number().over(w_order) - F.max(F.when(part_of_word, 0).otherwise(1)).over(in_word) == 1,
        "rest": F.concat_ws("", *[F.lead("c", k).over(w_order) for k in range(1, 5)]),  # units have three letters at most
    })
    target = (
        F.when(F.col("own_l") + F.col("own_c") + F.col("own_g") == 1, F.when(F.col("own_l") == 1, "l").when(F.col("own_c") == 1, "c").otherwise("g"))
        .when((F.col("own_l") == 1) & (F.col("n_l") >= F.greatest("n_c", "n_g")), "l")
        .when((F.col("n_c") > F.col("n_l")) & (F.col("n_c") >= F.col("n_g")), "c")
        .when((F.col("n_g") > F.col("n_l")) & (F.col("n_g") > F.col("n_c")), "g")
        .otherwise("l")
    )
    symbol = (F.col("script") == "g") & F.col("first_in_word") & (F.col("rest").isin(*UNITS) | (F.lower("c") == F.col("c")) & F.coalesce(F.col("next_c").rlike(r"^[\p{Lu}\p{N}]$"), F.lit(False)))
    pieces = pieces.withColumn("target", target)
    out = F.when(mixed & F.col("latin").isNotNull() & (F.col("script") != F.col("target")) & ~F.coalesce(symbol, F.lit(False)), F.when(F.col("target") == "l", F.col("latin")).when(F.col("target") == "c", F.col("cyrillic")).otherwise(F.col("greek"))).otherwise(F.col("c"))
    pieces = pieces.select("v1", "v2", "pos", "sub", out.alias("c"), "ccc")

    # Marks are ordered by class within the segment of their base; then the strings are rebuilt.
    pieces = pieces.withColumn("segment", F.sum(F.when(F.col("ccc") == 0, 1).otherwise(0)).over(ordered))
    built = pieces.groupBy("v1", "v2").agg(F.sort_array(F.collect_list(F.struct("segment", "ccc", "pos", "sub", "c"))).alias("cs")).select("v1", "v2", F.array_join(F.transform("cs", lambda x: x["c"]), "").alias("text"))
    built = built.join(growing(odd), ["v1", "v2"]).select("value", "n", _recompose(F.col("text")).alias("text"))

    # Joiners: only those between letters of a joining script can be required.
    has = F.col("text").rlike(f"[{ZWNJ}{ZWJ}]")
    script = rf"[{JOINING}]"
    stray = F.regexp_replace("text", rf"(?<!{script})[{ZWNJ}{ZWJ}]|[{ZWNJ}{ZWJ}](?![{ZWNJ}{ZWJ}]*{script})", "")
    stray = F.regexp_replace(stray, f"([{ZWNJ}{ZWJ}])[{ZWNJ}{ZWJ}]+", "$1")
    # Written once: words, values with joiners and the others are read from it.
    built = materialise(built.withColumn("text", F.when(has, stray).otherwise(F.col("text"))))
    # ASCII values can't hold such words, so the values at hand hold all their uses.
    words = built.where(F.col("text").rlike(script)).select("n", F.explode(F.split("text", r"[^\p{L}\p{M}" + ZWNJ + ZWJ + "]+")).alias("word")).where(F.col("word").rlike(script)).groupBy("word").agg(F.sum("n").alias("n"))
    required = _required_joiners(words).groupBy("skeleton").agg(F.collect_set("at").alias("places"))
    joined = built.where(F.col("text").rlike(f"[{ZWNJ}{ZWJ}]"))
    token = joined.select("value", "text", F.posexplode(F.split("text", r"(?<=[^\p{L}\p{M}" + ZWNJ + ZWJ + r"])|(?=[^\p{L}\p{M}" + ZWNJ + ZWJ + "])")).alias("k", "token"))
    token = token.withColumn("skeleton", F.regexp_replace("token", f"[{ZWNJ}{ZWJ}]", "")).join(required, "skeleton", "left")
    bits = F.split("token", f"(?<=[{ZWNJ}{ZWJ}])")
    kept = F.aggregate(
        bits,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("s")),
        lambda a, x: F.struct(
            (a["at"] + F.length(F.regexp_replace(x, f"[{ZWNJ}{ZWJ}]", ""))).alias("at"),
            F.concat(a["s"], F.when(F.coalesce(F.array_contains("places", a["at"] + F.length(F.regexp_replace(x, f"[{ZWNJ}{ZWJ}]", ""))), F.lit(False)), x).otherwise(F.regexp_replace(x, f"[{ZWNJ}{ZWJ}]", ""))).alias("s"),
        ),
    )["s"]
    token = token.groupBy("value").agg(F.sort_array(F.collect_list(F.struct("k", kept.alias("t")))).alias("ts")).select("value", F.array_join(F.transform("ts", lambda x: x["t"]), "").alias("text"))
    rest = built.where(~F.col("text").rlike(f"[{ZWNJ}{ZWJ}]")).select("value", "text")
    return rest.unionByName(token).withColumnRenamed("text", "plain")


def find(sources: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(source_table, row_id, value, plain) of the rows whose value isn't in plain form.

    ``sources``: (name, table, key column, text column). Rows repeated with the same key count once.
    """
    rows = None
    for name, df, key, text in sources:
        part = df.select(F.lit(name).alias("source_table"), F.col(key).cast("bigint").alias("row_id"), F.col(text).cast("string").alias("value")).where(F.col("value").rlike(r"[^ -~]"))
        rows = part if rows is None else rows.unionByName(part)
    # Distinct values with their uses: a frequent value is handled once (counted before the shuffle).
    values = rows.groupBy("value").agg(F.count("*").alias("n"))
    forms = plain_forms(values).where(~F.col("value").eqNullSafe(F.col("plain")))
    return rows.join(growing(forms), "value").select("source_table", "row_id", "value", "plain").dropDuplicates(["source_table", "row_id"])
