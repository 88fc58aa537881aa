"""Shredding of nested JSON into an adjacency table and from there into flat entity tables.

``shred`` stores every value of every payload as one row (node, parent, label, ordinal, scalar), with
the positions of its record and of the element that owns it. ``entities`` joins the object nodes with
their scalar children, pivoted to columns, once for all entities, and tells them apart by their place;
each row keeps the positions of its record and of its parent.

Defined results:

* null, blank or broken payloads give no nodes, so no rows;
* envelopes (an object that only wraps records, or JSON text inside JSON) are looked through, the
  record's position being its place in the list that holds it, 0 where there is no list;
* a value where a list is expected is the list's only element;
* plain text in place of an object is the object's main field;
* elements without a non-blank main field have no row, but they count in the positions;
* of a key written twice in one object the last value holds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: place: labels from the record down to the node, null below PLACES of them; pos: position in its list, 0 for a
#: value alone; owner_pos: that of the object around it.
NODE_SCHEMA = "row_key bigint, node int, parent int, label string, ordinal int, kind string, scalar string, record_pos int, place string, pos int, owner_pos int"
_ARROW = pa.schema([("row_key", pa.int64()), *((n, pa.string() if n in ("label", "kind", "scalar", "place") else pa.int32()) for n in ("node", "parent", "label", "ordinal", "kind", "scalar", "record_pos", "place", "pos", "owner_pos"))])
PLACES = 3

#: Keys under which senders wrap their records; parameters of shred().
LIST_ENVELOPES = ("records", "data", "content", "items")
OBJECT_ENVELOPES = ("attributes", "record")
#: A record has at least one of these; an object with one of them is never taken for an envelope.
RECORD_KEYS = ("creators", "relatedIdentifiers", "titles", "doi", "contributors", "types", "publisher", "descriptions", "subjects", "dates")


def _refuse(name: str) -> None:
    raise ValueError(name)


def parse(text: str | None) -> object:
    """The value of a JSON text, None if there is none. Non-finite numbers are not JSON."""
    if text is None or not text.strip():
        return None
    try:
        return json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return None


def unwrap(value: object, lists: Sequence[str], objects: Sequence[str], keys: Sequence[str]) -> list[object]:
    """The records of a payload, in the order written."""
    while True:
        if isinstance(value, str):
            inner = parse(value)
            if inner is None or isinstance(inner, str) and inner == value:
                return []
            value = inner
        elif isinstance(value, list):
            return [_single(x, objects, keys) for x in value]
        elif isinstance(value, dict):
            if any(k in value for k in keys):
                return [value]
            inner = next((value[k] for k in (*lists, *objects) if k in value), None)
            if inner is None:
                return [value]
            value = inner
        else:
            return []


def _single(value: object, objects: Sequence[str], keys: Sequence[str]) -> object:
    """An element of a record list without the object that wraps it."""
    while True:
        if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
            inner = parse(value)
            if inner is None:
                return value
            value = inner
        elif isinstance(value, dict) and not any(k in value for k in keys):
            inner = next((value[k] for k in objects if k in value), None)
            if inner is None:
                return value
            value = inner
        else:
            return value


def _text(value: object) -> str | None:
    """A scalar as text; halves of surrogate pairs, which no column can hold, become "?"."""
    if value is None:
        return None
    text = value if isinstance(value, str) else json.dumps(value)
    return text if text.isprintable() else text.encode("utf-8", "replace").decode("utf-8")


def shred(df: DataFrame, key: str, payload: str, lists: Sequence[str] = LIST_ENVELOPES, objects: Sequence[str] = OBJECT_ENVELOPES, keys: Sequence[str] = RECORD_KEYS, labels: Sequence[str] | None = None) -> DataFrame:
    """Adjacency table of the JSON texts in ``payload``: one row per node, roots being the records.

    ``labels``: children of records to keep (None: all). Only the key and payload are read, so
    further columns of df, whatever their names, have no influence.
    """
    keep = None if labels is None else frozenset(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in _ARROW]
            for row_key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                value = parse(text)
                if value is None:
                    continue
                n = 0
                # value, parent, label, ordinal, record, place, position, owner's position, lists around it
                stack = [(r, -1, "record", i, i, "", i, -1, 1) for i, r in enumerate(unwrap(value, lists, objects, keys))]
                stack.reverse()
                while stack:
                    value, parent, label, ordinal, record, place, pos, owner, depth = stack.pop()
                    is_obj, is_list = isinstance(value, dict), isinstance(value, list)
                    row = (row_key, n, parent, _text(label), ordinal, "object" if is_obj else "array" if is_list else "scalar", None if is_obj or is_list else _text(value), record, place, pos, owner)
                    for c, v in zip(cols, row):
                        c.append(v)
                    if is_obj:
                        inner = place is not None and place.count("/") < PLACES
                        stack.extend((v, n, k, i, record, f"{place}/{_text(k)}" if inner else None, 0, pos, 0) for i, (k, v) in enumerate(value.items()) if keep is None or parent >= 0 or k in keep)
                    elif is_list:
                        # Lists within lists hold no elements of their own.
                        within = place if depth == 0 or place is None else f"{place}:"
                        stack.extend((v, n, label, i, record, within, i, owner, depth + 1) for i, v in enumerate(value))
                    n += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _ARROW)], schema=_ARROW)

    return df.select(F.col(key).cast("bigint"), F.col(payload).cast("string")).mapInArrow(run, NODE_SCHEMA)


def _main(field: str) -> Column:
    """An element's main field; plain text in place of the object is that field."""
    return F.when(F.col("kind") == "scalar", F.col("scalar")).otherwise(F.col(f"f_{field}"))


def non_blank(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?U)[^\s\x{1c}-\x{1f}]"), F.lit(False))


CREATOR_FIELDS = ("name", "nameType", "givenName", "familyName")
AFFILIATION_FIELDS = ("name", "affiliationIdentifier", "affiliationIdentifierScheme", "schemeURI")
IDENTIFIER_FIELDS = ("nameIdentifier", "nameIdentifierScheme", "schemeURI")
RELATED_FIELDS = ("relatedIdentifier", "relatedIdentifierType", "relationType", "resourceTypeGeneral")


#: Entity -> place of its elements, its fields (the main one first).
ENTITIES = {
    "creator": ("/creators", CREATOR_FIELDS),
    "affiliation": ("/creators/affiliation", AFFILIATION_FIELDS),
    "nameidentifier": ("/creators/nameIdentifiers", IDENTIFIER_FIELDS),
    "relatedidentifier": ("/relatedIdentifiers", RELATED_FIELDS),
}


def elements(nodes: DataFrame) -> DataFrame:
    """All elements with a value: row_key, entity, record_pos, parent_pos (the creator's position, -1 where
    the parent is the record), item_pos and every entity's fields as f_... columns."""
    names = sorted({f for _, fields in ENTITIES.values() for f in fields})
    scalars = nodes.where((F.col("kind") == "scalar") & F.col("label").isin(*names) & F.col("scalar").isNotNull() & (F.col("parent") >= 0))
    fields = scalars.groupBy("row_key", F.col("parent").alias("node")).agg(*[F.max(F.when(F.col("label") == n, F.col("scalar"))).alias(f"f_{n}") for n in names])
    pick = lambda f: F.coalesce(*[F.when(F.col("place") == place, f(name, own)) for name, (place, own) in ENTITIES.items()])
    items = nodes.where(F.col("place").isin(*[p for p, _ in ENTITIES.values()]) & (F.col("kind") != "array")).select("row_key", "node", "kind", "scalar", "record_pos", "pos", "owner_pos", "place")
    joined = items.join(fields, ["row_key", "node"], "left").withColumn("main", pick(lambda _, own: _main(own[0])))
    nested_in = F.when(F.col("place").startswith("/creators/"), F.col("owner_pos")).otherwise(-1)
    position = lambda c, name: c.cast("bigint").alias(name)
    return joined.where(non_blank(F.col("main"))).select("row_key", pick(lambda name, _: F.lit(name)).alias("entity"), position(F.col("record_pos"), "record_pos"), position(nested_in, "parent_pos"), position(F.col("pos"), "item_pos"), "main", *[f"f_{n}" for n in names])


def entities(nodes: DataFrame) -> dict[str, DataFrame]:
    """Flat tables creator, affiliation, nameidentifier and relatedidentifier.

    Every row has row_key, record_pos, parent_pos, item_pos and the entity's fields.
    """
    every = elements(nodes)
    out = {}
    for name, (_, own) in ENTITIES.items():
        out[name] = every.where(F.col("entity") == name).select("row_key", "record_pos", "parent_pos", "item_pos", F.col("main").alias(own[0].lower()), *[F.col(f"f_{f}").alias(f.lower()) for f in own[1:]])
    return out


def found(df: DataFrame, key: str, payload: str) -> DataFrame:
    """One row per element with a value: (key, record_pos, kind, parent_pos, item_pos)."""
    from lithoflow.session import materialise

    nodes = materialise(shred(df.dropDuplicates([key]), key, payload, labels=("creators", "relatedIdentifiers")))
    return elements(nodes).select(F.col("row_key").alias(key), "record_pos", F.col("entity").alias("kind"), "parent_pos", "item_pos")
