"""Deeply nested records as related flat tables (problem 5).

The schema is merged over all records, of whatever depth. Each array level is then exploded into a child table whose rows
carry their parent's surrogate key and their ordinal. A document's blocks, which nest in themselves, become one table of
blocks, whose surrogate key is the pre-order place, with tables of spans and cells below it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.sources.tables import latest

_SIMPLE = {"BIGINT": T.LongType, "DOUBLE": T.DoubleType, "BOOLEAN": T.BooleanType, "FLOAT": T.DoubleType}


def parse_variant_schema(text: str) -> T.DataType:
    """The type that a merged variant schema describes; conflicting, null and other kinds are strings."""
    at = 0

    def name() -> str:
        nonlocal at
        if text[at] == "`":
            out = ""
            at += 1
            while True:
                end = text.index("`", at)
                out += text[at:end]
                at = end + 1
                if text[at : at + 1] != "`":
                    return out
                out += "`"
                at += 1
        end = text.index(":", at)
        out, at = text[at:end].strip(), end
        return out

    def kind() -> T.DataType:
        nonlocal at
        if text.startswith("ARRAY<", at):
            at += 6
            inner = kind()
            at += 1
            return T.ArrayType(inner)
        if text.startswith("OBJECT<", at):
            at += 7
            fields = []
            while text[at] != ">":
                n = name()
                at += 1  # the colon
                while text[at] == " ":
                    at += 1
                fields.append(T.StructField(n, kind()))
                while text[at] in ", ":
                    at += 1
            at += 1
            return T.StructType(fields)
        end = at
        depth = 0
        while end < len(text) and (depth or text[end] not in ",>"):
            depth += (text[end] == "(") - (text[end] == ")")
            end += 1
        word, at = text[at:end].strip(), end
        if word.startswith("DECIMAL"):
            return T.LongType() if word.endswith(",0)") else T.DoubleType()
        return _SIMPLE.get(word, T.StringType)()

    return kind()


def infer_schema(df: DataFrame, column: str) -> T.DataType:
    """The merged schema of a column of JSON texts, found in one distributed pass over all rows.

    Malformed texts take no part; without any well-formed text the type is an array of empty structs.
    """
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(column)).alias("s")).first()["s"]
    parsed = parse_variant_schema(found) if found else None
    return parsed if isinstance(parsed, (T.ArrayType, T.StructType)) else T.ArrayType(T.StructType([]))


def _arrays(t: T.StructType, under: str = "") -> list[tuple[str, T.ArrayType]]:
    """Arrays of a struct, those inside nested structs included, by their dotted paths."""
    out = []
    for f in t.fields:
        path = f"{under}`{f.name}`"
        if isinstance(f.dataType, T.ArrayType):
            out.append((path, f.dataType))
        elif isinstance(f.dataType, T.StructType):
            out += _arrays(f.dataType, path + ".")
    return out


def _scalars(t: T.StructType, under: str = "") -> list[tuple[str, str]]:
    """(dotted path, flat name) of the scalar fields of a struct and of its nested structs."""
    out = []
    for f in t.fields:
        path = f"{under}`{f.name}`"
        if isinstance(f.dataType, T.StructType):
            out += _scalars(f.dataType, path + ".")
        elif not isinstance(f.dataType, T.ArrayType):
            out.append((path, path.replace("`.`", "__").replace("`", "")))
    return out


def shred(df: DataFrame, key: str, column: str, schema: T.DataType | None = None) -> dict[str, DataFrame]:
    """Flat tables of a column of JSON texts, one for each array level, by the level's path ("$" for the outermost).

    Each row has ``_root`` (the record's key), ``_parent`` (surrogate key of the row it hangs from, null at the top),
    ``_key`` (its own: the ordinals on the way to it, joined by dots), ``_ordinal`` and the level's scalar fields; an array
    of scalars has ``value``. Null arrays and empty arrays have no rows; null elements keep their row and ordinal.
    Malformed texts and null keys have none. Fields that clash with these names keep theirs behind ``__``-paths. Nothing is
    shuffled: every level is exploded where its record is read.
    """
    schema = schema or infer_schema(df, column)
    top = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("_root"), F.from_json(column, schema).alias("_v"))
    out: dict[str, DataFrame] = {}

    def level(rows: DataFrame, values: Column, t: T.ArrayType, path: str) -> None:
        each = rows.select("_root", F.col("_key").alias("_parent"), F.posexplode(values).alias("_ordinal", "_v"))
        each = each.withColumn("_key", F.concat_ws(".", "_parent", F.col("_ordinal").cast("string")))
        inner = t.elementType
        base = ["_root", "_parent", "_key", "_ordinal"]
        if isinstance(inner, T.StructType):
            out[path] = each.select(*base, *[F.col(f"_v.{p}").alias(n if n not in base else f"__{n}") for p, n in _scalars(inner)])
            for p, a in _arrays(inner):
                level(each, F.col(f"_v.{p}"), a, f"{path}.{p.replace('`', '')}")
        elif isinstance(inner, T.ArrayType):
            out[path] = each.select(*base)
            level(each, F.col("_v"), inner, f"{path}[]")
        else:
            out[path] = each.select(*base, F.col("_v").alias("value"))

    rows = top.withColumn("_key", F.lit(None).cast("string"))
    if isinstance(schema, T.StructType):
        out["$"] = top.select("_root", *[F.col(f"_v.{p}").alias(n) for p, n in _scalars(schema)])
        for p, a in _arrays(schema):
            level(rows, F.col(f"_v.{p}"), a, f"$.{p.replace('`', '')}")
    else:
        level(rows, F.col("_v"), schema, "$")
    return out


_SPAN = pa.struct([("t", pa.string()), ("c", pa.bool_()), ("b", pa.bool_()), ("i", pa.bool_()), ("h", pa.string())])
#: Fields of a block and their types.
_FIELDS = {
    "type": pa.string(), "level": pa.int32(), "anchor": pa.string(), "text": pa.string(), "lang": pa.string(), "ordered": pa.bool_(), "header": pa.bool_(),
    "spans": pa.list_(_SPAN), "rows": pa.list_(pa.list_(pa.string())),
}
_SQL = {"type": "string", "level": "int", "anchor": "string", "text": "string", "lang": "string", "ordered": "boolean", "header": "boolean", "spans": "array<struct<t:string,c:boolean,b:boolean,i:boolean,h:string>>", "rows": "array<array<string>>"}
_JSON = json.JSONDecoder(strict=False)


def _string(v: object) -> str | None:
    """A scalar as text; null for null, objects and arrays."""
    return v if isinstance(v, str) else None if v is None or isinstance(v, (dict, list)) else json.dumps(v)


def _bool(v: object) -> bool | None:
    return v if isinstance(v, bool) else None


def _spans(v: object) -> list | None:
    if not isinstance(v, list):
        return None
    return [{"t": _string(s.get("t")), "c": _bool(s.get("c")), "b": _bool(s.get("b")), "i": _bool(s.get("i")), "h": _string(s.get("h"))} if isinstance(s, dict) else None for s in v]


_READ = {
    **dict.fromkeys(("type", "anchor", "text", "lang"), _string), **dict.fromkeys(("ordered", "header"), _bool),
    "level": lambda v: v if isinstance(v, int) and not isinstance(v, bool) and abs(v) < 1 << 31 else None,
    "spans": _spans, "rows": lambda v: [[_string(c) for c in r] if isinstance(r, list) else None for r in v] if isinstance(v, list) else None,
}


def tree(text: str | None) -> list[tuple[int | None, int, int, int, dict]]:
    """(parent's place, depth, i, j, block) of all blocks of a JSON text, in pre-order, which is their place.

    Each array level is opened in turn and hands its rows' key down to the next: items by (i, j), children by (0, j).
    """
    try:
        top = _JSON.raw_decode((text or "").lstrip())[0]
    except (ValueError, RecursionError):
        return []
    out: list = []
    stack = [(None, 0, 0, j, b) for j, b in reversed(list(enumerate(top))) if isinstance(b, dict)] if isinstance(top, list) else []
    while stack:
        row = stack.pop()
        me, depth, b = len(out), row[1] + 1, row[4]
        out.append(row)
        groups = [(i, g) for i, g in enumerate(b["items"])] if isinstance(b.get("items"), list) else []
        if isinstance(b.get("children"), list):
            groups.append((0, b["children"]))
        if groups:
            below = [(me, depth, i, j, c) for i, g in groups if isinstance(g, list) for j, c in enumerate(g) if isinstance(c, dict)]
            stack += reversed(below)
    return out


def _open(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        trees = [tree(t) for t in rb.column("blocks").to_pylist()]
        nodes = [n for t in trees for n in t]
        ends = np.cumsum([0, *map(len, trees)]).astype(np.int32)
        made = [pa.array([n[k] for n in nodes], pa.int32()) for k in range(4)]
        made += [pa.array([_READ[f](n[4].get(f)) for n in nodes], _FIELDS[f]) for f in fields]
        flat = pa.StructArray.from_arrays(made, ["owner_ord", "depth", "i", "j", *(f"_{f}" for f in fields)])
        keep = [rb.column(c) for c in ("id", "indexed_at", "arrived_at")]
        yield pa.RecordBatch.from_arrays([*keep, pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "indexed_at", "arrived_at", "nodes"])


def block_rows(docs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One row per block of the current documents: id, ord, owner_ord, depth, i, j and the block's fields.

    ord is the place in the pre-order walk and the block's surrogate key, owner_ord that of the parent (null for a
    top-level block), i the item's number (0 in a quote and at the top), j the place within. Documents with null, malformed
    or empty blocks, or with something else than an array, have no rows; a field of another kind than its own is null in
    its block alone, whatever stands in others, but scalars are read as text where text is wanted; null blocks are skipped
    but keep their place; rows of unequal length and absent fields are kept as they are. ``fields`` names the block's
    fields to carry (all of them if None), so that no more than these are shuffled, once, by id. Blocks may nest to any
    depth: a document is opened where it is read, and the row's type is the same at each level.
    """
    fields = list(_FIELDS) if fields is None else fields
    node = ",".join(["owner_ord:int", "depth:int", "i:int", "j:int", *(f"_{f}:{_SQL[f]}" for f in fields)])
    rows = docs.select("id", *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("indexed_at", "arrived_at")], "blocks")
    opened = rows.mapInArrow(lambda it: _open(it, fields), f"id string, indexed_at long, arrived_at long, nodes array<struct<{node}>>")
    each = latest(opened, ["nodes"]).select("id", F.posexplode("nodes").alias("ord", "n"))
    return each.select("id", "ord", *[F.col(f"n.{c}").alias(c) for c in ("owner_ord", "depth", "i", "j")], *[F.col(f"n._{f}").alias(f) for f in fields])


def span_rows(blocks: DataFrame) -> DataFrame:
    """(id, ord, place, t, c, b, i, h): the spans of block_rows, tied to their block by (id, ord)."""
    return blocks.select("id", "ord", F.posexplode("spans").alias("place", "s")).select("id", "ord", "place", "s.*")


def cell_rows(blocks: DataFrame) -> DataFrame:
    """(id, ord, row, col, cell): the cells of block_rows, tied to their table by (id, ord); null cells are kept."""
    rows = blocks.select("id", "ord", F.posexplode("rows").alias("row", "r"))
    return rows.select("id", "ord", "row", F.posexplode("r").alias("col", "cell"))


def nested_places(docs: DataFrame) -> DataFrame:
    """(id, kind, owner_ord, i, j): nested blocks, links and non-null cells with the place of what they belong to."""
    b = block_rows(docs, ["spans", "rows"])
    links = F.filter(F.transform("spans", lambda s, k: F.struct(F.lit("link").alias("kind"), F.col("ord").alias("owner_ord"), F.lit(0).alias("i"), k.alias("j"), s["h"].isNotNull().alias("on"))), lambda x: x["on"])
    cells = F.flatten(F.transform("rows", lambda r, i: F.coalesce(F.transform(r, lambda c, j: F.struct(F.lit("cell").alias("kind"), F.col("ord").alias("owner_ord"), i.alias("i"), j.alias("j"), c.isNotNull().alias("on"))), F.array().cast(_PLACES))))
    own = F.when(F.col("owner_ord").isNotNull(), F.array(F.struct(F.lit("block").alias("kind"), F.col("owner_ord"), F.col("i"), F.col("j"), F.lit(True).alias("on"))))
    none = F.array().cast(_PLACES)
    every = F.concat(*[F.coalesce(x.cast(_PLACES), none) for x in (own, links, cells)])
    return b.select("id", F.explode(every).alias("p")).filter("p.on").select("id", "p.kind", "p.owner_ord", "p.i", "p.j")


_PLACES = "array<struct<kind:string,owner_ord:int,i:int,j:int,on:boolean>>"
