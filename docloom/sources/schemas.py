"""Structural schemas of documents: unions of types, optional fields, satisfaction, and inference as a Spark job.

A schema is JSON-schema text as a dictionary: ``bsonType``, ``properties``, ``required``, ``additionalProperties``,
``items``, ``anyOf``; ``{}`` is any value.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ATOM = {T.StringType: "string", T.BooleanType: "bool", T.IntegerType: "int", T.ShortType: "int", T.ByteType: "int", T.LongType: "long", T.DoubleType: "double", T.FloatType: "double", T.TimestampType: "date", T.TimestampNTZType: "date", T.DateType: "date", T.BinaryType: "binData", T.NullType: "null"}
_BACK = {"string": T.StringType, "bool": T.BooleanType, "int": T.IntegerType, "long": T.LongType, "double": T.DoubleType, "date": T.TimestampType, "binData": T.BinaryType, "null": T.NullType, "objectId": T.StringType}
_WIDENING = ("int", "long", "double", "decimal")


def options(schema: dict) -> list[dict]:
    """The alternatives of a schema, none of them a union; a list of types is a union as well."""
    if "anyOf" in schema:
        return [o for s in schema["anyOf"] for o in options(s)]
    kind = schema.get("bsonType")
    return [{**schema, "bsonType": k} for k in kind] if isinstance(kind, list) else [schema]


def union(*schemas: dict) -> dict:
    """What satisfies one of the schemas; documents and arrays are merged, and {} takes in everything."""
    found: dict[str, dict] = {}
    for s in (o for x in schemas for o in options(x)):
        kind = s.get("bsonType")
        if kind is None:
            return {}
        if kind not in found:
            found[kind] = s
        elif kind == "object":
            a, b = found[kind], s
            names = [*a.get("properties", {}), *(n for n in b.get("properties", {}) if n not in a.get("properties", {}))]
            merged = {n: union(*(x["properties"][n] for x in (a, b) if n in x.get("properties", {}))) for n in names}
            found[kind] = {"bsonType": kind, "properties": merged, "required": sorted(set(a.get("required", [])) & set(b.get("required", []))), "additionalProperties": a.get("additionalProperties", False) or b.get("additionalProperties", False)}
        elif kind == "array":
            found[kind] = {"bsonType": kind, "items": union(found[kind].get("items", {}), s.get("items", {}))}
    kinds = [found[k] for k in sorted(found)]
    return kinds[0] if len(kinds) == 1 else {"anyOf": kinds}


def satisfies(schema: dict, kinds: set[str]) -> str:
    """'must', 'may' or 'not': whether values of the schema are of one of the kinds."""
    each = [None if "bsonType" not in o else o["bsonType"] in kinds for o in options(schema)]
    return "may" if None in each or len(set(each)) > 1 else "must" if each and each[0] else "not"


def contains_field(schema: dict, name: str) -> str:
    """'must', 'may' or 'not': whether documents of the schema have the field."""
    each = []
    for o in options(schema):
        if o.get("bsonType") not in (None, "object"):
            each.append("not")
        elif "bsonType" not in o or (name not in o.get("properties", {}) and o.get("additionalProperties")):
            each.append("may")
        else:
            each.append("must" if name in o.get("required", []) else "may" if name in o.get("properties", {}) else "not")
    return each[0] if len(set(each)) == 1 else "may"


def comparable(a: dict, b: dict) -> str:
    """Whether values of the two can be compared: numbers with each other, NULL with all, others with their own kind."""
    group = lambda k: "number" if k in _WIDENING else k
    each = set()
    for x in options(a):
        for y in options(b):
            k, m = x.get("bsonType"), y.get("bsonType")
            each.add("may" if None in (k, m) else "must" if "null" in (k, m) or group(k) == group(m) else "not")
    return each.pop() if len(each) == 1 else "may"


def paths(schema: dict, prefix: str = "") -> Iterator[tuple[str, dict]]:
    """All dotted field paths with their schemas."""
    for o in options(schema):
        for n, s in o.get("properties", {}).items():
            yield prefix + n, s
            yield from paths(s, f"{prefix}{n}.")


def from_spark(kind: T.DataType, nullable: bool = False) -> dict:
    if isinstance(kind, T.StructType):
        out = {"bsonType": "object", "properties": {f.name: from_spark(f.dataType, f.nullable) for f in kind.fields}, "required": sorted(f.name for f in kind.fields), "additionalProperties": False}
    elif isinstance(kind, T.ArrayType):
        out = {"bsonType": "array", "items": from_spark(kind.elementType, kind.containsNull)}
    elif isinstance(kind, T.DecimalType):
        out = {"bsonType": "decimal"}
    elif isinstance(kind, T.VariantType):
        return {}
    else:
        out = {"bsonType": _ATOM[type(kind)]}
    return union(out, {"bsonType": "null"}) if nullable else out


def to_spark(schema: dict) -> T.DataType:
    """The type that holds all values: widened numbers, closed documents, a variant where kinds differ."""
    kinds = [o for o in options(schema) if o.get("bsonType") != "null"]
    names = [o.get("bsonType") for o in kinds]
    if not kinds:
        return T.NullType() if options(schema) else T.VariantType()
    if None in names:
        return T.VariantType()
    if all(n in _WIDENING for n in names):
        widest = max(names, key=_WIDENING.index)
        return T.DecimalType(38, 18) if widest == "decimal" else _BACK[widest]()
    if len(kinds) > 1:
        return T.VariantType()
    if names[0] == "object":
        if kinds[0].get("additionalProperties"):
            return T.VariantType()
        required = kinds[0].get("required", [])
        fields = kinds[0].get("properties", {}).items()
        return T.StructType([T.StructField(n, to_spark(s), not (n in required and satisfies(s, {"null"}) == "not")) for n, s in fields])
    if names[0] == "array":
        return T.ArrayType(to_spark(kinds[0].get("items", {})))
    return _BACK[names[0]]()


def _visit(value, path: str, seen: Counter) -> None:
    kind = "null" if value is None else "bool" if isinstance(value, bool) else "string" if isinstance(value, str) else "double" if isinstance(value, float) else "array" if isinstance(value, list) else "object" if isinstance(value, dict) else "int" if -(1 << 31) <= value < 1 << 31 else "long"
    if kind == "object" and len(value) == 1 and next(iter(value)) in ("$date", "$oid", "$numberDecimal", "$numberLong"):
        kind = {"$date": "date", "$oid": "objectId", "$numberDecimal": "decimal", "$numberLong": "long"}[next(iter(value))]
        value = None
    seen[path, kind] += 1
    if kind == "object":
        for n, v in value.items():
            _visit(v, f"{path}\x00{n}", seen)
    elif kind == "array":
        for v in value:
            _visit(v, f"{path}\x00[]", seen)


def path_counts(df: DataFrame, column: str) -> DataFrame:
    """(path, kind, n) over JSON documents in a text column: all rows are read, and counts are summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x is not None:
                    try:
                        _visit(json.loads(x), "$", seen)
                    except ValueError:
                        seen["$", "invalid"] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen]), pa.array([k[1] for k in seen]), pa.array(list(seen.values()), pa.int64())], names=["path", "kind", "n"])

    return df.select(column).mapInArrow(run, "path string, kind string, n long").groupBy("path", "kind").agg(F.sum("n").alias("n"))


def unstable_paths(counts: DataFrame, least_presence: float) -> DataFrame:
    """Paths of documents whose fields are, on average, in less than that share of them: maps keyed by ids, and the like.

    The share does not depend on how many documents there are.
    """
    parent = F.substring_index("path", "\x00", -1)
    fields = counts.where(~F.endswith("path", F.lit("\x00[]"))).withColumn("up", F.expr("left(path, length(path) - length(substring_index(path, '\x00', -1)) - 1)")).where(parent != F.col("path"))
    of_fields = fields.groupBy("up").agg(F.sum("n").alias("held"), F.count_distinct("path").alias("fields"))
    documents = counts.where("kind = 'object'").select(F.col("path").alias("up"), F.col("n").alias("documents"))
    return of_fields.join(documents, "up").where(F.col("held") < least_presence * F.col("fields") * F.col("documents")).select(F.col("up").alias("open"))


def infer(df: DataFrame, column: str, least_presence: float = 0.02) -> dict:
    """The schema of all documents; one whose fields come and go (see ``unstable_paths``) counts as open.

    What lies under such a document never reaches the driver.
    """
    found = path_counts(df, column).where("kind <> 'invalid'")
    open_ = unstable_paths(found, least_presence)
    parts = F.split("path", "\x00")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "\x00"))
    under = found.where(F.contains("path", F.lit("\x00"))).select("path", F.explode(above).alias("open")).join(open_, "open", "left_semi").select("path").distinct()
    kept = found.join(under, "path", "left_anti").join(open_.withColumnRenamed("open", "path").withColumn("is_open", F.lit(True)), "path", "left")
    counts: dict[str, dict[str, int]] = {}
    opened = set()
    for r in kept.collect():  # a row for each path and kind of value of stable documents
        if r["is_open"]:
            opened.add(r["path"])
        counts.setdefault(r["path"], {})[r["kind"]] = r["n"]
    children: dict[str, list[str]] = {}
    for p in counts:
        if p != "$":
            children.setdefault(p.rpartition("\x00")[0], []).append(p)

    def build(path: str) -> dict:
        kinds = []
        for kind in sorted(counts[path]):
            own = [p for p in sorted(children.get(path, []))]
            if kind == "object":
                fields = [p for p in own if not p.endswith("\x00[]")]
                if path in opened:
                    kinds.append({"bsonType": "object", "properties": {}, "required": [], "additionalProperties": True})
                    continue
                name = lambda p: p.rpartition("\x00")[2]
                required = sorted(name(p) for p in fields if sum(counts[p].values()) == counts[path]["object"])
                kinds.append({"bsonType": "object", "properties": {name(p): build(p) for p in fields}, "required": required, "additionalProperties": False})
            elif kind == "array":
                items = f"{path}\x00[]"
                kinds.append({"bsonType": "array", "items": build(items) if items in counts else {}})
            else:
                kinds.append({"bsonType": kind})
        return kinds[0] if len(kinds) == 1 else {"anyOf": kinds}

    return build("$") if "$" in counts else {}
