"""Documents are structs; their fields are known from the schema of the frame they are in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def document(**fields: Column) -> Column:
    """A document of the named fields."""
    return F.struct(*(c.alias(n) for n, c in fields.items()))


def type_of(df: DataFrame, path: str) -> T.DataType:
    """Type of a field named by a dotted path, through arrays as well."""
    kind: T.DataType = df.schema
    for name in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        kind = kind[name].dataType
    return kind


def merge(df: DataFrame, *paths: str) -> Column:
    """One document of the fields of several; of equal names the last counts, NULL documents count for nothing."""
    owners: dict[str, list[str]] = {}
    for p in paths:
        for f in type_of(df, p).fieldNames():
            owners.setdefault(f, []).append(p)
    fields = []
    for f, having in owners.items():
        value = F.col(f"{having[0]}.{f}")
        for p in having[1:]:
            value = F.when(F.col(p).isNotNull(), F.col(f"{p}.{f}")).otherwise(value)
        fields.append(value.alias(f))
    return F.struct(*fields)


def set_field(doc: Column, name: str, value: Column) -> Column:
    return doc.withField(name, value)


def unset_field(doc: Column, *names: str) -> Column:
    return doc.dropFields(*names)


def to_pairs(fields: Column) -> Column:
    """An open document of one value type (a map) as an array of (k, v)."""
    return F.transform(F.map_entries(fields), lambda e: F.struct(e.key.alias("k"), e.value.alias("v")))


def from_pairs(pairs: Column) -> Column:
    """A map from an array of (k, v); of equal names the last counts."""
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p.k == k), -1).v
    names = F.array_distinct(F.transform(pairs, lambda p: p.k))
    return F.map_from_arrays(names, F.transform(names, last))


def type_name(variant: Column) -> Column:
    """The dialect's name of a value's type; ``missing`` for NULL."""
    named = F.lit("missing")
    for kind in ("null", "bool", "string", "int", "long", "double", "decimal", "date", "binData", "array", "object"):
        named = F.when(is_type(variant, kind), kind).otherwise(named)
    return named


def is_missing(variant: Column, path: str) -> Column:
    """Whether an open document (a variant) lacks the path; a JSON null is there."""
    return F.variant_get(variant, path, "variant").isNull()


def is_null(variant: Column, path: str) -> Column:
    """Whether the path is absent or a JSON null."""
    found = F.variant_get(variant, path, "variant")
    return found.isNull() | F.is_variant_null(found)


#: For each type of the dialect the kinds that a variant's schema names.
_KINDS = {
    "null": "VOID", "bool": "BOOLEAN", "string": "STRING", "int": "(TINYINT|SMALLINT|INT)", "long": "BIGINT", "double": "(DOUBLE|FLOAT)", "decimal": "DECIMAL.*",
    "date": "(DATE|TIMESTAMP.*)", "binData": "BINARY", "array": "ARRAY.*", "object": "OBJECT.*", "number": "(TINYINT|SMALLINT|INT|BIGINT|DOUBLE|FLOAT|DECIMAL.*)",
}


def is_type(variant: Column, kind: str, path: str = "$") -> Column:
    """``IS kind`` over an open document: never NULL. ``missing`` holds where the path is absent, ``null`` for a null there.

    ``long`` holds for whole numbers beyond 32 bits alone: a variant keeps the narrowest type that JSON text needs.
    """
    found = F.variant_get(variant, path, "variant")
    if kind == "missing":
        return found.isNull()
    named = F.schema_of_variant(found)
    if kind in ("int", "long"):
        # parse_json gives every whole number the type BIGINT in its schema, so the value tells the two apart
        small = F.try_variant_get(found, "$", "int").isNotNull()
        return F.coalesce(named.rlike("^(TINYINT|SMALLINT|INT|BIGINT)$") & (small if kind == "int" else ~small), F.lit(False))
    return F.coalesce(named.rlike(f"^{_KINDS[kind]}$"), F.lit(False))


def computed_field(doc: Column, kind: T.DataType, name: Column) -> Column:
    """``doc[name]``: the field that an expression names, NULL where there is none.

    A map is looked up; a variant is read by a path made of the name; of a struct, whose fields may differ in type, the
    value comes as a variant.
    """
    if isinstance(kind, T.MapType):
        return F.try_element_at(doc, name)
    if isinstance(kind, T.VariantType):
        # in a path, a name stands in quotes, which it may not hold itself
        return F.when(~F.contains(name, F.lit("'")), F.try_variant_get(doc, F.concat(F.lit("$['"), name, F.lit("']")), "variant"))
    assert isinstance(kind, T.StructType)
    out = F.lit(None).cast("variant")
    for f in kind.fieldNames():
        out = F.when(name == f, F.to_variant_object(doc.getField(f)) if isinstance(kind[f].dataType, T.StructType | T.ArrayType) else doc.getField(f).cast("variant")).otherwise(out)
    return out


def sort_key(variant: Column) -> Column:
    """A struct that orders and groups values of any scalar type: NULL, numbers, strings, booleans, in that order."""
    kind = F.schema_of_variant(variant)
    number = kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
    rank = F.when(variant.isNull() | (kind == "VOID"), 0).when(number, 1).when(kind == "STRING", 2).when(kind == "BOOLEAN", 4).otherwise(3)
    return F.struct(
        rank.alias("rank"),
        F.when(rank == 1, F.try_variant_get(variant, "$", "double")).alias("number"),
        F.when((rank == 2) | (rank == 3), variant.cast("string")).alias("text"),
        F.when(rank == 4, F.try_variant_get(variant, "$", "boolean")).alias("flag"),
    )
