"""JSON-pointer lookup of text fields, resolved against a map that is built per row from the schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.functions import text as X

_LEAVES = "array<struct<path:string,value:string>>"
POINTER = r"^(/([^~/]|~0|~1)*)+\z"


def _escape(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def _leaves(value: Column, kind: T.DataType, prefix: Column) -> Column | None:
    """All text leaves below ``value``; the recursion follows the schema, not the data."""
    if isinstance(kind, T.StringType):
        return F.array(F.struct(prefix.alias("path"), value.alias("value"))).cast(_LEAVES)
    if isinstance(kind, T.StructType):
        parts = [
            _leaves(value[f.name], f.dataType, F.concat(prefix, F.lit("/" + _escape(f.name)))) for f in kind.fields
        ]
        parts = [p for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(kind, T.ArrayType):
        probe = _leaves(F.lit(None), kind.elementType, prefix)
        if probe is None:
            return None
        nested = F.transform(value, lambda x, i: _leaves(
            x, kind.elementType, F.concat(prefix, F.lit("/"), i.cast("string"))
        ))
        return F.coalesce(F.flatten(nested), F.array().cast(_LEAVES))
    return None


def text_leaves(value: Column, kind: T.DataType) -> Column:
    """Map from JSON pointer to text for one nested value."""
    leaves = _leaves(value, kind, F.lit(""))
    filled = F.filter(leaves, lambda e: e["value"].isNotNull())
    return F.map_from_entries(filled)


def pointer_problem(path: Column, leaf: Column) -> Column:
    """Why a pointer yields no text, or NULL: bad_start, bad_escape, not_found, blank."""
    return (
        F.when(path.isNull() | ~path.startswith("/"), "bad_start")
        .when(~path.rlike(POINTER), "bad_escape")
        .when(leaf.isNull(), "not_found")
        .when(X.is_blank(leaf), "blank")
    )


#: Keys that a path of ``variant_get`` can name; others are looked up in a map of the object.
PLAIN_KEY = r"^[^'\"\[\]?\\]+\z"
INDEX = r"^(0|[1-9][0-9]{0,8})\z"


def _child(value: Column, token: Column) -> Column:
    """The member or element of a VARIANT that a token names, or NULL."""
    plain = F.try_variant_get(value, F.concat(F.lit("$['"), token, F.lit("']")), "variant")
    odd = F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), token)
    member = F.when(token.rlike(PLAIN_KEY), plain).otherwise(odd)
    element = F.when(token.rlike(INDEX), F.try_variant_get(value, F.concat(F.lit("$["), token, F.lit("]")), "variant"))
    # Nothing but objects has members, and nothing but lists has elements.
    return F.coalesce(member, element)


def variant_text(document: Column, path: Column) -> Column:
    """The text that a JSON pointer names in a VARIANT of any shape; NULL for what isn't text or isn't there.

    A pointer is followed token by token, inside the row, so only what it passes is looked at. A token without leading zeros may be
    the place of an element, any token the name of a member.
    """
    escaped = F.split(F.substr(path, F.lit(2)), "/")
    tokens = F.transform(escaped, lambda t: F.replace(F.replace(t, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
    leaf = F.aggregate(tokens, document, _child)
    valid = path.rlike(POINTER) & (F.schema_of_variant(leaf) == "STRING")
    return F.when(valid, F.try_variant_get(leaf, "$", "string"))
