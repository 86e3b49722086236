"""Strict checks of JSON records: types at every depth, required fields, and limits on values.

What a field must keep stands in the metadata of its ``StructField``:

* ``must``: it has to be there, and not be null unless ``null`` is set; ``filled``: it may be left out, but not be null
* ``text``: not blank; for a list of texts, each of them
* ``one_of``: the allowed texts; ``low`` and ``high``: the range of a number; ``least``: entries of a list

Nothing is converted: a number is no text, and a text no number. Lists and records are never null.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talentweave.functions import text as X

Path = str | Column  # a fixed path, or one that depends on places in lists
ERRORS = "array<struct<path:string,message:string,value:string>>"


def none() -> Column:
    return F.array().cast(ERRORS)


def error(path: Path, message: str, value: Column | None = None) -> Column:
    shown = F.lit(None).cast("string") if value is None else value
    return F.array(F.struct(_column(path).alias("path"), F.lit(message).alias("message"), shown.alias("value"))).cast(ERRORS)


def _column(path: Path) -> Column:
    return F.lit(path) if isinstance(path, str) else path


def _below(path: Path, name: str) -> Path:
    if isinstance(path, str):
        return name if path == "$" else f"{path}.{name}"
    return F.concat(path, F.lit("." + name))


def _limits(value: Column, kind: T.DataType, meta: dict, path: Path) -> Column:
    """Errors of a scalar of the right type."""
    rules: list[tuple[Column, str]] = []
    if isinstance(kind, T.StringType):
        text = F.try_variant_get(value, "$", "string")
        if meta.get("text"):
            rules.append((~X.is_blank(text), "blank"))
        if "one_of" in meta:
            rules.append((text.isin(*meta["one_of"]), "not_allowed"))
    elif "low" in meta:
        rules.append((F.try_variant_get(value, "$", "double").between(meta["low"], meta["high"]), "out_of_range"))
    found = none()
    for kept, message in rules:
        found = F.when(F.coalesce(kept, F.lit(False)), found).otherwise(error(path, message, F.to_json(value)))
    return found


def value_errors(value: Column, kind: T.DataType, meta: dict, path: Path, closed: bool) -> Column:
    """Errors of one VARIANT against a type; NULL stands for a field that is left out.

    A value with parts is bound first, so that it is taken from its record once.
    """
    if not isinstance(kind, (T.StructType, T.ArrayType)):
        return _bound_errors(value, kind, meta, path, closed)
    return F.element_at(F.transform(F.array(value), lambda v: _bound_errors(v, kind, meta, path, closed)), 1)


def _bound_errors(value: Column, kind: T.DataType, meta: dict, path: Path, closed: bool) -> Column:
    given = F.schema_of_variant(value)
    if isinstance(kind, T.StructType):
        right, message, inside = given.startswith("OBJECT"), "not_an_object", record_errors(value, kind, path, closed)
    elif isinstance(kind, T.ArrayType):
        own = {k: v for k, v in meta.items() if k == "text"}
        entries = F.try_variant_get(value, "$", "array<variant>")
        each = F.flatten(F.transform(entries, lambda e, i: value_errors(
            F.coalesce(e, F.parse_json(F.lit("null"))), kind.elementType, {**own, "filled": True},
            F.concat(_column(path), F.lit("["), i.cast("string"), F.lit("]")), closed)))
        right, message = given.startswith("ARRAY"), "not_a_list"
        inside = F.when(F.size(entries) < meta.get("least", 0), error(path, "too_few", F.to_json(value))).otherwise(each)
    elif isinstance(kind, T.StringType):
        right, message, inside = given == "STRING", "not_a_string", _limits(value, kind, meta, path)
    elif isinstance(kind, (T.IntegerType, T.LongType)):
        right, message, inside = given == "BIGINT", "not_an_integer", _limits(value, kind, meta, path)
    else:
        numeric = (given == "BIGINT") | (given == "DOUBLE") | given.startswith("DECIMAL")
        right, message, inside = numeric, "not_a_number", _limits(value, kind, meta, path)
    scalar = not isinstance(kind, (T.StructType, T.ArrayType))
    wrong = error(path, message, F.to_json(value))
    absent = error(path, "missing") if meta.get("must") else none()
    if meta.get("must"):
        null = none() if meta.get("null") else absent
    else:
        null = wrong if meta.get("filled") or not scalar else none()
    return F.when(value.isNull(), absent).when(F.is_variant_null(value), null).when(~right, wrong).otherwise(inside)


def record_errors(value: Column, kind: T.StructType, path: Path, closed: bool = False) -> Column:
    """Errors of a VARIANT that is an object; ``closed``: fields that the type doesn't have are errors too.

    Fields that must keep the same are checked by one expression over an array of them, which keeps plans small.
    """
    def field(name: str) -> Column:
        return F.try_variant_get(value, f"$.{name}", "variant")

    def at(name: Column) -> Column:
        return name if isinstance(path, str) and path == "$" else F.concat(_column(path), F.lit("."), name)

    def checker(kept: T.StructField):
        return lambda x: _bound_errors(x["value"], kept.dataType, kept.metadata or {}, at(x["name"]), closed)

    alike: dict[str, list[T.StructField]] = {}
    for f in kind.fields:
        alike.setdefault(f.dataType.json() + json.dumps(f.metadata or {}, sort_keys=True), []).append(f)
    parts = []
    for fields in alike.values():
        first = fields[0]
        if len(fields) == 1:
            parts.append(value_errors(field(first.name), first.dataType, first.metadata or {}, _below(path, first.name), closed))
            continue
        named = F.array(*[F.struct(F.lit(f.name).alias("name"), field(f.name).alias("value")) for f in fields])
        parts.append(F.flatten(F.transform(named, checker(first))))
    if closed:
        names = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
        extra = F.filter(names, lambda n: ~n.isin(*kind.names))
        parts.append(F.flatten(F.transform(extra, lambda n: error(at(n), "unknown_field"))))
    return F.concat(*parts)


def json_errors(text: Column, schema: T.StructType, closed: bool = False) -> Column:
    """Errors of a text that must be one JSON object of the schema; NULL text has none."""
    checked = F.element_at(F.transform(F.array(F.try_parse_json(F.when(X.is_json(text), text))), lambda v: F.when(
        v.isNull(), error("$", "invalid_json", text)).otherwise(_bound_errors(v, schema, {"filled": True}, "$", closed))), 1)
    return F.when(text.isNull(), none()).otherwise(checked)
