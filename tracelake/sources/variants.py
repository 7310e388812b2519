"""Short forms for schemaless values: lookups that give null instead of failing, and tests of what a value is."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.scoring import blank_to_null


def get(v: Column, path: str, kind: str = "string") -> Column:
    """A value at a path; null if it is missing or of another kind."""
    return F.try_variant_get(v, path, kind)


def sub(v: Column, path: str) -> Column:
    """The value at a path as it is; a JSON null counts as missing."""
    found = F.try_variant_get(v, path, "variant")
    return F.when(~F.is_variant_null(found), found)


def kind(v: Column) -> Column:
    """``object``, ``array``, ``string``, ``boolean``, ``void``, or the name of a number's type; null if it is missing. ``v``
    stands in it once: expressions on schemaless values nest, and every copy would double the plan."""
    return F.lower(F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1))


def is_object(v: Column) -> Column:
    return kind(v) == "object"


def is_array(v: Column) -> Column:
    return kind(v) == "array"


def is_string(v: Column) -> Column:
    return kind(v) == "string"


def items(v: Column) -> Column:
    """The members of a list; an empty list for what is none."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def objects(v: Column) -> Column:
    return F.filter(items(v), is_object)


def parsed(text: Column) -> Column:
    """The JSON value of a text, or the text itself as a string where it is no JSON."""
    return F.coalesce(F.try_parse_json(text), get(F.parse_json(F.to_json(F.array(text))), "$[0]", "variant"))


def decoded(v: Column) -> Column:
    """The value that a string holds as JSON, or the value as it is: one step of what was encoded twice."""
    inner = F.try_parse_json(get(v, "$"))
    return F.when(is_string(v) & inner.isNotNull(), inner).otherwise(v)


def shown(v: Column) -> Column:
    """A string as it is, other values as JSON."""
    return F.when(is_string(v), get(v, "$")).otherwise(F.to_json(v))


def kept(rows: DataFrame, fits: Callable[[Column], Column]) -> DataFrame:
    """Rows that fit, where ``fits`` sees a row as a struct. A plain filter would be pushed below the projection that makes
    the rows, with a copy of each of its expressions; this one stands above."""
    row = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    return rows.select(F.explode_outer(F.filter(F.array(row), fits)).alias("row")).where("row is not null").select("row.*")


def first_of(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def last_of(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def first_text(*columns: Column) -> Column:
    """The first that is neither missing nor empty."""
    return F.coalesce(*(blank_to_null(c) for c in columns))


def attributes(span: str = "span") -> Column:
    """A span's attributes as a map from dotted names to texts."""
    return F.from_json(F.to_json(F.col(span)), "attributes map<string,string>")["attributes"]


def numbered(names: Column, pattern: str) -> Column:
    """The numbers that attribute names carry where a pattern has its one group, in order, each once."""
    hits = F.filter(F.map_keys(names), lambda k: k.rlike(pattern))
    return F.array_sort(F.array_distinct(F.transform(hits, lambda k: F.regexp_extract(k, pattern, 1).cast("int"))))


def messages(names: Column, prefix: str, fields: tuple[str, ...] = ("role", "content")) -> Column:
    """Messages of flattened attributes ``prefix.N.field`` (with ``message.`` before the field or not), as an array of
    (idx, fields), up to the first number without a role. Nothing leaves the row."""
    dotted = prefix.replace(".", r"\.")
    at = lambda i, f: F.coalesce(F.try_element_at(names, F.format_string(f"{prefix}.%d.message.{f}", i)), F.try_element_at(names, F.format_string(f"{prefix}.%d.{f}", i)))
    rows = F.transform(numbered(names, rf"^{dotted}\.(\d+)\."), lambda i: F.struct(i.alias("idx"), *(at(i, f).alias(f) for f in fields)))
    # numbers stand at their own place until one is missing, and so do roles
    upto = F.aggregate(rows, F.lit(0), lambda n, r: F.when((r["idx"] == n) & r[fields[0]].isNotNull(), n + 1).otherwise(n))
    return F.slice(rows, F.lit(1), upto)
