"""Narrowing of semi-structured values: wrong types fall out instead of being converted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"


def get(v: Column, path: str) -> Column:
    """The member at ``path``; SQL NULL when the key is absent, variant null when it is present and null."""
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def text(v: Column, path: str) -> Column:
    """A JSON string only; numbers and objects give NULL."""
    return F.when(kind(get(v, path)) == "STRING", F.try_variant_get(v, path, "string"))


def any_text(v: Column, path: str) -> Column:
    """Scalar rendered as text."""
    return F.try_variant_get(v, path, "string")


def as_text(v: Column) -> Column:
    """``text`` of a value that was read already."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def as_whole(v: Column) -> Column:
    """``whole`` of a value that was read already; most are BIGINT, which needs no pattern."""
    number = (kind(v) == "BIGINT") | kind(v).rlike(_NUMBER)
    return F.when(number, F.try_variant_get(v, "$", "double").cast("long"))


def whole(v: Column, path: str) -> Column:
    """A JSON number as BIGINT."""
    number = kind(get(v, path)).rlike(_NUMBER)
    return F.when(number, F.try_variant_get(v, path, "double").cast("long"))


def number(v: Column, path: str) -> Column:
    ok = kind(get(v, path)).rlike(_NUMBER)
    return F.when(ok, F.try_variant_get(v, path, "double"))


def flag(v: Column, path: str) -> Column:
    return F.coalesce(F.when(kind(get(v, path)) == "BOOLEAN", F.try_variant_get(v, path, "boolean")), F.lit(False))


def array(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def strings(v: Column, path: str) -> Column:
    """String members of an array; everything else drops out."""
    members = F.filter(F.coalesce(array(v, path), F.array().cast("array<variant>")), lambda m: kind(m) == "STRING")
    return F.transform(members, lambda m: F.try_variant_get(m, "$", "string"))


def is_object(v: Column) -> Column:
    # The schema of a record would name all its members; a struct of none only asks for the type.
    return F.try_variant_get(v, "$", "struct<>").isNotNull()
