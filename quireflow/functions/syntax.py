"""Columns to syntax: values written so that the parsers read them back. Built-in expressions only.

Each function gives text of one character a byte; ``raw`` makes bytes of it. Nulls are written as ``null``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw(text: Column) -> Column:
    """Text of one character a byte, as bytes."""
    return F.encode(text, "ISO-8859-1")


def _or_null(c: Column, written: Column) -> Column:
    return F.when(c.isNull(), F.lit("null")).otherwise(written)


def boolean(c: Column) -> Column:
    return _or_null(c, c.cast("string"))


def integer(c: Column) -> Column:
    return _or_null(c, c.cast("decimal(38,0)").cast("string"))


def real(c: Column, places: int = 10) -> Column:
    """A number with a point; ``places`` behind it."""
    return _or_null(c, c.cast(f"decimal(38,{places})").cast("string"))


def string(c: Column) -> Column:
    """Bytes in parentheses."""
    s = F.regexp_replace(F.decode(c, "ISO-8859-1"), r"([\\()])", r"\\$1")
    return _or_null(c, F.concat(F.lit("("), F.regexp_replace(s, "\r", r"\\r"), F.lit(")")))


def hex_string(c: Column) -> Column:
    """Bytes in angle brackets."""
    return _or_null(c, F.concat(F.lit("<"), F.hex(c), F.lit(">")))


def name(c: Column) -> Column:
    """Bytes as a name: everything but letters, digits and some signs as an escape."""
    bytes_ = F.regexp_extract_all(F.hex(c), F.lit("(..)"), F.lit(1))
    plain = lambda h: F.decode(F.unhex(h), "ISO-8859-1").rlike(r"^[A-Za-z0-9_.+*:;,=!?@$&~|^-]$")
    return _or_null(c, F.concat(F.lit("/"), F.array_join(F.transform(bytes_, lambda h: F.when(plain(h), F.decode(F.unhex(h), "ISO-8859-1")).otherwise(F.concat(F.lit("#"), h))), "")))


def reference(c: Column) -> Column:
    """A struct of obj and gen."""
    return _or_null(c, F.concat_ws(" ", c["obj"].cast("string"), c["gen"].cast("string"), F.lit("R")))


def array(*items: Column) -> Column:
    """Written items, or one column that is an array of them."""
    many = items[0] if len(items) == 1 else F.array(*items)
    return F.concat(F.lit("["), F.array_join(many, " "), F.lit("]"))


def dictionary(entries: dict[str, Column]) -> Column:
    """Written values by key."""
    return F.concat(F.lit("<<"), *[x for k, v in entries.items() for x in (F.lit(f"/{k} "), v, F.lit(" "))], F.lit(">>"))
