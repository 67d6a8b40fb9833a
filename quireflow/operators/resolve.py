"""References between records, as joins.

The keys of both sides are equal-joined, so Spark picks the strategy; a reference that leads nowhere
keeps its row with a null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quireflow.functions import scalars


def resolve(df: DataFrame, ref: Column, objects: DataFrame, value: str, out: str, key: list[str] | None = None) -> DataFrame:
    """``df`` with ``out``: the ``value`` of the row of ``objects`` that ``ref`` (struct obj, gen) names.

    ``key`` are further columns both sides share (the file, for instance). Objects must be unique.
    """
    key = key or []
    o = objects.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("obj").alias("_obj"), F.col("gen").alias("_gen"), F.col(value).alias(out))
    d = df.withColumn("_ref", ref)
    cond = [F.col("_ref.obj") == F.col("_obj"), F.col("_ref.gen") == F.col("_gen"), *[F.col(k) == F.col(f"_{k}") for k in key]]
    return d.join(o, cond, "left").drop("_ref", "_obj", "_gen", *[f"_{k}" for k in key])


def resolve_or_direct(df: DataFrame, either: str, objects: DataFrame, value: str, out: str, key: list[str] | None = None) -> DataFrame:
    """As :func:`resolve` for a struct<ref, direct>: the direct value where there is one."""
    r = resolve(df, F.col(f"{either}.ref"), objects, value, "_resolved", key)
    return r.withColumn(out, F.coalesce(F.col(f"{either}.direct"), F.col("_resolved"))).drop("_resolved")


def resolve_items(df: DataFrame, keys: list[str], items: str, objects: DataFrame, value: str, out: str, key: list[str] | None = None, size: int | None = None) -> DataFrame:
    """keys and ``out``: the values of an array of struct<ref, direct> in order, null where a reference leads
    nowhere. A null array stays null, an empty one empty; with ``size``, an array of another length is null.

    ``key`` are those of ``keys`` that the objects share. Rows of ``df`` must be unique by ``keys``."""
    rows = df.select(*keys, F.posexplode_outer(items).alias("_pos", "_item"), F.col(items).isNull().alias("_none"))
    done = resolve_or_direct(rows, "_item", objects, value, "_v", key)
    lists = done.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_v")))).alias("_l"), F.max("_none").alias("_none"))
    whole = ~F.col("_none") if size is None else ~F.col("_none") & (F.size("_l") == size)
    return lists.select(*keys, F.when(whole, F.transform("_l", lambda x: x["_v"])).alias(out))


def _either(items: Column) -> Column:
    return F.transform(items, lambda x: scalars.ref_or_direct(x))


def resolve_maybe_array(df: DataFrame, keys: list[str], written: str, objects: DataFrame, value: str, out: str, key: list[str] | None = None) -> DataFrame:
    """keys and ``out``: a value or an array of values, each of which may be a reference, as an array of slices."""
    c = F.col(written)
    many = F.substring(scalars._trimmed(c), 1, 1) == "["
    items = F.when(many, scalars.array(F.when(many, c))).otherwise(F.when(c.isNotNull(), F.array(c)))
    return resolve_items(df.select(*keys, _either(items).alias("_items")), keys, "_items", objects, value, out, key)


def resolve_tuple(df: DataFrame, keys: list[str], written: str, objects: DataFrame, value: str, out: str, parsers: list[Callable[[Column], Column]], key: list[str] | None = None) -> DataFrame:
    """keys and ``out``: a struct _1, _2, … of an array's items, each a value of its own kind or a reference to one.

    Null unless there are as many items as ``parsers`` and each is of its kind."""
    items = df.select(*keys, _either(scalars.array(F.col(written))).alias("_items"))
    found = resolve_items(items, keys, "_items", objects, value, "_found", key, len(parsers))
    parts = [p(F.try_element_at("_found", F.lit(i))) for i, p in enumerate(parsers, 1)]
    whole = F.col("_found").isNotNull()
    for x in parts:
        whole = whole & x.isNotNull()
    return found.select(*keys, F.when(whole, F.struct(*[x.alias(f"_{i}") for i, x in enumerate(parts, 1)])).alias(out))


def newest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in ``order``; a top-1 window, which Spark limits before the shuffle."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def concat_parts(df: DataFrame, keys: list[str], order: str, part: str, out: str, separator: bytes = b"\n") -> DataFrame:
    """keys and ``out``: the parts of a group behind each other in order, for STRING or BINARY parts; null parts are left out."""
    mark = F.lit(separator) if dict(df.dtypes)[part] == "binary" else F.lit(separator.decode("latin-1"))
    lists = df.where(F.col(part).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(part).alias("p")))).alias("l"))
    empty = F.lit(None).cast(dict(df.dtypes)[part])
    joined = F.aggregate("l", empty, lambda a, x: F.when(a.isNull(), x["p"]).otherwise(F.concat(a, mark, x["p"])))
    return lists.select(*keys, joined.alias(out))
