"""References to records that do not exist.

Left anti-join of the distinct non-null foreign keys against the parent keys that were valid at
the referring time, joined back to the references for rows and for counts per table and period.

Skew: parent versions that never end collapse to their earliest start (one row a key, combined
before the shuffle). Versions with an end are spread over the months they cover, so one key with
a third of all versions is joined month by month; AQE splits what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for an unknown referring time in keys: before every start, so nothing is valid then.
NEVER = "TIMESTAMP_NTZ '0001-01-01 00:00:00'"


def _moment(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def missing_keys(keys: DataFrame, parents: DataFrame, key: list[str], at: str, valid_from: str, valid_to: str) -> DataFrame:
    """Those rows of ``keys`` (distinct key and time) for which no parent row was valid.

    Valid means valid_from <= at and (valid_to is null or valid_to > at). Parents with a null key
    column or a null start are never valid; an empty parent table makes every key missing.
    """
    own = parents.select(*key, _moment(F.col(valid_from)).alias("_from"), _moment(F.col(valid_to)).alias("_to")).dropna(subset=[*key, "_from"])
    lasting = own.where("_to is null").groupBy(*key).agg(F.min("_from").alias("_from"))
    month = lambda c: F.date_trunc("month", F.col(c)).cast("timestamp_ntz")
    ended = (
        own.where("_to > _from")
        .withColumn("_month", F.explode(F.sequence(month("_from"), month("_to"), F.expr("interval 1 month"))))
        .withColumn("_month", F.col("_month").cast("timestamp_ntz"))
    )
    l, r, e = keys.alias("l"), lasting.alias("r"), ended.alias("e")
    same = lambda a, b: [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in key]
    rest = l.join(r, [*same("l", "r"), F.col("r._from") <= F.col(f"l.{at}")], "left_anti").withColumn("_qf_month", month(at)).alias("l")
    cond = [*same("l", "e"), F.col("l._qf_month") == F.col("e._month"), F.col("e._from") <= F.col(f"l.{at}"), F.col("e._to") > F.col(f"l.{at}")]
    return rest.join(e, cond, "left_anti").drop("_qf_month")


def _lost(refs: DataFrame, parents: DataFrame, key: list[str], at: str, valid_from: str, valid_to: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """(real references, distinct keys and times without a parent, the columns that join the two)."""
    real = refs.dropna(subset=key).withColumn("_qf_at", F.coalesce(_moment(F.col(at)), F.expr(NEVER)))
    keys = real.select(*key, "_qf_at").distinct()
    return real, missing_keys(keys, parents, key, "_qf_at", valid_from, valid_to), [*key, "_qf_at"]


def orphan_references(refs: DataFrame, parents: DataFrame, key: list[str], at: str = "at", valid_from: str = "recorded_at", valid_to: str = "removed_at") -> DataFrame:
    """The rows of ``refs`` whose key names no parent valid at their time.

    ``refs`` has the key columns, the time ``at`` and anything else, all of which is kept. A
    reference with a null key column is none and is left out; a null time is before everything,
    so such a reference is always an orphan. Repeated rows stay repeated.
    """
    real, lost, by = _lost(refs, parents, key, at, valid_from, valid_to)
    return real.join(lost, by, "left_semi").select(*[F.col(f"`{c}`") for c in refs.columns])


def orphan_report(refs: DataFrame, parents: DataFrame, key: list[str], by: list[str], at: str = "at", valid_from: str = "recorded_at", valid_to: str = "removed_at") -> DataFrame:
    """Per group of ``by``: references, orphans among them, in one pass. Groups without orphans have 0.

    References, nulls and repeated rows are as for :func:`orphan_references`.
    """
    real, lost, on = _lost(refs, parents, key, at, valid_from, valid_to)
    marked = real.join(lost.withColumn("_qf_lost", F.lit(True)), on, "left")
    return marked.groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.count(F.lit(1)).alias("n_refs"), F.count("_qf_lost").alias("n_orphans"))


def object_references(xref_blocks: DataFrame, page_resources: DataFrame) -> DataFrame:
    """Every non-null reference to an object: ref_table, ref_id, slot, path, obj, gen, at; as often as its row is there."""
    blocks = xref_blocks.select("block_id", "path", "root", "xrefs", F.col("recorded_at").alias("at"))
    entry = (
        blocks.select("block_id", "path", "at", F.posexplode("xrefs").alias("pos", "x"))
        .where(F.col("x.kind").isin("plain", "compressed"))
        .select(
            F.lit("xref_blocks.xrefs").alias("ref_table"),
            F.col("block_id").alias("ref_id"),
            F.col("pos").cast("string").alias("slot"),
            "path",
            F.when(F.col("x.kind") == "plain", F.col("x.obj")).otherwise(F.col("x.stream_id")).alias("obj"),
            F.when(F.col("x.kind") == "plain", F.col("x.gen")).otherwise(F.lit(0)).alias("gen"),
            "at",
        )
    )
    root = blocks.select(F.lit("xref_blocks.root").alias("ref_table"), F.col("block_id").alias("ref_id"), F.lit("root").alias("slot"), "path", F.col("root.obj").alias("obj"), F.col("root.gen").alias("gen"), "at")
    font = page_resources.select("resource_id", "path", F.col("recorded_at").alias("at"), F.explode("font").alias("slot", "f")).select(
        F.lit("page_resources.font").alias("ref_table"), F.col("resource_id").alias("ref_id"), "slot", "path", F.col("f.obj").alias("obj"), F.col("f.gen").alias("gen"), "at"
    )
    return entry.unionByName(root).unionByName(font).dropna(subset=["path", "obj", "gen"])
