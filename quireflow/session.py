"""Session helpers shared by all operators: table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_SETTING = "spark.checkpoint.dir"


_HOME = str(Path(__file__).resolve().parents[1])


def let_workers_import(spark: SparkSession) -> None:
    """Python workers look for this package where the driver found it, whatever their working directory."""
    settings = spark.sparkContext.environment
    known = settings.get("PYTHONPATH", "").split(os.pathsep)
    if _HOME not in known:
        settings["PYTHONPATH"] = os.pathsep.join([_HOME, *filter(None, known)])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder`` (a file or a directory of parts)."""
    let_workers_import(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's own setting, else a temporary one in local mode.

    A cluster without the setting is refused, because a folder of one machine would lose data with it.
    """
    context = spark.sparkContext
    have = context.getCheckpointDir()
    if have:
        return have
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quireflow-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


_CONSTRAINTS, _ADAPTIVE = "spark.sql.constraintPropagation.enabled", "spark.sql.adaptive.enabled"
_off: dict[str, list[str]] = {}
_lock = threading.Lock()


@contextmanager
def _without(spark: SparkSession, settings: list[str]) -> Iterator[None]:
    """Turns settings off for a while. Such whiles may overlap: a setting returns when the last of them ends."""
    with _lock:
        for s in settings:
            held = _off.setdefault(s, [])
            held.append(held[0] if held else spark.conf.get(s))
            spark.conf.set(s, "false")
    try:
        yield
    finally:
        with _lock:
            for s in settings:
                before = _off[s].pop()
                if not _off[s]:
                    spark.conf.set(s, before)


def cut(df: DataFrame, keep_layout: bool = False) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back: lineage ends here.

    With ``keep_layout`` the result is known to be partitioned and sorted as ``df`` was, so joins on
    these keys move nothing; adaptive execution, which forgets it, is off meanwhile.

    Constraints are not propagated meanwhile: a checkpoint keeps those of its plan, and one about a
    column that the plan dropped makes a later union fail (``key not found`` in rewriteConstraints).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    with _without(spark, [_CONSTRAINTS, _ADAPTIVE] if keep_layout else [_CONSTRAINTS]):
        return df.checkpoint(eager=True)


def forget(*tables: DataFrame) -> None:
    """Deletes the files behind results of :func:`cut` which nothing reads any more."""
    for df in tables:
        plan = df._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile() if plan.nodeName() == "LogicalRDD" else None
        if file is not None and file.isDefined():
            jvm, context = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
            at = jvm.org.apache.hadoop.fs.Path(file.get())
            at.getFileSystem(context.hadoopConfiguration()).delete(at, True)


def has_rows(df: DataFrame) -> bool:
    return bool(df.select(F.lit(1)).take(1))


def few(df: DataFrame, most: int = 10_000) -> list[Row]:
    """The rows of a table that must be small; a larger one is refused instead of sent to the driver."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"a table of at most {most} rows is wanted")
    return rows


def like_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` projected to ``schema`` by name; columns that clash or are surplus are left behind."""
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])
