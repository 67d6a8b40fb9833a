"""Incremental ingestion: files that arrive in a folder become rows of parquet tables.

A file is self-contained, so the stream needs no state and no watermark. Each batch of new files is
written under its number and overwrites what an interrupted attempt left, so every file counts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quireflow.sources.pdf import Corpus

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
TABLES = ("documents", "xref", "pages", "text_spans")


def arriving_files(spark: SparkSession, folder: str, pattern: str = "*.pdf", files_per_batch: int = 1000) -> DataFrame:
    """A stream of the files in a folder and below it."""
    reader = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return reader.option("maxFilesPerTrigger", files_per_batch).load(folder)


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, tables: Sequence[str] = TABLES, mode: str = "default", once: bool = True, pattern: str = "*.pdf", files_per_batch: int = 1000) -> StreamingQuery:
    """Start writing the tables of arriving files below ``out``; with ``once`` it ends when all present files are done."""
    unknown = set(tables) - set(Corpus(spark.createDataFrame([], "path string, content binary")).tables())
    if unknown:
        raise ValueError(f"unknown tables {sorted(unknown)}")

    def write(files: DataFrame, batch: int) -> None:
        corpus = Corpus(files, mode=mode).tables()
        for name in tables:
            corpus[name]().write.mode("overwrite").parquet(f"{out}/{name}/batch={batch}")

    stream = arriving_files(spark, folder, pattern, files_per_batch).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream.trigger(processingTime="10 seconds")).start()
