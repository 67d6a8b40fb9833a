"""Queries of the text operators, with SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.llm import bpe, encodings, language, packing
from quireflow.session import cut, few, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.find_garbled(table(spark, d, "text_objects")).select("text_object_id", "field_name", "item_no").distinct()


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The garbled strings with the chain that garbled them and the original, null where it is lost."""
    return encodings.find_garbled(table(spark, d, "text_objects")).distinct()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts that the ids of p6_ids stand for: an exact round trip."""
    return bpe.decode_corpus(p6_ids(spark, d), "doc_id", "ids")


def _packed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes of the documents, specs, containers)."""
    # the sizes are needed twice (to count the items, to pack them) and are a few bytes a row
    sizes = cut(bpe.encode_corpus(table(spark, d, "documents"), "doc_id", "text", only_sizes=True))
    specs = table(spark, d, "container_specs").select("spec_id", "capacity_tokens").distinct()
    return sizes, specs, packing.fill_containers(sizes, "doc_id", "n_tokens", [(r[0], r[1]) for r in few(specs.orderBy("spec_id"))])


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)[2]


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per spec: containers, tokens, share of the capacity that is used."""
    _, specs, placed = _packed(spark, d)
    per = placed.groupBy("spec_id", "container").agg(F.sum(F.col("end_token") - F.col("first_token")).alias("n"))
    total = per.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"))
    return total.join(specs, "spec_id").select("spec_id", "n_containers", "n_tokens", (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("fill"))


_P7_VALID = """SELECT spec_id, (SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS n_documents, CAST(0 AS BIGINT) AS n_incomplete, CAST(0 AS BIGINT) AS n_split, CAST(0 AS BIGINT) AS n_overfull
    FROM (SELECT DISTINCT spec_id FROM container_specs)"""


def p7_valid(spark: SparkSession, d: str) -> DataFrame:
    """Per spec: documents placed, those not placed whole, those split without need, containers beyond the capacity."""
    sizes, specs, placed = _packed(spark, d)
    placed = cut(placed.join(specs, "spec_id"))
    n = F.col("end_token") - F.col("first_token")
    per_item = placed.groupBy("spec_id", "doc_id").agg(F.sum(n).alias("sum"), F.min("first_token").alias("low"), F.max("end_token").alias("high"), F.count(F.lit(1)).alias("pieces"), F.max("capacity_tokens").alias("capacity"))
    per_item = per_item.join(sizes.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens")), "doc_id")
    whole = (F.col("low") == 0) & (F.col("high") == F.col("n_tokens")) & (F.col("sum") == F.col("n_tokens"))
    items = per_item.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(~whole).alias("n_incomplete"), F.count_if((F.col("pieces") > 1) & (F.col("n_tokens") <= F.col("capacity"))).alias("n_split"))
    full = placed.groupBy("spec_id", "container").agg(F.sum(n).alias("sum"), F.max("capacity_tokens").alias("capacity")).groupBy("spec_id").agg(F.count_if(F.col("sum") > F.col("capacity")).alias("n_overfull"))
    return items.join(full, "spec_id").select("spec_id", "n_documents", "n_incomplete", "n_split", "n_overfull")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(language.judge_documents(table(spark, d, "documents"))).distinct()


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every language of every post with its share of the words and a confidence."""
    return language.shares(language.judge_documents(table(spark, d, "documents")))


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every passage of one language, in order, with its number of words and a confidence."""
    judged = language.judge_documents(table(spark, d, "documents"))
    return judged.select("doc_id", F.posexplode("spans").alias("passage_no", "s")).select("doc_id", "passage_no", "s.lang", "s.confidence", "s.n_words")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_repaired, p6_ids, p6_decoded, p7_containers, p7_fill, p7_valid, p8_found, p8_languages, p8_passages)}


def oracle_sql() -> dict[str, str]:
    return {"p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents", "p7_valid": _P7_VALID}
