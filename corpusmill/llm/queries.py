"""The queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import cut

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _records(spark: SparkSession, folder: str, table: str, key: str, text: str) -> DataFrame:
    return _table(spark, folder, table).select(F.lit(table).alias("table_name"), F.col(key).alias("id"), "source", F.col(text).alias("text"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from .pair_defects import pair_defects

    others = _records(spark, folder, "accepted_mapping", "mapping_id", "llm_text")
    return pair_defects(_table(spark, folder, "api_response"), _table(spark, folder, "prompt_request"), _table(spark, folder, "rule_config"), others)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from .batch_dedup import repeats_of_earlier_batches

    return repeats_of_earlier_batches(_table(spark, folder, "accepted_mapping"), "mapping_id", "batch_no", "llm_text").withColumnRenamed("id", "mapping_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    from .near_duplicates import near_duplicate_classes

    parts = []
    for table, key, text in (("accepted_mapping", "mapping_id", "llm_text"), ("phone_variant", "variant_id", "spoken")):
        found = near_duplicate_classes(_table(spark, folder, table), key, text).where("id <> first_id")
        parts.append(found.select(F.lit(table).alias("table_name"), "first_id", F.col("id").alias("record_id")))
    return parts[0].unionByName(parts[1])


def _truncation(spark: SparkSession, folder: str) -> DataFrame:
    from .truncation import truncation

    accepted = _records(spark, folder, "accepted_mapping", "mapping_id", "llm_text")
    return truncation(accepted.unionByName(_records(spark, folder, "api_response", "response_id", "raw_text")))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _truncation(spark, folder).where("truncated").select("table_name", F.col("id").alias("record_id"))


def p1_by_source(spark: SparkSession, folder: str) -> DataFrame:
    from .truncation import truncation_by_source

    return truncation_by_source(_truncation(spark, folder))


def _splits(spark: SparkSession, folder: str) -> DataFrame:
    from .group_splits import group_splits

    return group_splits(_table(spark, folder, "phone_variant"), _table(spark, folder, "split_quota"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from .group_splits import mixed_groups

    return mixed_groups(_splits(spark, folder)).withColumnRenamed("id", "variant_id")


def p2_splits(spark: SparkSession, folder: str) -> DataFrame:
    return _splits(spark, folder).select(F.col("id").alias("variant_id"), "group_key", "split_name")


def p2_deviation(spark: SparkSession, folder: str) -> DataFrame:
    from .group_splits import split_deviation

    return split_deviation(cut(_splits(spark, folder), "splits"), _table(spark, folder, "split_quota"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    from .tokens import encode_table

    return encode_table(_table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def _containers(spark: SparkSession, folder: str) -> list[tuple[DataFrame, list[tuple[str, int]]]]:
    from .packing import fill_containers
    from .tokens import token_counts

    documents = _table(spark, folder, "documents")
    specs: dict[str, list[tuple[str, int]]] = {}
    for r in _table(spark, folder, "container_spec").collect():  # fixed, a row for each container size
        specs.setdefault(r["tokenizer"], []).append((r["spec_name"], r["capacity_tokens"]))
    parts = []
    for tokenizer, own in sorted(specs.items()):
        sizes = cut(token_counts(documents, "doc_id", "text", tokenizer), "sizes")
        parts.append((fill_containers(sizes, own), own))
    return parts


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [filled.withColumnRenamed("id", "doc_id") for filled, _ in _containers(spark, folder)])


def p7_waste(spark: SparkSession, folder: str) -> DataFrame:
    from .packing import container_waste

    return reduce(DataFrame.unionByName, [container_waste(filled, own) for filled, own in _containers(spark, folder)])


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    from .sentences import split_sentences

    return split_sentences(_table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_by_source, p2_found, p2_splits, p2_deviation, p3_found, p4_found, p5_found, p6_ids, p7_containers, p7_waste, p8_found)}
SQL: dict[str, str] = {}
