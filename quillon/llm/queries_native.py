"""Queries of the operators built from built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import licenses
from quillon.llm.common import table
from quillon.llm.fingerprints import fingerprint_documents
from quillon.llm.sharding import shard_documents


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=40)


QUERIES = {"op1_fingerprints": op1_fingerprints, "op3_licenses": op3_licenses, "op4_sharding": op4_sharding}
ORACLES = {"op3_licenses": licenses.oracle()}
