"""Queries of the text problems (1, 2, 3, 8, 9, 10) over the given tables, and SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import abuse, encode, leak, pii, repetition, runs


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    members = runs.run_members(table(spark, d, "log_chat"))
    return members.where("id <> run_id").select("run_id", F.col("id").alias("chat_id"))


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.collapse_runs(table(spark, d, "log_chat"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    model = abuse.fit(*abuse.training_rows(table(spark, d, "moderation_sample")))
    return abuse.scored(table(spark, d, "log_chat"), model)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.flagged(_scores(spark, d))


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).dropDuplicates(["chat_id"]).withColumnRenamed("source", "wid")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scores(spark, d)).withColumnRenamed("source", "wid")


def _messages(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"chat": table(spark, d, "log_chat"), "command": table(spark, d, "log_command")}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(_messages(spark, d))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(_messages(spark, d)).withColumn("kinds", F.array_join("kinds", ","))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_items(p9_found(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(table(spark, d, "documents")).distinct()


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetition(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_runs, p2_found, p2_scores, p2_rates, p3_found, p3_redacted, p8_ids, p9_found, p9_leaked_items, p10_found, p10_shares)}
#: What can be stated in SQL of a text query is stated over its own stored result; tests/llm holds the rest against brute
#: force, round trips and held-out rows.
ORACLE: dict[str, str] = {}
