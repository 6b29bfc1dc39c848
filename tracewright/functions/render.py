"""Sinks for people and mods: lines of text, and the four records of the mod channel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions import codes


def lookup_lines(display: DataFrame) -> DataFrame:
    """One line of text for each row of lookup.display()."""
    amount = F.when(F.col("amount") > 1, F.concat(F.lit("x"), F.col("amount").cast("string"), F.lit(" "))).otherwise("")
    line = F.concat("age", F.lit(" "), "sign", F.lit(" "), "who", F.lit(" "), "did", F.lit(" "), amount, F.coalesce("what", F.lit("?")), F.when(F.col("struck"), " (undone)").otherwise(""))
    return display.select("id", "tbl", line.alias("line"))


def page_line(page: int, pages: int) -> str:
    return f"Page {page}/{max(1, pages)}"


def data_records(rows: DataFrame) -> DataFrame:
    """Record 1, for block, container and item rows: type, time, user, target, action, amount, place, rolled back, source."""
    what = F.when(F.col("tbl") == 0, codes.block_action(F.col("action"))).when(F.col("tbl") == 1, codes.container_action(F.col("action"))).otherwise(codes.item_action(F.col("action")))
    return rows.select(
        "id", "tbl",
        F.to_json(F.struct(F.lit(1).alias("type"), (F.col("time") * 1000).alias("time"), F.coalesce("user_name", F.lit("")).alias("user"), F.coalesce("type_name", F.lit("")).alias("target"), what.alias("action"), F.col("amount"), "x", "y", "z", F.coalesce("world", F.lit("")).alias("world"), codes.rolled_back(F.col("rolled_back")).alias("rolledback"), (F.col("tbl") == 1).alias("container"))).alias("record"),
    )


def message_records(rows: DataFrame, sign: bool = False) -> DataFrame:
    """Record 3, for chat, command and sign rows."""
    return rows.select("id", F.to_json(F.struct(F.lit(3).alias("type"), (F.col("time") * 1000).alias("time"), F.coalesce("user_name", F.lit("")).alias("user"), "message", F.lit(sign).alias("sign"), "x", "y", "z", F.coalesce("world", F.lit("")).alias("world"))).alias("record"))


def session_records(rows: DataFrame) -> DataFrame:
    """Record 2, for logins and logouts."""
    return rows.select("id", F.to_json(F.struct(F.lit(2).alias("type"), (F.col("time") * 1000).alias("time"), F.coalesce("user_name", F.lit("")).alias("user"), codes.session_action(F.col("action")).alias("action"), "x", "y", "z", F.coalesce("world", F.lit("")).alias("world"))).alias("record"))


def username_records(rows: DataFrame) -> DataFrame:
    """Record 4, for name changes."""
    return rows.select("id", F.to_json(F.struct(F.lit(4).alias("type"), (F.col("time") * 1000).alias("time"), F.col("uuid").alias("user"), F.col("name").alias("target"))).alias("record"))
