"""Column functions that decode rows: action and source names, signs, rolled-back states, ages, packed places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.schema import BLOCK_BIT, CONTAINER_ACTIONS, GAINS, INVENTORY_BIT, ITEM_ACTIONS, LOOKUP_ACTIONS, SESSION_ACTIONS, SIGN_ACTIONS, SOURCES


def decode(code: Column, names: dict[int, str], other: str = "unknown") -> Column:
    """CASE over a fixed code table; null stays null."""
    out = None
    for k, v in names.items():
        out = F.when(code == k, v) if out is None else out.when(code == k, v)
    return out.when(code.isNotNull(), other)


def block_action(code: Column) -> Column:
    return decode(code, {k: LOOKUP_ACTIONS[k] for k in (0, 1, 2, 3)})


def container_action(code: Column) -> Column:
    return decode(code, CONTAINER_ACTIONS)


def item_action(code: Column) -> Column:
    return decode(code, ITEM_ACTIONS)


def session_action(code: Column) -> Column:
    return decode(code, SESSION_ACTIONS)


def sign_action(code: Column) -> Column:
    return decode(code, SIGN_ACTIONS)


def source(tbl: Column) -> Column:
    return decode(tbl, SOURCES)


def polarity(tbl: Column, action: Column) -> Column:
    """1 where a row adds to the player's inventory, else 0. A container's remove is the player's gain; a placed block is a loss."""
    gain = F.when(tbl == 0, F.lit(0)).otherwise(action.isin(*GAINS).cast("int"))
    return F.when(action.isNotNull(), gain)


def rolled_back(state: Column, inventory: bool = False) -> Column:
    return F.coalesce(state.bitwiseAND(INVENTORY_BIT if inventory else BLOCK_BIT) != 0, F.lit(False))


def toggle(state: Column, inventory: Column | bool) -> Column:
    bit = F.when(inventory, INVENTORY_BIT).otherwise(BLOCK_BIT) if isinstance(inventory, Column) else F.lit(INVENTORY_BIT if inventory else BLOCK_BIT)
    return F.coalesce(state, F.lit(0)).bitwiseXOR(bit)


def sign_of(tbl: Column, action: Column) -> Column:
    """+ or - shown beside a row: placed, added and gained are +; broken, removed and lost are -; clicks and kills are blank and -."""
    block = F.when(action == 1, "+").when(action.isin(0, 3), "-").otherwise("")
    item = F.when(action.isin(*GAINS), "+").otherwise("-")
    return F.when(tbl == 0, block).when(tbl == 1, F.when(action == 1, "+").otherwise("-")).otherwise(item)


def time_since(time: Column, now: int) -> Column:
    """0.00/m ago under an hour, /h under a day, else /d; never negative; halves round to even as format_number does."""
    s = F.greatest(F.lit(now) - time, F.lit(0)).cast("double")
    m, h, d = s / 60, s / 3600, s / 86400
    show = lambda x, u: F.concat(F.call_function("format_number", x, F.lit("0.00")), F.lit(f"/{u} ago"))
    return F.when(m < 60, show(m, "m")).when(h < 24, show(h, "h")).otherwise(show(d, "d"))


def stamp(time: Column) -> Column:
    return F.date_format(F.timestamp_seconds(time), "yyyy-MM-dd HH:mm:ss")


def glow(data: Column) -> tuple[Column, Column]:
    """Front and back glow of a sign from its two flag bits."""
    return data.bitwiseAND(1) != 0, data.bitwiseAND(2) != 0


def sign_message(face: Column, lines: list[Column]) -> Column:
    """The lines of the written face, empty ones left out, each followed by a blank unless it ends in one."""

    def shown(line: Column) -> Column:
        text = F.coalesce(line, F.lit(""))
        return F.when(F.length(text) == 0, "").when(text.endswith(" "), text).otherwise(F.concat(text, F.lit(" ")))

    return F.when(face == 0, F.concat(*map(shown, lines[:4]))).otherwise(F.concat(*map(shown, lines[4:])))


def sign_written(lines: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.length(c) > 0, F.lit(False)) for c in lines])


def strip_colours(text: Column) -> Column:
    """Without runs of a section sign, x and six section-signed hex digits."""
    return F.regexp_replace(text, "§[xX](§[0-9a-fA-F]){6}", "")


def is_uuid(text: Column) -> Column:
    return F.coalesce((F.length(text) == 36) & text.rlike("^.{8}-.{4}-.{4}-.{4}-.{12}$"), F.lit(False))


def short_type(name: Column) -> Column:
    """Type name without its namespace, in lower case."""
    return F.lower(F.when(F.instr(name, ":") > 0, F.substring_index(name, ":", -1)).otherwise(name))


def chunk(v: Column) -> Column:
    return F.shiftright(v, 4)


def decode_blockdata(rows: DataFrame, dictionary: DataFrame, column: str = "blockdata", out: str = "names") -> DataFrame:
    """"12,7" to the names of a dictionary (id, name), in their order; unknown ids are left out.

    Only the distinct lists are taken apart and joined; there are far fewer of them than rows.
    """
    lists = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("_list")).distinct()
    parts = lists.select("_list", F.posexplode(F.split("_list", ",")).alias("_k", "_part"))
    known = parts.join(dictionary.select(F.col("id").alias("_id"), F.col("name").alias("_name")), F.col("_part").try_cast("int") == F.col("_id"), "left")
    named = known.groupBy("_list").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_name").isNotNull(), F.struct("_k", "_name")))), lambda s: s["_name"]), ",").alias(out))
    return rows.join(named, rows[column] == named["_list"], "left").drop("_list")
