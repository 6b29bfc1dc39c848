"""Schemas of the logs and dictionaries, and the fixed action codes."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _S = T.LongType(), T.IntegerType(), T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_BASE = {"id": _L, "time": _L, "user_id": _I, "wid": _I, "x": _I, "y": _I, "z": _I}
SCHEMAS: dict[str, T.StructType] = {
    "block": _struct(**_BASE, action=_I, type=_I, data=_I, rolled_back=_I, blockdata=_S, meta_payload_id=_L),
    "container": _struct(**_BASE, type=_I, data=_I, amount=_I, action=_I, rolled_back=_I, metadata=_S),
    "item": _struct(**_BASE, type=_I, amount=_I, action=_I, rolled_back=_I, metadata=_S),
    "chat": _struct(**_BASE, message=_S),
    "command": _struct(**_BASE, message=_S),
    "session": _struct(**_BASE, action=_I),
    "sign": _struct(**_BASE, action=_I, data=_I, face=_I, **{f"line_{k}": _S for k in range(1, 9)}),
    "username": _struct(id=_L, time=_L, uuid=_S, name=_S),
    "user": _struct(id=_I, time=_L, name=_S, uuid=_S),
    "material": _struct(id=_I, name=_S),
    "world": _struct(id=_I, name=_S),
}
POSITIONAL = ("block", "container", "item", "chat", "command", "session", "sign")

# The action codes of lookups, item transactions, signs and sessions.
LOOKUP_ACTIONS = {0: "break", 1: "place", 2: "click", 3: "kill", 4: "container", 6: "chat", 7: "command", 8: "session", 9: "username", 10: "sign", 11: "item"}
ITEM_ACTIONS = {0: "remove", 1: "add", 2: "drop", 3: "pickup", 4: "withdraw", 5: "deposit", 6: "throw", 7: "shoot", 8: "break", 9: "destroy", 10: "create", 11: "sell", 12: "buy"}
SIGN_ACTIONS = {0: "break", 1: "place", 2: "edit"}
SESSION_ACTIONS = {0: "logout", 1: "login"}
CONTAINER_ACTIONS = {0: "remove", 1: "add"}
SOURCES = {0: "block", 1: "container", 2: "item"}
#: Item actions that add to a player's inventory; all others take from it.
GAINS = (0, 3, 4, 10, 12)
LOSSES = (1, 2, 5, 6, 7, 8, 9, 11)
#: Item actions which plain lookups leave out.
QUIET_ITEMS = (8, 9, 10, 11, 12)
BLOCK_BIT, INVENTORY_BIT = 1, 2
