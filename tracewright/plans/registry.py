"""All queries of the core and their SQL."""

from __future__ import annotations

from tracewright.plans import changes, general, lookups, streams

FLAGSHIP = "lookup_block_user_time"
QUERIES = {**lookups.QUERIES, **changes.QUERIES, **streams.QUERIES, **general.QUERIES}
ORACLE = {**lookups.ORACLE, **changes.ORACLE, **streams.ORACLE, **general.ORACLE}
