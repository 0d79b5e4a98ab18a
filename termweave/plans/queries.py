"""The queries of the core and their SQL twins."""

from __future__ import annotations

from termweave.operators import nested, strict_load
from termweave.plans import channel_queries, client_queries, rule_queries, search_queries, service, service_twins, twins

FLAGSHIP = "map_full"

QUERIES = {
    "p3_found": strict_load.p3_found,
    "p3_loaded": strict_load.p3_loaded,
    "p6_found": nested.p6_found,
    "p6_flat": nested.p6_flat,
    **rule_queries.QUERIES,
    **channel_queries.QUERIES,
    **search_queries.QUERIES,
    **client_queries.QUERIES,
    **service.QUERIES,
}

SQL: dict[str, str] = {**rule_queries.SQL, **channel_queries.SQL, **search_queries.SQL, **client_queries.SQL, **service.SQL, **twins.SQL, **service_twins.SQL}
