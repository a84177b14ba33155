"""All queries of the core and their SQL."""

from __future__ import annotations

from fluxspan.plans import data_queries, flight_queries, flight_sql

QUERIES = {**flight_queries.QUERIES, **data_queries.QUERIES}
SQL = {**flight_sql.SQL, **data_queries.SQL}
FLAGSHIP = "fom_by_flight"
