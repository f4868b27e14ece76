"""All registered queries of the library proper, and their SQL."""

from __future__ import annotations

from . import imu_queries, sequence_queries, set_queries, vector_queries

QUERIES = {**sequence_queries.QUERIES, **set_queries.QUERIES, **vector_queries.QUERIES, **imu_queries.QUERIES}
SQL = {**sequence_queries.SQL, **set_queries.SQL, **vector_queries.SQL}
