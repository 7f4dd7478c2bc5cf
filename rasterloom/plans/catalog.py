"""Named queries of the image engine and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import container_queries, lossless_queries, lossy_queries

QUERIES = {**lossless_queries.QUERIES, **lossy_queries.QUERIES, **container_queries.QUERIES}
ORACLE_SQL = {**lossless_queries.SQL, **lossy_queries.SQL, **container_queries.SQL}
FLAGSHIP = "channel_histogram"
