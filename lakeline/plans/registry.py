"""All registered queries of the library with their DuckDB twins."""

from __future__ import annotations

from lakeline.plans import answers, chunking, compose, files, ingest, links, listing, pictures, retrieval, scalars, state, steps, streams, structure

MODULES = [retrieval, listing, chunking, state, streams, structure, answers, files, links, compose, ingest, pictures, steps, scalars]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
FLAGSHIP = "hybrid_search"
