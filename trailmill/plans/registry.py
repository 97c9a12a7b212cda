"""All queries of the engine's own operators, by name, with their SQL."""

from trailmill.plans import discovery, ground, history, intake, places, progress, reads, recount, replay, reveal, sanitised, scoring, stream, sync, trace, web

MODULES = (discovery, scoring, trace, reads, history, stream, intake, progress, recount, places, ground, sanitised, replay, sync, reveal, web)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
