"""Registered queries over the given tables and their SQL."""

from runledger.plans import core, evaluation, further, more, profiles, streams

MODULES = (core, evaluation, profiles, streams, more, further)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
