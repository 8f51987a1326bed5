"""The engine's own queries over the driver's tables, by name, and SQL that gives the same rows."""

from . import records, rewrites, scores, texts

QUERIES = {**scores.QUERIES, **texts.QUERIES, **records.QUERIES, **rewrites.QUERIES}
ORACLES = {**scores.ORACLES, **texts.ORACLES, **records.ORACLES, **rewrites.ORACLES}
