"""All registered queries of the engine and their DuckDB oracles."""

from . import corpus, more, relational, storage

QUERIES = corpus.QUERIES | relational.QUERIES | more.QUERIES | storage.QUERIES
ORACLE = corpus.ORACLE | relational.ORACLE | more.ORACLE | storage.ORACLE
