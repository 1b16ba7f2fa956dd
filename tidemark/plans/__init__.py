"""The registered queries: QUERIES by name, and ORACLE with the same result as SQL."""

from tidemark.plans import data, sql

QUERIES = sql.QUERIES | data.QUERIES
ORACLE = sql.ORACLE | data.ORACLE
