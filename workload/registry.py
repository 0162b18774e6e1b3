"""All queries by name: (Spark callable, SQL statement or None)."""

from workload import cells, reconciliation, tables

QUERIES = {**cells.QUERIES, **tables.QUERIES, **reconciliation.QUERIES}
