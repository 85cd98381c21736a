"""Registered queries over the driver's tables, and the SQL that checks them."""

from . import edge_queries, file_queries, gene_queries, text_queries

QUERIES: dict = {**edge_queries.QUERIES, **gene_queries.QUERIES, **text_queries.QUERIES, **file_queries.QUERIES}
ORACLES: dict = {**edge_queries.ORACLES, **gene_queries.ORACLES, **text_queries.ORACLES, **file_queries.ORACLES}
