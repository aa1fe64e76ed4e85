"""All queries on the reference's own operators and their SQL."""

from quillstone.plans import page_queries, text_queries

QUERIES: dict = text_queries.QUERIES | page_queries.QUERIES
ORACLES: dict = text_queries.ORACLES | page_queries.ORACLES
