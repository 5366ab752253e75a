"""The queries of the training-data operators and their SQL."""

from . import langid, lines, mixing, neardup, packing, pages, splitting, toxicity

QUERIES: dict = {}
SQL: dict = {}
for _module in (splitting, lines, pages, langid, neardup, packing, mixing, toxicity):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
